"""Column functions: text, rewards, vectors, JSON and alignment."""
