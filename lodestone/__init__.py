"""lodestone: a PySpark-native engine for curating and evaluating language-model data."""
