"""Rewriting by a table of phrases: an Aho-Corasick automaton finds all of them in one pass over a text."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of phrases and replacements that are sent to every worker at most; a larger table is refused.
TABLE_BYTES = 32 << 20


class Automaton:
    """All phrases as a trie; each node knows the longest proper suffix that is a node too, and the next suffix that is a phrase."""

    def __init__(self, table: dict[str, str]):
        """``table`` maps phrases to what stands in their place; empty phrases are left out."""
        self.table = {p: r for p, r in table.items() if p}
        self.go: list[dict[str, int]] = [{}]
        self.phrase: list[str | None] = [None]
        for p in self.table:
            at = 0
            for c in p:
                if c not in self.go[at]:
                    self.go[at][c] = len(self.go)
                    self.go.append({})
                    self.phrase.append(None)
                at = self.go[at][c]
            self.phrase[at] = p
        self.fail, self.suffix = [0] * len(self.go), [0] * len(self.go)
        todo = deque(self.go[0].values())
        while todo:
            at = todo.popleft()
            for c, child in self.go[at].items():
                back = self.fail[at]
                while back and c not in self.go[back]:
                    back = self.fail[back]
                self.fail[child] = self.go[back].get(c, 0)
                todo.append(child)
            self.suffix[at] = self.fail[at] if self.phrase[self.fail[at]] else self.suffix[self.fail[at]]

    def longest(self, text: str) -> dict[int, str]:
        """The longest phrase that starts at each place."""
        found: dict[int, str] = {}
        at = 0
        for end, c in enumerate(text, 1):
            while at and c not in self.go[at]:
                at = self.fail[at]
            at = self.go[at].get(c, 0)
            hit = at if self.phrase[at] else self.suffix[at]
            while hit:  # phrases that end here, the longest first; a later end at one place is a longer phrase
                found[end - len(self.phrase[hit])] = self.phrase[hit]
                hit = self.suffix[hit]
        return found

    def matches(self, text: str) -> list[tuple[int, str]]:
        """Places and phrases from the left, at each place the longest, none inside another."""
        out, free = [], 0
        for start, phrase in sorted(self.longest(text).items()):
            if start >= free:
                out.append((start, phrase))
                free = start + len(phrase)
        return out

    def rewrite(self, text: str) -> str:
        out, last = [], 0
        for start, phrase in self.matches(text):
            out += [text[last:start], self.table[phrase]]
            last = start + len(phrase)
        return "".join([*out, text[last:]])


def rewriter(phrases: DataFrame, phrase: str, replacement: str):
    """A function of a text Column that puts ``replacement`` in the place of each ``phrase``, the leftmost and longest first.

    A phrase with several replacements takes the least one; null and empty phrases are left out, a null replacement is
    empty; null texts stay null; an empty table changes nothing. The table's bytes are counted before it is sent to the
    workers: more than TABLE_BYTES are an error.
    """
    rows = phrases.where(F.length(phrase) > 0).groupBy(F.col(phrase).alias("p")).agg(F.coalesce(F.min(replacement), F.lit("")).alias("r"))
    size = rows.agg(F.sum(F.octet_length("p") + F.octet_length("r"))).first()[0] or 0
    if size > TABLE_BYTES:
        raise ValueError(f"{size} bytes of phrases, more than {TABLE_BYTES} at once")
    sent = phrases.sparkSession.sparkContext.broadcast({r["p"]: r["r"] for r in rows.collect()})
    built: list[Automaton] = []

    @F.pandas_udf(T.StringType())
    def rewritten(texts: pd.Series) -> pd.Series:
        if not built:
            built.append(Automaton(sent.value))
        return texts.map(lambda t: None if t is None else built[0].rewrite(t))

    def apply(text: Column) -> Column:
        return rewritten(text)

    return apply
