"""Token alignment with error counts, and similarity of texts, in Arrow batches."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

_PAIR = T.StructType([T.StructField(n, T.StringType()) for n in ("op", "ref", "hyp")])
ALIGNMENT = T.StructType([*(T.StructField(n, T.IntegerType()) for n in ("all", "cor", "sub", "ins", "del")), T.StructField("pairs", T.ArrayType(_PAIR))])


#: Rows of distances that are kept of a stretch, and rows of a stretch whose moves are kept.
_KEPT, _STRETCH = 32, 64


def _row(above: np.ndarray, i: int, token: int, b: np.ndarray) -> np.ndarray:
    """Distances of the first ``i`` tokens from the ones of all but the last of these."""
    place = np.arange(len(b) + 1, dtype=np.int32)
    row = np.append(np.int32(i), np.minimum(above[1:] + 1, above[:-1] + (b != token)))
    return np.minimum.accumulate(row - place) + place  # insertions, all at once


def _walk(a: np.ndarray, b: np.ndarray) -> tuple[list[int], int]:
    """Moves from the end to the start (0 deletion, 1 insertion, 2 diagonal), and the distance.

    Divide and conquer over rows: a stretch keeps the distances of some rows only; its parts are gone through from the last,
    each with no more columns than the walk has left, and split again until the moves of a part fit. Memory is some hundred
    bytes a token of ``b``, times the logarithm of the other side, and each row is worked out a few times.
    """
    moves: list[int] = []
    total, j = None, len(b)
    todo = [(0, len(a), np.arange(len(b) + 1, dtype=np.int32))]
    while todo:
        low, high, row = todo.pop()
        row = row[: j + 1]
        step = max(_STRETCH, -(-(high - low) // _KEPT))
        if high - low > _STRETCH:
            for i in range(low, high):
                if (i - low) % step == 0:
                    todo.append((i, min(i + step, high), row))
                row = _row(row, i + 1, a[i], b[:j])
            total = int(row[-1]) if total is None else total
            continue
        how = np.zeros((high - low, j + 1), np.int8)
        for i in range(low, high):
            above, row = row, _row(row, i + 1, a[i], b[:j])
            how[i - low, 1:] = np.where(above[1:] + 1 == row[1:], 0, np.where(row[:-1] + 1 == row[1:], 1, 2))
        total = int(row[-1]) if total is None else total
        i = high
        while i > low:
            move = int(how[i - low - 1, j])
            moves.append(move)
            i, j = i - (move != 1), j - (move != 0)
    return moves + [1] * j, total if total is not None else len(b)


def _numbered(ref: list[str], hyp: list[str]) -> tuple[np.ndarray, np.ndarray]:
    ids: dict[str, int] = {}
    return tuple(np.array([ids.setdefault(w, len(ids)) for w in side], np.int64) for side in (ref, hyp))


def _pairs(ref: list[str], hyp: list[str]) -> list[tuple[str, str, str]]:
    pairs, i, j = [], len(ref), len(hyp)
    for how in _walk(*_numbered(ref, hyp))[0]:
        if how == 0:
            i -= 1
            pairs.append(("del", ref[i], ""))
        elif how == 1:
            j -= 1
            pairs.append(("ins", "", hyp[j]))
        else:
            i, j = i - 1, j - 1
            pairs.append(("cor" if ref[i] == hyp[j] else "sub", ref[i], hyp[j]))
    pairs.reverse()
    return pairs


def align(ref: list[str], hyp: list[str]) -> dict:
    """Least edits from ``ref`` to ``hyp``. Ties: a deletion first, then an insertion, a diagonal only if it is less."""
    pairs = _pairs(ref, hyp)
    count = {k: sum(p[0] == k for p in pairs) for k in ("cor", "sub", "ins", "del")}
    return {"all": len(ref), **count, "pairs": [dict(zip(("op", "ref", "hyp"), p, strict=True)) for p in pairs]}


def _by_parts(work: Callable, kind: T.DataType, *columns: pa.Array, size: int = 64) -> pa.Array:
    """``work`` of the values of each row, some rows at a time: only these are Python objects, the rest is Arrow's."""
    to = to_arrow_type(kind)
    rows = range(0, len(columns[0]), size)
    parts = [pa.array([work(*v) for v in zip(*(c.slice(low, size).to_pylist() for c in columns), strict=True)], to) for low in rows]
    return pa.concat_arrays(parts) if parts else pa.array([], to)


@F.arrow_udf(ALIGNMENT)
def aligned(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """Alignment of two token arrays; a null array has no token."""
    return _by_parts(lambda a, b: align(a or [], b or []), ALIGNMENT, ref, hyp)


@F.arrow_udf(T.IntegerType())
def edits(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """How many edits lead from one token array to the other; a null array has no token."""
    return _by_parts(lambda a, b: _walk(*_numbered(a or [], b or []))[1], T.IntegerType(), ref, hyp)


#: Steps of alignments that are handed on at once.
STEPS = 1 << 14


def steps(by: list[str]):
    """The steps of alignments of the columns _ref and _hyp, with the columns ``by`` of their rows, in batches of about STEPS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = [], []
            for i in range(b.num_rows):
                pairs = _pairs(b["_ref"][i].as_py() or [], b["_hyp"][i].as_py() or [])
                at += [i] * len(pairs)
                out += pairs
                if out and (len(out) >= STEPS or i == b.num_rows - 1):
                    own = [b[c].take(pa.array(at)) for c in by]
                    yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, pa.string()) for c in zip(*out, strict=True))], names=[*by, "op", "ref", "hyp"])
                    at, out = [], []

    return run


def _block(a: np.ndarray, b: np.ndarray, rare: np.ndarray, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """The longest common block of two stretches (start in a, start in b, length), of equal ones the first in a, then in b.

    It is sought among characters that are rare in b, and then lengthened by whatever is equal beside it.
    """
    best, at, to = 0, alo, blo
    seen = np.zeros(bhi - blo + 1, np.int64)
    side, counts = b[blo:bhi], rare[blo:bhi]
    for i in range(alo, ahi):
        seen[1:] = np.where((side == a[i]) & counts, seen[:-1] + 1, 0)
        j = int(seen.argmax())
        if seen[j] > best:
            best = int(seen[j])
            at, to = i + 1 - best, blo + j - best
    while at > alo and to > blo and a[at - 1] == b[to - 1]:
        at, to, best = at - 1, to - 1, best + 1
    while at + best < ahi and to + best < bhi and a[at + best] == b[to + best]:
        best += 1
    return at, to, best


def matched(a: str, b: str) -> int:
    """Characters in common blocks: the longest one, and those left and right of it, again and again.

    In a ``b`` of 200 characters or more, those that are over one in a hundred of it begin no block.
    """
    x, y = (np.array([ord(c) for c in t], np.int32) for t in (a, b))
    kinds, which, n = np.unique(y, return_inverse=True, return_counts=True)
    rare = (n <= len(y) // 100 + 1)[which] if len(y) >= 200 else np.ones(len(y), bool)
    total, todo = 0, [(0, len(x), 0, len(y))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        if alo < ahi and blo < bhi:
            i, j, k = _block(x, y, rare, alo, ahi, blo, bhi)
            if k:
                total += k
                todo += [(alo, i, blo, j), (i + k, ahi, j + k, bhi)]
    return total


@F.pandas_udf(T.DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the characters in common blocks by those of both lower-cased texts; 0 if either is null or empty."""
    ratio = lambda x, y: 2.0 * matched(x, y) / (len(x) + len(y))
    return pd.Series([ratio(x.lower(), y.lower()) if x and y else 0.0 for x, y in zip(a, b, strict=True)])


# Characters that the tokenizer drops and those that it takes as spaces.
PUNCTS = ["!", ",", "?", "、", "。", "！", "，", "；", "？", "：", "「", "」", "︰", "『", "』", "《", "》"]
SPACES = [" ", "\t", "\r", "\n"]


#: A token: one letter without case, a <tag>, or any other character with the ASCII run behind it.
_INK = r"[\x00-\x7F--[ \t\r\n]]"
_TOKEN = regex.compile(rf"(?V1)[{regex.escape(''.join(PUNCTS + SPACES))}\p{{Zs}}\p{{Cn}}](*SKIP)(*FAIL)|\p{{Lo}}|<[{_INK}--[>]]*>?|(?s:.){_INK}*")


@F.arrow_udf(T.ArrayType(T.StringType()))
def characterised(texts: pa.Array) -> pa.Array:
    """Letters without case one by one; other runs up to a space, a character outside ASCII or, for <tags>, their end."""
    return _by_parts(lambda t: _TOKEN.findall(t or ""), T.ArrayType(T.StringType()), texts)


@F.arrow_udf(T.IntegerType())
def display_width(texts: pa.Array) -> pa.Array:
    """Columns on a terminal: two for wide, full-width and ambiguous characters."""
    return _by_parts(lambda t: sum(1 + (unicodedata.east_asian_width(c) in "AFW") for c in t or ""), T.IntegerType(), texts)
