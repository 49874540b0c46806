"""Texts as numpy byte arrays: words, their hashes and shingles, straight from Arrow's buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BYTES = np.arange(256)
#: A-Z to a-z; every other byte stays.
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
UPPER = (_BYTES >= 65) & (_BYTES <= 90)
LETTER = UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
#: Letters, digits and all bytes of characters outside ASCII.
WORD = LETTER | ((_BYTES >= 48) & (_BYTES <= 57))
SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
#: Bytes of text that are worked on at once; arrays made of them take some dozen times as much.
BLOCK = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits (splitmix64's)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of a string column with about ``limit`` bytes: (first, last + 1, bytes, offsets). Null counts as ''."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        last = min(last, len(column))
        yield first, last, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def runs(kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal non-zero ``kind`` start, and each one's length. Runs end with their document."""
    if not len(kind):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.ones(len(kind), bool)
    change[1:] = kind[1:] != kind[:-1]
    begin = offsets[:-1]
    change[begin[begin < len(kind)]] = True
    at = np.nonzero(change)[0]
    size = np.diff(np.append(at, len(kind)))
    keep = kind[at] != 0
    return at[keep], size[keep]


def run_hashes(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes (not empty), from a polynomial."""
    if not len(at):
        return np.zeros(0, np.uint64)
    first = np.cumsum(size) - size
    pos = np.arange(int(size.sum())) - np.repeat(first, size)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(size.max()), _BASE))
        return mix(np.add.reduceat((data[np.repeat(at, size) + pos].astype(np.uint64) + np.uint64(1)) * powers[pos], first) + size.astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, lower-cased, and each one's document."""
    at, size = runs(WORD[data].astype(np.int8), offsets)
    return run_hashes(LOWER[data], at, size), np.searchsorted(offsets, at, "right") - 1


def shingles(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words of a document, and each one's document; of fewer words, all are one run."""
    n = len(hashes)
    if not n:
        return hashes, doc
    count = np.bincount(doc)
    short = (count > 0) & (count < k)
    with np.errstate(over="ignore"):
        out = np.zeros(max(n - k + 1, 0), np.uint64)
        for j in range(k):
            out += mix(hashes[j : n - k + 1 + j] + np.uint64(j + 1)) if n >= k else np.uint64(0)
        same = doc[: n - k + 1] == doc[k - 1 :] if n >= k else np.zeros(0, bool)
        out, owner = mix(out[same]), doc[: max(n - k + 1, 0)][same]
        if short.any():
            mine = short[doc]
            place = np.arange(n) - np.searchsorted(doc, doc)
            sums = np.zeros(len(count), np.uint64)
            np.add.at(sums, doc[mine], mix(hashes[mine] + place[mine].astype(np.uint64) + np.uint64(1)))
            out, owner = np.append(out, mix(sums[short])), np.append(owner, np.nonzero(short)[0])
    return out, owner


def weighted(items: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct items of each owner, by owner and item, with how often each occurs: (items, owner, counts)."""
    order = np.lexsort((items, owner))
    items, owner = items[order], owner[order]
    new = np.ones(len(items), bool)
    new[1:] = (items[1:] != items[:-1]) | (owner[1:] != owner[:-1])
    at = np.nonzero(new)[0]
    return items[at], owner[at], np.diff(np.append(at, len(items)))
