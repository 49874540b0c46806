"""Byte-level BPE: merges from a priority queue of ranks over doubly linked symbol lists.

All distinct pieces of a batch share one set of linked lists (arrays of previous, next and symbol) and one queue. The
queue holds ranks; with each rank goes the list of places where its pair was seen. A popped place is stale, and is
skipped, if its symbols have merged meanwhile. Since places of one rank are taken together, the work is in arrays.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm.common import bounded, freed

#: Bytes that the pieces a worker keeps may take, in two halves: the younger one, and what was used before it was begun.
CACHE_BYTES = 64 << 20
#: Characters of text that are cut into pieces at once; pieces not known yet are encoded together.
CHUNK = 4_000_000
#: Bytes that a piece takes besides its characters: its tuple, its strings' heads, its place in a dictionary.
_PIECE = 350


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


class Bpe:
    """Encoder and decoder of a byte-level vocabulary in the tokenizers library's JSON form."""

    def __init__(self, path: str, text: str | None = None):
        """From the file at ``path``, or from its ``text``."""
        import public_tokenizers
        import regex

        spec = json.loads(text if text is not None else _read(path))
        vocab = spec["model"]["vocab"]
        chars = byte_characters()
        back = {c: b for b, c in enumerate(chars)}
        self.byte_ids = np.array([vocab[c] for c in chars], np.int32)
        self.surface = {i: bytes(back[c] for c in token) for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.surface |= {i: s.encode() for s, i in self.special.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.left, self.right = left, right
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of = keys[order], order
        self._bytes = 0
        self.cut = regex.compile(public_tokenizers.PATTERN)
        self.cut_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, -1 if it has none."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], -1)

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """The ids of each piece."""
        raw = [p.encode() for p in pieces]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        sym = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        n = len(sym)
        end = np.cumsum(size)
        nxt, prev = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[end[size > 0] - 1] = -1
        prev[(end - size)[size > 0]] = -1
        queue: list[int] = []
        places: dict[int, list[np.ndarray]] = {}

        def push(at: np.ndarray) -> None:
            rank = self.ranks(sym[at], sym[nxt[at]])
            ok = rank >= 0
            at, rank = at[ok], rank[ok]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.nonzero(rank[1:] != rank[:-1])[0] + 1
            for r, some in zip(rank[np.append(0, cuts)].tolist(), np.split(at, cuts), strict=True):
                if r in places:
                    places[r].append(some)
                else:
                    places[r] = [some]
                    heapq.heappush(queue, r)

        push(np.nonzero(nxt >= 0)[0])
        while queue:
            r = heapq.heappop(queue)
            found = places.pop(r)
            at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            after = nxt[at]
            fresh = (sym[at] == self.left[r]) & (after >= 0)
            fresh &= sym[after] == self.right[r]
            at, after = at[fresh], after[fresh]
            if not len(at):
                continue
            if self.left[r] == self.right[r] and len(at) > 1:  # of overlapping places every second one, from the left
                chained = np.append(False, at[1:] == after[:-1])
                start = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                take = (np.arange(len(at)) - start) % 2 == 0
                at, after = at[take], after[take]
            beyond = nxt[after]
            sym[at], sym[after] = self.made[r], -1
            nxt[at] = beyond
            inner = beyond >= 0
            prev[beyond[inner]] = at[inner]
            before = prev[at]
            push(np.unique(np.concatenate([before[before >= 0], at[inner]])))
        alive = sym >= 0
        upto = np.append(0, np.cumsum(alive))[np.append(0, end)].tolist()
        ids = sym[alive].tolist()
        return [ids[a:b] for a, b in itertools.pairwise(upto)]

    @cached_property
    def _known(self) -> dict[str, tuple[str, int, str]]:
        """Pieces of the younger half: ids as text, how many, and the text decoded from them."""
        return {}

    @cached_property
    def _older(self) -> dict[str, tuple[str, int, str]]:
        return {}

    @cached_property
    def _decimal(self) -> dict[int, str]:
        return {i: str(i) for i in self.surface}

    def _remember(self, pieces: set[str]) -> None:
        """Make all pieces known. Where they fill half of the bytes, older ones that were not used since are let go."""
        if self._bytes > CACHE_BYTES // 2:
            self._older.clear()
            self._older.update(self._known)
            self._known.clear()
            self._bytes = 0
        if not self._known:
            self._known.update({s: (str(i), 1, s) for s, i in self.special.items()})
        missing = [p for p in pieces if p not in self._known]
        again = {p: self._older[p] for p in missing if p in self._older}
        self._known.update(again)
        self._learn([p for p in missing if p not in again])
        self._bytes += sum(map(len, missing)) * 8 + len(missing) * _PIECE

    def cut_text(self, text: str) -> list[str]:
        """Pieces of a text in order; special tokens stand alone."""
        if not self.cut_special or not any(s in text for s in self.special):
            return self.cut.findall(text)
        return [p for part in self.cut_special.split(text) for p in ([part] if part in self.special else self.cut.findall(part))]

    def run(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text: how many ids, the ids comma-joined, and the text decoded from them."""
        out: list[tuple[int, str, str]] = []
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size + len(texts[last]) <= CHUNK):
                size, last = size + len(texts[last]), last + 1
            cut = [self.cut_text(t) for t in texts[first:last]]
            self._remember(set().union(*cut))
            known = self._known
            for pieces in cut:
                got = [known[p] for p in pieces]
                out.append((sum([g[1] for g in got]), ",".join([g[0] for g in got]), "".join([g[2] for g in got])))
            first = last
        return out

    def _learn(self, pieces: list[str]) -> None:
        known, surface, decimal = self._known, self.surface.__getitem__, self._decimal.__getitem__
        for p, ids in zip(pieces, self.encode_pieces(pieces), strict=True):
            back = b"".join(map(surface, ids)).decode("utf-8", "replace")
            known[p] = (",".join(map(decimal, ids)), len(ids), p if back == p else back)

    def encode(self, text: str) -> list[int]:
        ids = self.run([text])[0][1]
        return [int(x) for x in ids.split(",")] if ids else []

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings in order, as text; ids that the vocabulary lacks give nothing."""
        return b"".join(self.surface.get(i, b"") for i in ids).decode("utf-8", "replace")


_BUILT: dict[str, Bpe] = {}


def _built(text: str) -> Bpe:
    """The vocabulary of a text; a worker builds one once."""
    if text not in _BUILT:
        _BUILT.clear()
        _BUILT[text] = Bpe("", text)
    return _BUILT[text]


def _by_batch(docs: DataFrame, path: str, work):
    """A function of Arrow batches: ``work`` of the vocabulary at ``path``, which the driver reads and sends, and a batch."""
    sent = docs.sparkSession.sparkContext.broadcast(_read(path))

    def run(batches):
        bpe = _built(sent.value)
        for b in batches:
            yield work(bpe, b)

    return run


def encode_rows(docs: DataFrame, path: str) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, ids (array of int) and decoded. Null counts as ''."""

    def work(bpe, b):
        done = bpe.run([t or "" for t in b.column("text").to_pylist()])
        ids = [[int(x) for x in d[1].split(",")] if d[1] else [] for d in done]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([d[2] for d in done], pa.string())], ["doc_id", "ids", "decoded"])

    more = T.StructType.fromDDL("ids array<int>, decoded string").fields
    return bounded(docs).select("doc_id", "text").mapInArrow(freed(_by_batch(docs, path, work)), T.StructType([docs.schema["doc_id"], *more]))


RESULTS = ["n_tokens", "ids_sha256", "decoded_sha256"]


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with all columns and n_tokens, ids_sha256, decoded_sha256 of their ``text``, which take the place of equal names."""
    docs = docs.drop(*RESULTS)

    def work(bpe, b):
        done = bpe.run([t or "" for t in b.column("text").to_pylist()])
        hashes = [pa.array([hashlib.sha256(d[k].encode()).hexdigest() for d in done], pa.string()) for k in (1, 2)]
        return pa.RecordBatch.from_arrays([*b.columns, pa.array([d[0] for d in done], pa.int64()), *hashes], [*b.schema.names, *RESULTS])

    more = T.StructType.fromDDL("n_tokens long, ids_sha256 string, decoded_sha256 string").fields
    return bounded(docs).mapInArrow(freed(_by_batch(docs, path, work)), T.StructType([*docs.schema.fields, *more]))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as ''. Null ids and repeated rows keep their rows; other columns are not read. A map without
    shuffle.
    """
    return digests(docs.select("doc_id", "text"), path).drop("text")
