"""Language identification with bit-sliced Bloom filters over byte n-grams.

One filter holds all languages: each position has a bit for each language, so the conjunction of an n-gram's positions
is the set of languages that contain it. A text's n-grams give each language a count; the count expected from false
positives alone is taken off, and the largest rest decides.

The model is learned from a sample of at most about SAMPLE documents and SAMPLE_BYTES bytes a language, so its size is
bounded; every text is then read whole by a map without shuffle. Texts are taken in blocks and their n-grams one length
at a time, so a worker holds a few megabytes however many texts come at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import bounded, doc_mod, freed, stored
from lodestone.llm.textblocks import LETTER, LOWER, blocks, mix

SAMPLE, SAMPLE_BYTES = 4_000, 64 << 20
SIZES = (3, 4, 5)
#: An n-gram belongs to a language if it occurs at least this often there, at this share of its highest rate at least.
LEAST, SHARE = 4, 0.3
HASHES = 3
_BASE = np.uint64(0x9E3779B97F4A7C15)


def grams(data: np.ndarray, offsets: np.ndarray, sizes=SIZES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size the hashes of each document's byte n-grams (letters only, other runs one space) and their documents."""
    n_docs = len(offsets) - 1
    # Each document stands between spaces of its own, so that n-grams see its first and last word's edges.
    doc = np.repeat(np.arange(n_docs, dtype=np.int32), np.diff(offsets) + 2)
    text = np.zeros(len(doc), np.uint8)
    at = np.arange(len(data)) + np.repeat(2 * np.arange(n_docs) + 1, np.diff(offsets))
    text[at] = np.where(LETTER[data], LOWER[data], 0)
    keep = np.ones(len(text), bool)
    keep[1:] = (text[1:] != 0) | (text[:-1] != 0) | (doc[1:] != doc[:-1])
    text, doc = text[keep], doc[keep]
    for k in sizes:
        n = len(text) - k + 1
        if n <= 0:
            continue
        h = np.full(n, np.uint64(k))
        with np.errstate(over="ignore"):
            for j in range(k):
                h *= _BASE
                h += text[j : n + j]
        same = doc[:n] == doc[k - 1 :]
        yield mix(h[same]), doc[:n][same]


@dataclass
class Filter:
    """``masks`` at each position, in words of up to 64 languages; ``rates``: how likely an n-gram that a language lacks seems to be there."""

    languages: list[str]
    masks: np.ndarray
    rates: np.ndarray

    @staticmethod
    def of(languages: list[str], hashes: np.ndarray, masks: np.ndarray) -> Filter:
        """``masks``: for each n-gram its languages, a row of 64-bit words."""
        kind = next((t for t in (np.uint8, np.uint16, np.uint32) if len(languages) <= 8 * np.dtype(t).itemsize), np.uint64)
        table = np.zeros((1 << max(16, (8 * max(len(hashes), 1)).bit_length()), -(-max(len(languages), 1) // 64)), kind)
        for j in range(HASHES):
            np.bitwise_or.at(table, Filter.place(hashes, j, len(table)), masks.astype(kind))
        full = np.array([np.mean((table[:, i // 64] >> kind(i % 64)) & kind(1)) for i in range(len(languages))])
        return Filter(languages, table, full**HASHES)

    @staticmethod
    def place(hashes: np.ndarray, j: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(hashes + np.uint64(j + 1)) & np.uint64(size - 1)).astype(np.int64)

    def contains(self, hashes: np.ndarray, word: int = 0) -> np.ndarray:
        """For each n-gram those of languages 64 * ``word`` and on that contain it, as bits."""
        masks = self.masks[:, word]
        out = masks[self.place(hashes, 0, len(masks))]
        for j in range(1, HASHES):
            out &= masks[self.place(hashes, j, len(masks))]
        return out

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each document and language how many n-grams it contains, less the false positives."""
        n_docs = len(offsets) - 1
        total, each = np.zeros((n_docs, 1)), np.zeros((n_docs, len(self.languages)))
        one = self.masks.dtype.type(1)
        for h, doc in grams(data, offsets):
            total[:, 0] += np.bincount(doc, minlength=n_docs)
            for first in range(0, len(self.languages), 64):
                found = self.contains(h, first // 64)
                for i in range(first, min(first + 64, len(self.languages))):
                    each[:, i] += np.bincount(doc[(found >> self.masks.dtype.type(i - first)) & one != 0], minlength=n_docs)
        return np.maximum((each - total * self.rates) / np.maximum(1 - self.rates, 1e-9), 0)


def fit(docs: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Filter:
    """Learn from ``docs`` (doc_id, text, lang) whose crc32(doc_id) mod 4 is not 2.

    About ``sample`` documents of each language are drawn by a hash of their id, fewer where their texts have more than
    ``sample_bytes`` bytes together. Any number of languages will do.
    """
    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (doc_mod(F.col("doc_id"), 4) != 2))
    sizes = train.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).collect()  # a row a language
    share = {r["lang"]: min(1.0, sample / r["n"], sample_bytes / max(r["bytes"], 1)) for r in sizes}
    languages = sorted(share)
    if not languages:
        return Filter([], np.zeros((1 << 16, 1), np.uint8), np.zeros(0))
    shares = F.create_map(*(F.lit(x) for k in languages for x in (k, share[k])))
    unit = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    train = train.where(unit < shares[F.col("lang")]).select((F.array_position(F.array(*map(F.lit, languages)), F.col("lang")) - 1).alias("lang"), "text")

    def count(batches):
        for b in batches:
            langs = b.column(0).to_numpy()
            for first, last, data, offsets in blocks(b.column(1)):
                for h, doc in grams(data, offsets):
                    own = langs[first:last][doc]
                    for i in np.unique(own):
                        g, n = np.unique(h[own == i], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), i), pa.int32()), pa.array(g.view(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    each = stored(bounded(train).mapInArrow(freed(count), "lang int, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n")), "grams")
    totals = {r["lang"]: r["n"] for r in each.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    rate = F.col("n") / F.create_map(*(F.lit(x) for k, v in totals.items() for x in (k, float(v))))[F.col("lang")]
    best = each.withColumn("rate", rate).groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("lang", "n", "rate")).alias("of"))
    in_lang = F.filter("of", lambda x: (x["n"] >= LEAST) & (x["rate"] >= SHARE * F.col("top")))

    def word(w: int):
        bit = lambda x: F.when(F.floor(x["lang"] / 64) == w, F.call_function("shiftleft", F.lit(1).cast("long"), x["lang"] % 64)).otherwise(F.lit(0).cast("long"))
        return F.aggregate(in_lang, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(bit(x))).alias(f"w{w}")

    words = range(-(-len(languages) // 64))
    table = best.where(F.size(in_lang) > 0).select("gram", *map(word, words)).toArrow()  # bounded by the sample
    masks = np.stack([table.column(f"w{w}").to_numpy().astype(np.int64).view(np.uint64) for w in words], 1)
    return Filter.of(languages, table.column("gram").to_numpy().astype(np.int64).view(np.uint64), masks)


def predict(docs: DataFrame, model: Filter, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the predicted language and its score to ``docs`` under these names (all other columns stay).

    The language is ``und`` with score 0 where the text is null or has no letter (or no language was learned); a text
    with letters but no known n-gram takes the first language. The score is the winner's share of the two best counts.
    """
    docs = docs.drop(lang, score)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        names = np.array([*m.languages, "und"], object)
        for b in batches:
            best, share = np.full(len(b), len(m.languages)), np.zeros(len(b))
            text = b.column("text")
            for first, last, data, offsets in blocks(text):
                if not m.languages:
                    break
                letters = np.add.reduceat(np.append(LETTER[data], 0), offsets[:-1]) * (np.diff(offsets) > 0)
                plain = np.add.reduceat(np.append(LETTER[data] & (data < 128), 0), offsets[:-1]) * (np.diff(offsets) > 0)
                for i in np.nonzero((letters > 0) & (plain == 0))[0]:  # no ASCII letter: is there another one?
                    letters[i] = any(map(str.isalpha, text[first + int(i)].as_py()))
                n = m.counts(data, offsets)
                order = np.sort(np.append(n, np.zeros((len(n), 1)), 1), axis=1)
                top, second = order[:, -1], order[:, -2]
                best[first:last] = np.where(letters > 0, n.argmax(1), len(m.languages))
                share[first:last] = np.where(letters > 0, np.where(top > 0, top / np.maximum(top + second, 1e-12), 1 / len(m.languages)), 0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names[best], pa.string()), pa.array(share)], [*b.schema.names, lang, score])

    schema = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    return bounded(docs).mapInArrow(freed(run), schema)


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """For each row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score. See ``fit`` and ``predict``.

    Nulls in any column, empty texts and repeated rows keep their rows; other columns are not read.
    """
    found = predict(docs.select("doc_id", "text"), fit(docs, sample))
    return found.select("doc_id", (doc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
