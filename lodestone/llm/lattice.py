"""Language-model scoring: the probability of a text over all subword segmentations of its words.

The pieces and their weights come from an existing vocabulary's scores; a forward recursion in logarithms sums over all
segmentations. In a few rounds the training words, each once, are segmented in all ways by these weights, and how often a
piece is expected there is added to its weight; a vocabulary of another corpus would else give the words of this one next
to nothing. A training word is itself an arc of its lattice, with its count less a discount for counts of its size; the
discounted mass goes to the pieces, so every word has a probability, the sum over all its segmentations, and all words'
probabilities and the end's add up to one.

Scale: counts are grouped by word with partial sums. The lattice runs once for each distinct word. Texts meet their
words' scores in one further pass: the most frequent words, HOT at most, by broadcast, all others by a
join on the word, where no key is frequent.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import bounded, doc_mod, freed, stored
from lodestone.llm.textblocks import LOWER, SPACE, blocks, runs

HOT = 100_000
#: Bytes of text whose words are counted at once, and rows of a batch of other words.
TEXTS, ROWS = 1 << 22, 50_000
#: Places of a word that are worked on at once.
STEP = 1 << 12
#: Rounds in which training words add to the pieces' weights; the vocabulary's own weight, in words; bytes of a stretch, in
#: which longer words are cut there.
ROUNDS, PRIOR, STRETCH = 4, 300.0, 256
SUMS = ["n_tokens", "n_known", "base", "lp", "sub"]
_BASE = np.uint64(0x9E3779B97F4A7C15)


def load_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """Surfaces of a sentencepiece vocabulary and their log-probabilities. A leading space marks a word's start.

    Scores that are no log-probabilities but ranks (a merge vocabulary) give each piece a weight of 1 / (rank + 10).
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    score: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        surface = model.id_to_piece(i).replace("▁", " ").encode()
        if surface and b" " not in surface[1:]:
            score[surface] = model.get_score(i)
    ranks = all(s == int(s) for s in score.values())
    first = {k: -math.log(10 - s) if ranks else s for k, s in score.items()}
    least = min(first.values(), default=0.0)
    for b in range(256):
        first.setdefault(bytes([b]), least)
    logp = np.array(list(first.values()))
    return list(first), logp - np.logaddexp.reduce(logp)


class Lattice:
    """Sums over all segmentations of byte strings into pieces."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.logp = np.append(logp, -np.inf)  # the last entry: no such piece
        self.longest = max(map(len, pieces))
        bits = max(10, (4 * len(pieces)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ids = np.zeros(1 << bits, np.uint64), np.full(1 << bits, len(pieces), np.int64)
        with np.errstate(over="ignore"):
            for i, p in enumerate(pieces):
                h = np.uint64(0)
                for b in p:
                    h = h * _BASE + np.uint64(b + 1)
                at = int((h * _BASE) >> self.shift)
                while self.keys[at]:
                    at = (at + 1) & self.mask
                self.keys[at], self.ids[at] = h, i

    def _find(self, h: np.ndarray) -> np.ndarray:
        at = ((h * _BASE) >> self.shift).astype(np.int64)
        key = self.keys[at]
        out = np.where(key == h, self.ids[at], len(self.logp) - 1)
        left = np.nonzero((key != h) & (key != 0))
        while len(left[0]):
            at[left] = (at[left] + 1) & self.mask
            key = self.keys[at[left]]
            out[left] = np.where(key == h[left], self.ids[at[left]], len(self.logp) - 1)
            go = (key != h[left]) & (key != 0)
            left = tuple(x[go] for x in left)
        return out

    def _arcs(self, m: np.ndarray) -> list[np.ndarray]:
        """Of words of one length, the rows of ``m``: for each arc length the piece at each start, or the last entry."""
        n, size = m.shape
        h, power, out = np.zeros((n, size + 1), np.uint64), np.uint64(1), []
        for t in range(size):
            h[:, t + 1] = h[:, t] * _BASE + (m[:, t].astype(np.uint64) + np.uint64(1))
        for k in range(1, min(self.longest, size) + 1):
            power = power * _BASE
            out.append(self._find(h[:, k:] - h[:, :-k] * power))
        return out

    def _forward(self, m: np.ndarray) -> np.ndarray:
        """Of words of one length, the rows of ``m``: log of the sums over all segmentations. Long words go in steps."""
        n, size = m.shape
        alpha = np.full((n, self.longest + 1), -np.inf)  # at the last places, the latest at the end
        alpha[:, -1] = 0
        for first in range(0, size, STEP):
            last, before = min(first + STEP, size), min(first, self.longest)
            scores = [self.logp[a] for a in self._arcs(m[:, first - before : last])]
            alpha = np.concatenate([alpha[:, alpha.shape[1] - before - 1 :], np.full((n, last - first), -np.inf)], axis=1)
            for t in range(before + 1, alpha.shape[1]):
                alpha[:, t] = np.logaddexp.reduce([alpha[:, t - k] + scores[k - 1][:, t - k] for k in range(1, min(len(scores), t) + 1)], axis=0)
        return alpha[:, -1]

    def batches(self, words: list[bytes]):
        """Matrices of words of one length, with their places in ``words``."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        cuts = np.nonzero(np.diff(lengths[order]))[0] + 1
        for group in np.split(order, cuts):
            size = int(lengths[group[0]]) if len(group) else 0
            for part in np.split(group, range(0, len(group), max(1, 200_000 // max(size, 1)))[1:]) if size else []:
                yield part, np.frombuffer(b"".join(words[i] for i in part), np.uint8).reshape(len(part), size)

    def score(self, words: list[bytes]) -> np.ndarray:
        """Natural log of each string's probability, all segmentations together."""
        out = np.full(len(words), -np.inf)
        with np.errstate(over="ignore", invalid="ignore"):
            for part, m in self.batches(words):
                out[part] = self._forward(m)
        return out

    def expected(self, words: list[bytes]) -> np.ndarray:
        """How often each piece is expected in all segmentations of the strings, weighted by their probability."""
        total = np.zeros(len(self.logp))
        stretches = [w[a : a + STRETCH] for w in words for a in range(0, len(w), STRETCH)]
        with np.errstate(over="ignore", invalid="ignore"):
            for _, m in self.batches(stretches):
                n, size = m.shape
                arcs = self._arcs(m)
                scores = [self.logp[a] for a in arcs]
                before, behind = (np.full((n, size + 1), -np.inf) for _ in "ab")
                before[:, 0] = behind[:, -1] = 0
                for t in range(1, size + 1):
                    before[:, t] = np.logaddexp.reduce([before[:, t - k] + scores[k - 1][:, t - k] for k in range(1, min(len(arcs), t) + 1)], axis=0)
                for t in range(size - 1, -1, -1):
                    behind[:, t] = np.logaddexp.reduce([behind[:, t + k] + scores[k - 1][:, t] for k in range(1, min(len(arcs), size - t) + 1)], axis=0)
                for k, a in enumerate(arcs, 1):
                    share = np.exp(before[:, :-k] + scores[k - 1] + behind[:, k:] - before[:, -1:])
                    total += np.bincount(a.ravel(), np.nan_to_num(share).ravel(), len(total))
        return total[:-1]


def _gathered(batches):
    """Batches of ROWS words or more, or of TEXTS bytes: a lattice works on all words of one length at once."""
    held, rows, size = [], 0, 0
    for b in batches:
        held, rows, size = [*held, b], rows + b.num_rows, size + b.nbytes
        if rows >= ROWS or size >= TEXTS:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows, size = [], 0, 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def fitted(words: DataFrame, pieces: list[bytes], logp: np.ndarray, rounds: int = ROUNDS, prior: float = PRIOR) -> np.ndarray:
    """Log-probabilities of the pieces: ``prior`` words' worth of ``logp``, and what all rows of ``words`` (word) expect.

    A pass over the words a round; the driver gets a number for each piece of the vocabulary. Without words, ``logp``.
    """
    first = logp
    for _ in range(rounds):
        model = words.sparkSession.sparkContext.broadcast((pieces, logp))

        def count(batches, model=model):
            lattice, total = Lattice(*model.value), np.zeros(len(model.value[0]))
            for b in _gathered(batches):
                total += lattice.expected([b" " + w.encode() for w in b.column(0).to_pylist()])
            at = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["piece", "n"])

        sums = words.select("word").mapInArrow(freed(count), "piece long, n double").groupBy("piece").agg(F.round(F.sum("n"), 9).alias("n")).toArrow()
        weight = prior * np.exp(first)
        weight[sums.column("piece").to_numpy()] += sums.column("n").to_numpy()
        logp = np.log(weight) - math.log(weight.sum())
    return logp


def token_array(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Tokens of each document in order (A-Z lower-cased), and each one's document."""
    ink = ~SPACE[data]
    at, size = runs(ink.astype(np.int8), offsets)
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    tokens = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(LOWER[data[ink]])])
    return tokens, np.searchsorted(offsets, at, "right") - 1


def discounts(counts: list[int]) -> list[float]:
    """What to take off words of count 1, 2 and more, from how many words have the counts 1, 2, 3 and 4.

    Where those are too few to tell, a half of each count up to 0.75.
    """
    n1, n2, n3, n4 = counts
    out = [0.5, 0.75, 0.75]
    if min(counts) > 0:
        y = n1 / (n1 + 2 * n2)
        guess = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
        out = [g if 0 < g < k else d for k, g, d in zip((1, 2, 3), guess, out, strict=True)]
    return out


def _counted(batches):
    """Per block of texts: word, its occurrences, and those in training rows."""
    for b in batches:
        train = b.column("train").to_numpy()
        for first, last, data, offsets in blocks(b.column("text"), TEXTS):
            word, doc = token_array(data, offsets)
            each = pa.table({"word": word, "f": pa.array(train[first:last][doc])}).group_by("word").aggregate([("f", "count"), ("f", "sum")])
            for part in each.select(["word", "f_count", "f_sum"]).rename_columns(["word", "f", "c"]).to_batches():
                yield part


def _summed(hot):
    """Per text one row with the sums of its hot words, and a row for each other word with its occurrences.

    ``hot``: words, and for each known (0 or 1), base, lp and sub.
    """
    names = ["doc_id", "h", "copies", "key", "word", "m", *SUMS]

    def run(batches):
        words, values = hot.value
        for b in batches:
            for first, last, data, offsets in blocks(b.column("text"), TEXTS):
                n_docs = last - first
                token, doc = token_array(data, offsets)
                coded = token.dictionary_encode()
                code, surface = coded.indices.to_numpy(), coded.dictionary
                place = pc.fill_null(pc.index_in(surface, words), -1).to_numpy()
                spot = place[code] if len(code) else np.zeros(0, np.int64)
                often = spot >= 0
                sums = [np.bincount(doc[often], v[spot[often]], n_docs) for v in (np.ones(len(words)), *values)]
                pairs, m = np.unique(doc[~often] * max(len(surface), 1) + code[~often], return_counts=True)
                owner, which = np.divmod(pairs, max(len(surface), 1))
                ids, h = b.column("doc_id").slice(first, n_docs), b.column("h").slice(first, n_docs)
                none = pa.nulls(n_docs, pa.string())
                flat = [pa.array(x.astype(np.int64) if i < 2 else x) for i, x in enumerate(sums)]
                yield pa.RecordBatch.from_arrays([ids, h, pa.array(np.ones(n_docs, np.int64)), h, none, pa.array(np.zeros(n_docs, np.int64)), *flat], names)
                for low in range(0, len(owner), ROWS):
                    o, w = pa.array(owner[low : low + ROWS]), pa.array(which[low : low + ROWS])
                    nothing = pa.nulls(len(o), pa.int64())
                    rest = [pa.nulls(len(o), pa.int64() if i < 2 else pa.float64()) for i in range(len(SUMS))]
                    yield pa.RecordBatch.from_arrays([ids.take(o), h.take(o), nothing, nothing, surface.take(w), pa.array(m[low : low + ROWS]), *rest], names)

    return run


def score_texts(docs: DataFrame, vocabulary: str, hot: int = HOT) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score.

    Rows whose crc32(doc_id) mod 10 is not 0 train. ``lattice_score`` is the log10 probability of the words over all
    segmentations into pieces alone; in ``score`` training words are arcs too, and the end counts. A null
    text counts as ''; it has one token, the end. Repeated rows are scored each; a null id folds as the text ''. Without
    training rows, half of the probability goes to the end. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = bounded(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (doc_mod(F.col("doc_id"), 10) != 0).cast("long").alias("train"), F.xxhash64("text").alias("h"))
    counts = rows.select("text", "train").mapInArrow(freed(_counted), "word string, f long, c long")
    counts = stored(counts.groupBy("word").agg(F.sum("f").alias("f"), F.sum("c").alias("c")), "words")

    ends = rows.agg(F.coalesce(F.sum("train"), F.lit(0)).alias("n")).first()["n"]
    met = lambda k: F.count(F.when(F.col("c") == k, 1))
    n, v, *few = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1)), *map(met, (1, 2, 3, 4))).first()
    off = discounts(few)
    n, v, many = n + ends, v + (ends > 0), v - few[0] - few[1] + (ends > 0)
    mass = (off[0] * few[0] + off[1] * few[1] + off[2] * many) / n if n else 0.5
    end = math.log10(max(ends - off[2], 0.25) / n) if ends else math.log10(0.5)

    pieces, scores = load_pieces(vocabulary)
    model = spark.sparkContext.broadcast((pieces, fitted(counts.where("c > 0"), pieces, scores)))

    def score(batches):
        lattice = Lattice(*model.value)
        for b in _gathered(batches):
            c = b.column("c").to_numpy()
            sub = lattice.score([b" " + w.encode() for w in b.column("word").to_pylist()]) / math.log(10)
            own = np.maximum(c - np.array([0.0, *off])[np.minimum(c, 3)], 0) / max(n, 1)
            with np.errstate(divide="ignore"):
                both = np.logaddexp(sub * math.log(10) + math.log(mass), np.log(own)) / math.log(10)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(both), pa.array(sub)], [*b.schema.names, "lp", "sub"])

    scored = stored(counts.select("word", "f", "c").mapInArrow(freed(score), "word string, f long, c long, lp double, sub double"), "scored")
    lowest = math.log10(n + 0.1 * (v + 1))
    scored = scored.select("word", "f", (F.col("c") > 0).cast("long").alias("known"), (F.log10(F.col("c") + 0.1) - lowest).alias("base"), "lp", "sub")
    # The most frequent words by a histogram of logarithms, so no task sees the candidates of all others.
    step = F.floor(F.log2(F.col("f").cast("double")) * 16).alias("step")
    at_least, room = None, hot
    for at, some in sorted(scored.groupBy(step).count().collect(), reverse=True):  # 16 rows for each doubling
        if some > room:
            break
        at_least, room = at, room - some
    top = scored.where(step >= at_least) if at_least is not None else scored.limit(0)
    top = top.toArrow().combine_chunks()  # ``hot`` rows at most
    top_words = top.column("word").combine_chunks() if len(top) else pa.array([], pa.string())
    shared = spark.sparkContext.broadcast((top_words, [top.column(c).to_numpy().astype(float) for c in ("known", "base", "lp", "sub")]))

    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("h long, copies long, key long, word string, m long, n_tokens long, n_known long, base double, lp double, sub double").fields])
    parts = rows.select("doc_id", "h", "text").mapInArrow(freed(_summed(shared)), schema).withColumn("key", F.coalesce("key", F.xxhash64("word")))
    # A text's own row has no word and no partner; its key only spreads it.
    rest = scored.select(F.xxhash64("word").alias("key"), "word", *(F.col(c).alias(f"w_{c}") for c in ("known", "base", "lp", "sub")))
    parts = parts.join(rest, ["key", "word"], "left")
    sums = [F.sum(F.coalesce("n_tokens", "m")).alias("n_tokens"), F.sum(F.coalesce("n_known", F.col("w_known") * F.col("m"))).alias("n_known")]
    sums += [F.sum(F.coalesce(c, F.col(f"w_{c}") * F.col("m"))).alias(c) for c in ("base", "lp", "sub")]
    total = parts.groupBy("doc_id", "h").agg(F.sum("copies").alias("copies"), *sums)
    each = total.select("*", F.explode(F.expr("sequence(1L, copies)"))).withColumn("held_out", doc_mod(F.col("doc_id"), 10) == 0)
    return each.select(
        "doc_id", "held_out", (F.expr("n_tokens div copies") + 1).alias("n_tokens"), (F.expr("n_known div copies") + int(ends > 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") / F.col("copies") + (math.log10(ends + 0.1) - lowest)).alias("base_score"),
        (F.col("lp") / F.col("copies") + end).alias("score"), (F.col("sub") / F.col("copies")).alias("lattice_score"),
    )
