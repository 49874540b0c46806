"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network in numpy.

Each word has a sparse ternary index vector drawn from its hash. Its context vector sums its neighbours' index
vectors over the training sample; words share a table of BUCKETS rows by hash, so the model has a fixed size. A
document is the mean of its words' index vectors and of their context vectors, with their norms (repetition makes
them long) and its length. The network's outputs are calibrated with a temperature fitted on rows that it did not
train on. The model is fitted on at most about SAMPLE labelled rows of each label; every text is scored whole by a
map without shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import bounded, doc_mod, freed, stored
from lodestone.llm.textblocks import LOWER, SPACE, UPPER, WORD, blocks, mix, run_hashes, runs

SAMPLE = 6_000
#: Dimensions of index vectors, their non-zero places, rows of the context table.
DIM, PLACES, BUCKETS = 64, 4, 1 << 14
HIDDEN = 32
THRESHOLD = 0.7
#: Partitions of the training sample; each has one context table, added up in CHUNKS.
PARTS, CHUNKS = 8, 16
_SAME, _LOUD = np.uint64(0x5EED5A3E), np.uint64(0x10D)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of each document in order, and each one's document.

    Tokens are words (lower-cased) and runs of punctuation. A word of capitals is followed by a mark, and a word equal
    to the one before it stands as another mark.
    """
    kind = np.where(WORD[data], 1, np.where(SPACE[data], 0, 2)).astype(np.int8)
    at, size = runs(kind, offsets)
    h, doc = run_hashes(LOWER[data], at, size), np.searchsorted(offsets, at, "right") - 1
    if not len(h):
        return h, doc
    word = kind[at] == 1
    loud = word & (size > 1) & UPPER[data[at]] & UPPER[data[np.minimum(at + 1, len(data) - 1)]]
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    h = np.where(same, _SAME, h)
    order = np.argsort(np.concatenate([np.arange(len(h)) * 2, np.nonzero(loud)[0] * 2 + 1]), kind="stable")
    return np.concatenate([h, np.full(int(loud.sum()), _LOUD)])[order], np.concatenate([doc, doc[loud]])[order]


def index_vectors(h: np.ndarray) -> np.ndarray:
    """Sparse ternary vectors of DIM, a row for each hash, drawn from the hash."""
    out = np.zeros((len(h), DIM), np.float32)
    bits = mix(h)
    for j in range(PLACES):
        part = (bits >> np.uint64(16 * j)) & np.uint64(0xFFFF)
        np.add.at(out, (np.arange(len(h)), (part % np.uint64(DIM)).astype(np.int64)), np.where(part & np.uint64(0x8000), 1, -1).astype(np.float32))
    return out


def _bucket(h: np.ndarray) -> np.ndarray:
    return (mix(h + np.uint64(77)) % np.uint64(BUCKETS)).astype(np.int64)


def context_sums(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each bucket the sum of the index vectors of its words' neighbours."""
    out = np.zeros((BUCKETS, DIM), np.float32)
    if len(h) > 1:
        near = doc[1:] == doc[:-1]
        distinct, which = np.unique(h, return_inverse=True)
        vectors, b = index_vectors(distinct), _bucket(distinct)[which]
        for mine, other in ((b[:-1][near], which[1:][near]), (b[1:][near], which[:-1][near])):
            order = np.argsort(mine, kind="stable")
            mine, other = mine[order], other[order]
            first = np.nonzero(np.append(True, mine[1:] != mine[:-1]))[0] if len(mine) else np.zeros(0, np.int64)
            for low in range(0, len(first), 512):  # a part of the buckets at a time, for memory
                some = first[low : low + 512]
                end = first[low + 512] if low + 512 < len(first) else len(mine)
                out[mine[some]] += np.add.reduceat(vectors[other[some[0] : end]], some - some[0], axis=0)
    return out


def pooled(data: np.ndarray, offsets: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Features of each document: mean index vector, mean context vector, their norms, log of the token count."""
    h, doc = tokens(data, offsets)
    n_docs = len(offsets) - 1
    count = np.bincount(doc, minlength=n_docs).astype(np.float32)
    out = np.zeros((n_docs, 2 * DIM + 3), np.float32)
    if len(h):
        bits, flat = mix(h), np.zeros(n_docs * DIM)
        for j in range(PLACES):
            part = (bits >> np.uint64(16 * j)) & np.uint64(0xFFFF)
            flat += np.bincount(doc * DIM + (part % np.uint64(DIM)).astype(np.int64), np.where(part & np.uint64(0x8000), 1.0, -1.0), n_docs * DIM)
        out[:, :DIM] = flat.reshape(n_docs, DIM)
        key, times = np.unique(doc * BUCKETS + _bucket(h), return_counts=True)
        owner = key // BUCKETS
        first = np.nonzero(np.append(True, owner[1:] != owner[:-1]))[0]
        out[owner[first], DIM : 2 * DIM] = np.add.reduceat(context[key % BUCKETS] * times[:, None].astype(np.float32), first, axis=0)
    out[:, : 2 * DIM] /= np.maximum(count, 1)[:, None]
    out[:, -3] = np.linalg.norm(out[:, :DIM], axis=1)
    out[:, -2] = np.linalg.norm(out[:, DIM : 2 * DIM], axis=1)
    out[:, -1] = np.log1p(count)
    return out


@dataclass
class Model:
    context: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    @property
    def learned(self) -> bool:
        """Whether labelled rows were there to learn from."""
        return any(layer.any() for layer in self.layers)

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return (np.tanh(((x - self.mean) / self.scale) @ a + b) @ c + d)[:, 0] / self.temperature

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -60, 60)))


def train_network(x: np.ndarray, y: np.ndarray, steps: int = 1500, rate: float = 3e-3, decay: float = 1e-3, seed: int = 7) -> tuple:
    """Mean, scale and layers of a two-layer network, by Adam on mini-batches; then the temperature from held-back rows."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held, rest = order[: len(x) // 5], order[len(x) // 5 :]
    mean, scale = x[rest].mean(0), x[rest].std(0) + 1e-6
    z, t = (x[rest] - mean) / scale, y[rest]
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 1)), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, steps + 1):
        some = rng.integers(0, len(z), min(256, len(z)))
        u, k = z[some], t[some]
        hid = np.tanh(u @ p[0] + p[1])
        err = (1 / (1 + np.exp(-np.clip((hid @ p[2] + p[3])[:, 0], -60, 60))) - k)[:, None] / len(u)
        back = (err @ p[2].T) * (1 - hid**2)
        grads = [u.T @ back + decay * p[0], back.sum(0), hid.T @ err + decay * p[2], err.sum(0)]
        for i, g in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    logits = (np.tanh(((x[held] - mean) / scale) @ p[0] + p[1]) @ p[2] + p[3])[:, 0]
    loss = lambda temp: np.mean(np.logaddexp(0, -np.where(y[held] == 1, 1, -1) * logits / temp))
    temperature = min(np.geomspace(0.25, 8, 60), key=loss) if len(held) else 1.0
    return mean, scale, p, float(temperature)


def _features(context: np.ndarray):
    def run(batches):
        for b in batches:
            for first, last, data, offsets in blocks(b.column("text")):
                x = pooled(data, offsets, context.value)
                yield pa.RecordBatch.from_arrays([b.column("y").slice(first, last - first), pa.array([r.tobytes() for r in x], pa.binary())], ["y", "x"])

    return run


def _context(batches):
    total = np.zeros((BUCKETS, DIM), np.float32)
    for b in batches:
        for _, _, data, offsets in blocks(b.column("text")):
            total += context_sums(*tokens(data, offsets))
    step = BUCKETS // CHUNKS
    yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([total[i * step : (i + 1) * step].tobytes() for i in range(CHUNKS)], pa.binary())], ["chunk", "v"])


def _added(t: pa.Table) -> pa.Table:
    """The sum of one chunk's tables."""
    total = sum(np.frombuffer(v.as_py(), np.float32) for v in t.column("v"))
    return pa.table({"chunk": t.column("chunk").slice(0, 1), "v": pa.array([total.tobytes()], pa.binary())})


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from the texts of ``docs`` whose ``labels`` (doc_id, quality) have crc32(doc_id) mod 4 other than 2.

    At most about ``sample`` rows of each label are drawn, by a hash of their id. Labels of a repeated id count once,
    the larger; labels other than 0 and 1 and null ids don't count. Without labelled rows, every score is 0.5.
    """
    spark = docs.sparkSession
    own = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (doc_mod(F.col("doc_id"), 4) != 2))
    own = own.groupBy("doc_id").agg(F.max("quality").alias("y"))
    sizes = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}  # a row a label
    blank = Model(np.zeros((BUCKETS, DIM), np.float32), np.zeros(2 * DIM + 3), np.ones(2 * DIM + 3), [np.zeros((2 * DIM + 3, HIDDEN)), np.zeros(HIDDEN), np.zeros((HIDDEN, 1)), np.zeros(1)], 1.0)
    if not sizes:
        return blank
    share = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample / n))))
    unit = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    own = F.broadcast(own.where(unit < share[F.col("y")]))  # bounded by the sample
    rows = stored(bounded(docs).select("doc_id", "text").join(own, "doc_id").select(F.col("y").cast("double").alias("y"), "text").repartition(PARTS), "sample")
    parts = rows.select("text").coalesce(PARTS).mapInArrow(freed(_context), "chunk int, v binary").groupBy("chunk").applyInArrow(_added, "chunk int, v binary")
    table = {r["chunk"]: r["v"] for r in parts.collect()}  # one context table
    if not table:
        return blank
    context = np.frombuffer(b"".join(table[i] for i in range(CHUNKS)), np.float32).reshape(BUCKETS, DIM).copy()
    del table
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-6)
    shared = spark.sparkContext.broadcast(context)
    got = rows.mapInArrow(freed(_features(shared)), "y double, x binary").toArrow()  # bounded by the sample
    x, y = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, 2 * DIM + 3).astype(float), got.column("y").to_numpy()
    del got
    if not len(x):
        return blank
    order = np.lexsort(np.round(x[:, ::-1].T, 4))  # the same batches whatever order the rows come in
    mean, scale, layers, temperature = train_network(x[order], y[order])
    # The sample holds labels at other shares than the table: put the table's odds back.
    odds = [max(min(sizes.get(k, 0), sample), 1) / max(sizes.get(k, 0), 1) for k in (0, 1)]
    layers[3] = layers[3] + temperature * np.log(odds[0] / odds[1])
    return Model(context, mean, scale, layers, temperature)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """Add the score and whether it reaches ``threshold`` to ``docs`` under these names (all other columns stay). A null text counts as ''."""
    docs = docs.drop(score, predicted)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            out = np.zeros(len(b))
            for first, last, data, offsets in blocks(b.column("text")):
                out[first:last] = m.probability(pooled(data, offsets, m.context))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out), pa.array((out >= threshold).astype(np.int32))], [*b.schema.names, score, predicted])

    return bounded(docs).mapInArrow(freed(run), T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType()), T.StructField(predicted, T.IntegerType())]))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted. See ``fit`` and ``score``.

    Null ids and texts and repeated rows keep their rows; other columns are not read.
    """
    found = score(docs.select("doc_id", "text"), fit(docs, labels, sample))
    return found.select("doc_id", (doc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
