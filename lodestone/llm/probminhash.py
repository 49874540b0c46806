"""Near-duplicate detection: ProbMinHash signatures of weighted word shingles, banding and verification.

Each distinct shingle, weighted by its count, is a Poisson process of arrivals at the signature's components; a
component keeps the shingle of its first arrival, and a shingle stops once no component can wait for it any more. Two
signatures agree in a component with the probability Jaccard similarity of the texts. With weights of one they agree
with the Jaccard similarity of the sets; a text is signed and banded both ways, as either similarity makes it near.

Equal texts are one node. In each bucket of each band, nodes are compared with one leader only, the node that meets
most others in all buckets: in a family of copies that is one near their origin. Each node is first compared with its
best leader. Buckets whose nodes are in several components after that are compared in blocks inside a task, each pair
in the first bucket that it shares, signatures first and shingles where these come near; only links leave it. So groups
of near copies never expand into all their pairs, yet no pair of a bucket is passed over but by its signatures.
Components, fingerprints and links stay distributed throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import bounded, discard, freed, small, spread_join, stored
from lodestone.llm.textblocks import blocks, mix, shingles, weighted, word_hashes

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 7
#: Rows of Arrow batches that carry shingle sets.
BATCH = 64
#: Pairs whose signatures agree by this much less than the threshold are compared exactly: four standard deviations.
MARGIN = 0.1
#: Nodes of a bucket that one task compares with as many others; members that meet one copy of a leader's shingles.
BLOCK = 512
#: A text is signed a second time, as a set, if its repetitions are more than this share of its shingles. With fewer in
#: both texts, the probability Jaccard is within 0.03 of the sets' Jaccard, which bands and MARGIN allow for.
REPEATS = 0.015


def signatures(items: np.ndarray, owner: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """ProbMinHash signatures, a row for each document; all 0 for one without items."""
    q = np.full(n_docs * m, np.inf)
    sig = np.zeros(n_docs * m, np.uint64)
    alive = np.arange(len(items))
    time = np.zeros(len(items))
    step, wide = 0, 1
    with np.errstate(over="ignore"):
        while len(alive):
            x, w = items[alive], weight[alive]
            # The next arrivals of each process: exponential gaps of rate w, each at a uniformly drawn component.
            count = np.arange(step, step + wide, dtype=np.uint64)
            seed = mix(x[:, None] + (count + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            unit = ((seed >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)
            at = time[alive][:, None] + np.cumsum(-np.log(unit), axis=1) / w[:, None]
            slot = owner[alive][:, None] * m + (mix(seed) % np.uint64(m)).astype(np.int64)
            better = at < q[slot]
            flat, when = slot[better], at[better]
            np.minimum.at(q, flat, when)
            won = q[flat] == when
            sig[flat[won]] = np.broadcast_to(x[:, None], slot.shape)[better][won]
            time[alive] = at[:, -1]
            last = q.reshape(n_docs, m).max(axis=1)
            alive = alive[time[alive] < last[owner[alive]]]
            step += wide
            if step >= 4:
                wide = min(2 * wide, 256)
    return sig.reshape(n_docs, m)


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        parts = mix(sig.reshape(len(sig), bands, rows) + np.arange(1, rows + 1, dtype=np.uint64))
        out = np.zeros((len(sig), bands), np.uint64)
        for j in range(rows):
            out = mix(out + parts[:, :, j])
        return out


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> tuple[float, float]:
    """Probability Jaccard of two weighted sets (sorted items) and the Jaccard of the sets without weights."""
    both, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0, 0.0
    plain = len(both) / (len(a) + len(b) - len(both))
    only_a, only_b = wa.sum() - wa[ia].sum(), wb.sum() - wb[ib].sum()
    pairs, n = np.unique(np.stack([wa[ia], wb[ib]], 1), axis=0, return_counts=True)
    total = 0.0
    for (x, y), k in zip(pairs, n, strict=True):
        total += k / (only_a / x + only_b / y + (n * np.maximum(pairs[:, 0] / x, pairs[:, 1] / y)).sum())
    return float(total), plain


def _weights(column: pa.Array):
    """Distinct shingles with counts for each run of rows: (first, last, items, owner, counts)."""
    for first, last, data, offsets in blocks(column):
        yield first, last, *weighted(*shingles(*word_hashes(data, offsets), WORDS))


def _signed(items: np.ndarray, owner: np.ndarray, n: np.ndarray, n_docs: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of counted shingles and of their sets, (document, 2, component); and which texts have two of their own."""
    both = np.repeat(signatures(items, owner, n.astype(np.float64), n_docs, m)[:, None], 2, axis=1)
    size, total = np.bincount(owner, minlength=n_docs), np.bincount(owner, n, n_docs)
    two = total - size > REPEATS * size
    repeats = np.nonzero(two)[0]
    if len(repeats):
        mine = two[owner]
        both[repeats, 1] = signatures(items[mine], np.searchsorted(repeats, owner[mine]), np.ones(int(mine.sum())), len(repeats), m)
    return both, two


def _bands(bands: int, rows: int):
    """Hashes of the bands of a text's signatures, those of the counted shingles first; a repeated text of a batch has null."""

    def run(batches):
        for b in batches:
            node = b.column("node").dictionary_encode()
            first_at = np.full(len(node.dictionary), -1)
            place = node.indices.to_numpy()
            first_at[place[::-1]] = np.arange(len(b))[::-1]
            own = pa.array(np.sort(first_at))
            texts = b.column("text").take(own)
            lists, counts = [], np.zeros(len(texts), np.int64)
            for first, last, items, owner, n in _weights(texts):
                sig, two = _signed(items, owner, n, last - first, bands * rows)
                hashes = band_hashes(sig.reshape(-1, bands * rows), bands, rows).reshape(last - first, -1)
                has = np.zeros(last - first, bool)
                has[owner] = True
                keep = np.zeros(hashes.shape, bool)
                keep[has, :bands] = True
                keep[has & two, bands:] = True
                lists.append(hashes[keep])
                counts[first:last] = has * bands * (1 + two)
            flat = pa.array((np.concatenate(lists) if lists else np.zeros(0, np.uint64)).view(np.int64), pa.int64())
            signed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), flat)
            where = np.full(len(b), -1)
            where[np.sort(first_at)] = np.arange(len(texts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("node"), signed.take(pa.array(where, mask=where < 0))], ["doc_id", "node", "bands"])

    return run


def _sets(m: int):
    """For each node its signatures, a byte a component, and its shingles with counts."""

    def run(batches):
        for b in batches:
            for first, last, items, owner, n in _weights(b.column("text")):
                both, two = _signed(items, owner, n, last - first, m)
                sig = (mix(both) & np.uint64(255)).astype(np.uint8)
                at = np.searchsorted(owner, np.arange(last - first + 1))
                for low in range(0, last - first, BATCH):
                    high = min(low + BATCH, last - first)
                    part = slice(at[low], at[high])
                    lists = [pa.ListArray.from_arrays(pa.array((at[low : high + 1] - at[low]).astype(np.int32)), pa.array(v[part])) for v in (items.view(np.int64), n.astype(np.int32))]
                    marks = pa.array([x[: 1 + t].tobytes() for x, t in zip(sig[low:high], two[low:high], strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([b.column("node").slice(first + low, high - low), marks, *lists], ["node", "sig", "items", "counts"])

    return run


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The larger similarity by both signatures of bytes, equal bytes by chance taken off."""
    return ((a == b).mean(axis=-1).max(axis=-1) - 1 / 256) / (1 - 1 / 256)


class _Lists:
    """Shingles with counts of each row of a batch, without copies."""

    def __init__(self, b, items: str = "items", counts: str = "counts"):
        x, y = b.column(items), b.column(counts)
        if isinstance(x, pa.ChunkedArray):
            x, y = x.combine_chunks(), y.combine_chunks()
        self.at, self.x, self.y = x.offsets.to_numpy(), x.values.to_numpy().view(np.uint64), y.values.to_numpy()
        self.at_y = y.offsets.to_numpy()

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.x[self.at[i] : self.at[i + 1]], self.y[self.at_y[i] : self.at_y[i + 1]]


def _marks(column, m: int) -> np.ndarray:
    """Signatures as bytes, (text, 2, component); of a text with one, that twice."""
    rows = [x if len(x) > m else x + x for x in column.to_pylist()]
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), 2, -1)


def _compare(threshold: float, m: int):
    def run(batches):
        for b in batches:
            if not len(b):
                continue
            one, two = _Lists(b), _Lists(b, "items2", "counts2")
            near = agreement(_marks(b.column("sig"), m), _marks(b.column("sig2"), m)) >= threshold - MARGIN
            ok = pa.array([bool(near[i]) and max(probability_jaccard(*one[i], *two[i])) >= threshold for i in range(len(b))], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], ["a", "b"])

    return run


def _within(threshold: float, bands: int, m: int):
    """Links between components inside a bucket (or two blocks of it), each pair of components once.

    A pair is left to the first bucket that it shares. Nodes that meet many others go first, so components grow soon.
    """

    def hashes(column) -> np.ndarray:
        """For each node the hashes of its bands by both signatures: (2, node, band)."""
        rows = [np.asarray(x, np.int64) for x in column.to_pylist()]
        return np.stack([[r[:bands] for r in rows], [r[-bands:] for r in rows]]).astype(np.int64)

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(-t.column("met").to_numpy(), kind="stable")))
        nodes, sig, sets = t.column("node").to_pylist(), _marks(t.column("sig"), m), _Lists(t)
        side, band, value = t.column("part").to_numpy(), t.column("band")[0].as_py(), t.column("hash")[0].as_py()
        names = {c: i for i, c in enumerate(dict.fromkeys(t.column("component").to_pylist()))}
        comp = np.array([names[c] for c in t.column("component").to_pylist()])
        same = bool((side == side[0]).all())
        own = hashes(t.column("bands"))
        out = []
        for i in range(len(nodes)):
            rest = np.arange(i + 1, len(nodes))
            rest = rest[(comp[rest] != comp[i]) & (same | (side[rest] != side[i]))]
            if not len(rest):
                continue
            equal = [a[i] == b[rest] for a in own for b in own]
            shared = equal[0] | equal[1] | equal[2] | equal[3]
            first = shared.argmax(axis=1) == band
            # Two hashes of one band may both be shared: the least counts.
            least = np.min([np.where(e[:, band], a[i, band], np.iinfo(np.int64).max) for e, a in zip(equal, (own[0], own[0], own[1], own[1]), strict=True)], axis=0)
            rest = rest[first & (least == value)]
            rest = rest[agreement(sig[rest], sig[i]) >= threshold - MARGIN]
            for j in rest.tolist():
                if comp[j] != comp[i] and max(probability_jaccard(*sets[i], *sets[j])) >= threshold:
                    out.append((nodes[i], nodes[j]))
                    comp[comp == comp[j]] = comp[i]
        return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())})

    return run


def links(pairs: DataFrame, sets: DataFrame, m: int, threshold: float = SIMILARITY) -> DataFrame:
    """Of ``pairs`` (a, b) those that are similar by their ``sets`` (node, sig, items, counts): (a, b), stored.

    Similar: probability Jaccard of counted shingles, or Jaccard of the sets, of at least ``threshold``. The shingles of
    a node that is ``b`` of many pairs go to several places, with BLOCK of its pairs each.
    """
    hot = pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("places")).where(F.col("places") > 1)
    hot = small(stored(hot, "hot"))
    dealt = pairs.join(hot, "b", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("a"), F.col("places")).cast("int"), F.lit(0)).alias("place"))
    heads = sets.withColumnRenamed("node", "b").join(hot, "b", "left").withColumn("place", F.explode(F.sequence(F.lit(0), F.coalesce("places", F.lit(1)) - 1)))
    heads = heads.select("b", "place", *(F.col(c).alias(f"{c}2") for c in ("sig", "items", "counts")))
    beside = dealt.join(sets.withColumnRenamed("node", "a"), "a").join(heads, ["b", "place"])
    return stored(beside.mapInArrow(freed(_compare(threshold, m)), "a binary, b binary"), "links")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): (node, component), the least node of each; by labels that also jump."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("component").alias("near"))
        step = stored(labels.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("was")), "step")
        if step.where(F.col("component") != F.col("was")).isEmpty():
            discard(step)
            return labels
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("to"))
        before, labels = labels, stored(step.join(jump, "component").select("node", F.col("to").alias("component")), "labels")
        discard(before)
        discard(step)


def _node():
    """The node of a row: a digest of its text; a null text is a node of its own with its id, a byte longer than digests."""
    own = F.concat(F.unhex(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))), F.unhex(F.lit("00")))
    return F.coalesce(F.unhex(F.md5(F.col("text").cast("binary"))), own)


def classes(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, threshold: float = SIMILARITY) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, class_id, class_size, representative.

    Documents with equal texts, or linked by texts of similarity ``threshold`` or more, directly or through others,
    are one class; ``class_id`` is its least doc_id (null if it has none). ``representative`` marks one row of each
    class: that of the least doc_id, of repeated rows the one of the least text hash (all of them, if they are equal
    in both). A text of fewer than five words is one shingle; one without words is only equal to equal texts. A null
    text is a class of its own with its doc_id. Other columns are not read.
    """
    return _classes(docs, bands, rows, threshold).drop("node")


def _classes(docs: DataFrame, bands: int, rows: int, threshold: float) -> DataFrame:
    rows_in = bounded(docs).select("doc_id", "text", _node().alias("node"))
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("node binary, bands array<long>").fields])
    signed = stored(rows_in.mapInArrow(freed(_bands(bands, rows)), schema), "signed")
    nodes = stored(signed.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.first("bands", ignorenulls=True).alias("bands")), "nodes")
    buckets = nodes.select("node", "bands", F.posexplode("bands").alias("at", "hash")).where((F.col("at") < bands) | (F.col("hash") != F.get("bands", F.col("at") - bands)))
    buckets = buckets.select("node", (F.col("at") % bands).alias("band"), "hash")
    shared = stored(buckets.groupBy("band", "hash").agg(F.count("*").alias("n")).where(F.col("n") > 1), "shared")
    members = stored(buckets.join(small(shared), ["band", "hash"]), "members")
    met = stored(members.groupBy("node").agg(F.sum("n").alias("met")), "met")
    heads = members.join(met, "node").groupBy("band", "hash").agg(F.max(F.struct("met", "node")).alias("head"))
    star = members.join(heads, ["band", "hash"]).where(F.col("node") != F.col("head.node"))
    first = stored(star.groupBy(F.col("node").alias("a")).agg(F.max("head").alias("m")).select("a", F.col("m.node").alias("b")), "first")
    # The text of a node is that of its row with the least doc_id.
    wanted = stored(met.join(nodes.select("node", "least"), "node").select("node", "least"), "wanted")
    mine = rows_in.alias("d").join(small(wanted).alias("w"), (F.col("d.node") == F.col("w.node")) & F.col("d.doc_id").eqNullSafe(F.col("w.least"))).select("d.node", "d.text")
    sets = stored(mine.dropDuplicates(["node"]).mapInArrow(freed(_sets(bands * rows)), "node binary, sig binary, items array<long>, counts array<int>"), "sets")

    found = links(first, sets, bands * rows, threshold)
    part = components(found)
    # What is left: buckets whose nodes are still in several components.
    placed = members.join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("band", "hash").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where(F.col("low") != F.col("high"))
    mixed = stored(mixed.select("band", "hash", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "mixed")
    rest = placed.drop("n").join(small(mixed), ["band", "hash"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("band", "hash", "node", "component", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    rest = rest.join(sets, "node").join(met, "node").join(nodes.select("node", "bands"), "node")
    more = stored(rest.groupBy("band", "hash", "low", "high").applyInArrow(_within(threshold, bands, bands * rows), "a binary, b binary").distinct(), "found")
    part = components(found.unionByName(more))

    placed = nodes.join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
    groups = placed.groupBy("component").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"), F.min(F.when(F.col("least").isNotNull(), F.struct("least", "node"))).alias("top"), F.min("node").alias("any"))
    placed = placed.join(groups, "component").select("node", "class_id", "class_size", F.coalesce("top.node", "any").alias("top"))
    several = stored(placed.where(F.col("class_size") > 1), "classes")
    out = spread_join(signed.select("doc_id", "node"), several, "node", ["doc_id"])
    mine = F.col("top").isNull() | ((F.col("node") == F.col("top")) & F.col("doc_id").eqNullSafe(F.col("class_id")))
    return out.select("doc_id", "node", F.when(F.col("top").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), mine.alias("representative"))



def representatives(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, threshold: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` for each class of ``classes``, all columns; of rows equal in id and text, any one."""
    found = _classes(docs, bands, rows, threshold).where("representative").groupBy("doc_id", "node").agg(F.count("*").alias("n"))
    found = stored(found, "representatives")
    # A row travels as one value, so that no column of it meets a name used here.
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    keyed = docs.select(row, F.col("doc_id").alias("id"), _node().alias("of")).alias("d")

    def among(some: DataFrame) -> DataFrame:
        some = small(some).alias("r")
        return keyed.join(some, (F.col("d.of") == F.col("r.node")) & F.col("d.id").eqNullSafe(F.col("r.doc_id")), "left_semi")

    out, several = among(found.where(F.col("n") == 1)), found.where(F.col("n") > 1)
    if not several.isEmpty():
        out = out.unionByName(among(several).dropDuplicates(["of"]))
    return out.select("row.*")
