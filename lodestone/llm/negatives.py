"""Hard negatives by a block product of whole-number vectors.

Rows are cut into blocks and blocks into chunks of components. A pair of an anchor block and a row block is a tile; each chunk
gives a partial tile of integer products, which are shuffled to the tile and added there. A tile keeps the best few rows of
each anchor (first its positives, then the rows in each positive's window), and what the tiles keep is reduced the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import discard, stored
from lodestone.llm.vectors import whole_vectors
from lodestone.operators.ordering import row_numbers

SCALE, POSITIVES, NEGATIVES = 256, 5, 5
#: Anchors and rows of a tile, and components of a chunk: a partial tile takes 2 MB.
ANCHORS, ROWS, CHUNK = 256, 1024, 32
#: At most so many chunks, as a tile's parts are added in one task.
CHUNKS = 8
#: Stands for a null id, so that these come last among equal scores; and for a score that does not count.
_NO_ID, _NONE = np.iinfo(np.int64).max, -np.iinfo(np.int64).max
_META = "struct<row:array<bigint>,id:array<bigint>,label:array<bigint>>"


def _blocks(rows: DataFrame, place: str, size: int, chunk: int) -> DataFrame:
    """Blocks of ``size`` rows by their ``place`` from 1: block, k, what its rows are, and the k-th chunk of their components."""
    place = F.floor((F.col(place) - 1) / size).cast("long")
    cuts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("x") / chunk).cast("int"), F.lit(1)) - 1), lambda k: F.struct(k.alias("k"), F.slice("x", k * chunk + 1, chunk).alias("c")))
    each = rows.select(place.alias("block"), "row", "id", "label", F.explode(cuts).alias("cut")).select("block", F.col("cut.k").alias("k"), F.struct("row", "id", "label", F.col("cut.c").alias("c")).alias("r"))
    gathered = each.groupBy("block", "k").agg(F.array_sort(F.collect_list("r")).alias("r"))
    return gathered.select("block", "k", F.struct(*(F.col(f"r.{c}").alias(c) for c in ("row", "id", "label"))).alias("meta"), F.flatten("r.c").alias("x"))


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A tile's products over one chunk, as bytes of int64."""
    for batch in batches:
        for at in range(batch.num_rows):
            one = batch.slice(at, 1)
            a, b = (one[c].flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(one[n][0].as_py(), -1) for c, n in (("ax", "an"), ("bx", "bn")))
            exact = a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) < 1 << 53
            tile = (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if exact else a @ b.T
            yield pa.RecordBatch.from_arrays([*(one[c] for c in ("i", "j", "a", "b", "windows")), pa.array([tile.tobytes()], pa.binary())], names=["i", "j", "a", "b", "windows", "tile"])


def _first(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, top: np.ndarray, low: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of each line of ``scores`` the first ``k`` from ``top`` down to ``low``, equal ones by id: (line, score, id, row)."""
    order = np.lexsort((rows, ids))
    scores = scores[:, order]
    ranked = np.argsort(-scores, axis=1, kind="stable")
    at = (scores > top[:, None]).sum(1)[:, None] + np.arange(k)
    inside = at < scores.shape[1]
    col = np.take_along_axis(ranked, np.minimum(at, scores.shape[1] - 1), 1)
    value = np.take_along_axis(scores, col, 1)
    line, rank = np.nonzero(inside & (value >= low[:, None]))
    col = order[col[line, rank]]
    return line, value[line, rank], ids[col], rows[col]


def _reduced(positives: bool, k: int) -> Callable:
    """All partial tiles of a tile to the best rows of each anchor; with windows, of each anchor and positive."""

    def tile(table: pa.Table) -> pa.Table:
        meta = next(r for r in table.select(["a", "b", "windows"]).to_pylist() if r["a"] is not None)
        (arow, aid, alabel), (brow, bid, blabel) = ([np.array(meta[s][c], np.int64) for c in ("row", "id", "label")] for s in ("a", "b"))
        score = np.zeros(len(arow) * len(brow), np.int64)
        for part in table["tile"]:
            score += np.frombuffer(part.as_buffer(), np.int64)
        score = score.reshape(len(arow), -1)
        same = alabel[:, None] == blabel
        if positives:
            score[~same | (arow[:, None] == brow)] = _NONE
            line, s, found, _ = _first(score, bid, brow, np.full(len(arow), -_NONE), np.full(len(arow), _NONE + 1), k)
            return pa.table({"anchor": arow[line], "anchor_id": aid[line], "n": pa.nulls(len(line), pa.int64()), "id": found, "score": s})
        score[same] = _NONE
        windows = meta["windows"]
        line = np.searchsorted(arow, np.array([w["anchor"] for w in windows], np.int64))
        top, n = (np.array([w[c] for w in windows], np.int64) for c in ("score", "n"))
        which, s, found, _ = _first(score[line], bid, brow, top, -(-4 * top // 5), k)
        return pa.table({"anchor": arow[line[which]], "anchor_id": aid[line[which]], "n": n[which], "id": found, "score": s})

    return tile


def _tiles(pairs: DataFrame, anchors: DataFrame, rows: DataFrame, windows: DataFrame | None, k: int) -> DataFrame:
    """What the tiles of ``pairs`` (i, j) keep: anchor, anchor_id, n (number of the positive), id, score."""
    if windows is None:
        left = anchors.withColumn("windows", F.lit(None).cast("array<struct<anchor:bigint,n:bigint,score:bigint>>"))
    else:
        left = anchors.join(windows, "block")
    first = lambda c: F.when(F.col("k") == 0, F.col(c))  # noqa: E731  what a tile's rows are goes along with its first chunk only
    left = left.select(F.col("block").alias("i"), "k", first("meta").alias("a"), first("windows").alias("windows"), F.col("x").alias("ax"), F.size("meta.row").alias("an"))
    right = rows.select(F.col("block").alias("j"), "k", first("meta").alias("b"), F.col("x").alias("bx"), F.size("meta.row").alias("bn"))
    # a number of partitions given here is kept: Spark would join few bytes in few tasks, but a tile is larger than what makes it
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    meet = left.join(pairs, "i").repartition(tasks, "j", "k").join(right.repartition(tasks, "j", "k"), ["j", "k"])
    kinds = f"i bigint, j bigint, a {_META}, b {_META}, windows array<struct<anchor:bigint,n:bigint,score:bigint>>, tile binary"
    parts = meet.select("i", "j", "a", "b", "windows", "ax", "bx", "an", "bn").mapInArrow(_partial, kinds)
    return parts.groupBy("i", "j").applyInArrow(_reduced(windows is None, k), "anchor bigint, anchor_id bigint, n bigint, id bigint, score bigint")


def _best(found: DataFrame, keys: list[str], k: int, rank: str) -> DataFrame:
    """The first ``k`` of each key by score and id; Spark cuts each task's rows before it shuffles them."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id"))
    return found.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def mine(rows: DataFrame, anchor: Column, id: str = "id", label: str = "label", vector: str = "x", positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: the hard negatives of each row where ``anchor`` holds.

    ``rows`` has an id and a label (long) and whole components (array<int>). A row's score is its product with the anchor;
    higher ones come first, equal ones by id, null ids last. An anchor's positives are its first ``positives`` other rows of
    its label; a positive's negatives are the first ``negatives`` rows of other labels whose score is at most the positive's
    and at least four fifths of it. Rows without label take no part, nor do those whose vector is not as long as that of the
    least id. Rows are told apart by their place, so a copy of an anchor is another row, and a repeated anchor has its results
    twice. An empty table, or none with an anchor, gives an empty result.

    Rows are numbered by label and id and cut into blocks in that order, so positives are sought only in tiles whose blocks
    share a label, and negatives in all but those of one and the same label. Anchors' blocks travel to rows' blocks; a tile is
    as large for any label, however frequent. Products grow with anchors times rows, as exact search asks for.
    """
    rows = rows.select(F.coalesce(F.col(id), F.lit(_NO_ID)).alias("id"), F.col(label).alias("label"), F.col(vector).alias("x"), F.coalesce(anchor, F.lit(False)).alias("is_anchor")).where("label is not null")
    least = rows.orderBy("id", "x").select(F.size("x").alias("n")).first()
    dims = least["n"] if least else 0
    chunk = max(CHUNK, -(-dims // CHUNKS))
    rows = row_numbers(rows.where(F.size("x") == dims).withColumn("copy", F.monotonically_increasing_id()), ["label", "id", "copy"], "row").drop("copy")
    chosen = row_numbers(rows.where("is_anchor"), ["row"], "place")
    spark = rows.sparkSession
    right = stored(_blocks(rows, "row", ROWS, chunk), "rows")
    left = stored(_blocks(chosen, "place", ANCHORS, chunk), "anchors")

    def labels(blocks: DataFrame, name: str) -> DataFrame:
        return blocks.where("k = 0").select(F.col("block").alias(name), F.array_distinct("meta.label").alias("labels"))

    li, lj = labels(left, "i"), labels(right, "j")
    shared = li.select("i", F.explode("labels").alias("label")).join(lj.select("j", F.explode("labels").alias("label")), "label").select("i", "j").distinct()
    kept = stored(_tiles(shared, left, right, None, positives), "positives-of-tiles")
    best = stored(_best(kept, ["anchor"], positives, "place").select("anchor", "anchor_id", F.col("place").cast("long").alias("n"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    one = lambda d: d.where(F.size("labels") == 1).withColumn("label", F.col("labels")[0]).drop("labels")
    last = (right.agg(F.max("block")).first()[0] or 0) if dims else 0
    grid = li.select("i", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("j")).select("i", F.col("j").cast("long").alias("j"))
    grid = grid.join(one(li).join(one(lj), "label").select("i", "j"), ["i", "j"], "left_anti")
    window = F.struct("anchor", "n", F.col("positive_score").alias("score"))
    of = left.where("k = 0").select("block", F.explode("meta.row").alias("anchor"))
    windows = best.join(of, "anchor").groupBy("block").agg(F.collect_list(window).alias("windows"))
    found = stored(_best(_tiles(grid, left, right, windows, negatives), ["anchor", "n"], negatives, "rank").select("anchor", "n", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), "negatives")
    for table in (kept, right, left):
        discard(table)
    known = lambda c: F.when(F.col(c) != _NO_ID, F.col(c)).alias(c)
    return found.join(best, ["anchor", "n"]).select(known("anchor_id"), known("positive_id"), F.col("rank").cast("int").alias("rank"), known("negative_id"), "positive_score", "negative_score")


def hard_negatives(embeddings: DataFrame, every: int = 100, noisy: int = 7, labels: int = 10) -> DataFrame:
    """Hard negatives of the rows whose vec_id is divisible by ``every``; where divisible by ``noisy``, the label first becomes the next of ``labels``.

    Rows with a null label, a null vector, or null or non-finite components take no part; other columns are not read.
    """
    rows = whole_vectors(embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("x")), "x", SCALE)
    rows = rows.withColumn("label", F.when(F.coalesce(F.col("id") % noisy == 0, F.lit(False)), (F.col("label") + 1) % labels).otherwise(F.col("label")))
    return mine(rows, F.col("id") % every == 0)


ORACLE = """
WITH r AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score FROM r a JOIN r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 5"""
