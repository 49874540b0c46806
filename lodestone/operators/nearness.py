"""All pairs of vectors above a cosine, where blocks that can't reach it never meet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import tiles
from lodestone.operators.ordering import kept, row_numbers

#: Vectors of a block; pivots, each a vector of the table; blocks whose bounds are compared at once.
BLOCK, PIVOTS, BOUNDS = 512, 32, 2048
#: Angles are widened by this, so that rounding never rules out a pair.
SLACK = 1e-9


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1.0, 1.0))


def _unit(x: pa.Array, dims: int) -> np.ndarray:
    v = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _placed(pivots: np.ndarray, dims: int):
    """The pivot that each vector is nearest to, and its angle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                angles = _angles(_unit(b["x"], dims), pivots)
                near = angles.argmin(1)
                yield pa.RecordBatch.from_arrays([b["id"], b["x"], pa.array(near.astype(np.int32)), pa.array(angles[np.arange(len(near)), near])], names=["id", "x", "pivot", "angle"])

    return run


def _bounded(pivots: np.ndarray, dims: int):
    """Add a block's least and largest angle to every pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                angles = _angles(_unit(b["x"].slice(i, 1), dims), pivots)
                yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in b.columns), pa.array([angles.min(0).tolist()], pa.list_(pa.float64())), pa.array([angles.max(0).tolist()], pa.list_(pa.float64()))], names=[*b.schema.names, "low", "high"])

    return run


def _apart(low: np.ndarray, high: np.ndarray, low2: np.ndarray, high2: np.ndarray) -> np.ndarray:
    """By how much two blocks' angles to some pivot differ at least."""
    gap = np.zeros((len(low), len(low2)))
    for p in range(low.shape[1]):
        np.maximum(gap, np.maximum(low[:, p, None] - high2[:, p], low2[:, p] - high[:, p, None]), out=gap)
    return gap


def _reaching(limit: float):
    """How many pairs of blocks the bounds don't keep apart: by any pivot, the gap of their angles is at most the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                (ids, low, high), (ids2, low2, high2) = ([np.array(b[s][i].as_py()[c]) for c in ("block", "low", "high")] for s in ("a", "b"))
                met = (_apart(low, high, low2, high2) <= limit + SLACK) & (ids[:, None] <= ids2)
                yield pa.RecordBatch.from_arrays([pa.array([int(met.sum())])], names=["met"])

    return run


def _multiplied(threshold: float, limit: float, dims: int):
    """Pairs that reach the threshold, of the blocks of two sides (or of one with itself) that the bounds don't keep apart."""

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        ids = [t["id"].combine_chunks().flatten() for t in (one, two)]
        if len(one) and len(two):
            blocks = [t["block"].to_numpy() for t in (one, two)]
            sizes = [t["id"].combine_chunks().value_lengths().to_numpy() for t in (one, two)]
            begins = [np.append(0, np.cumsum(s)) for s in sizes]
            bounds = [t[c].combine_chunks().flatten().to_numpy().reshape(len(t), -1) for t in (one, two) for c in ("low", "high")]
            met = _apart(*bounds) <= limit + SLACK
            same = one["i"][0] == one["j"][0]
            if same:
                met &= blocks[0][:, None] <= blocks[1]
            a, b = (tiles.Side(t["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)) for t in (one, two))
            place = [np.arange(len(i)) - np.repeat(g[:-1], s) for i, g, s in zip(ids, begins, sizes, strict=True)]
            for r in range(len(one)):
                cols = np.nonzero(np.repeat(met[r], sizes[1]))[0]
                low = begins[0][r]
                x, y = np.nonzero(a.unit[low : begins[0][r + 1]] @ b.unit[cols].T >= threshold - a.slack)
                x, y = x + low, cols[y]
                if same:  # in a block with itself each pair once
                    own = np.nonzero(blocks[1] == blocks[0][r])[0]
                    inside = (y >= begins[1][own[0]]) & (y < begins[1][own[0] + 1])
                    once = ~inside | (place[0][x] < place[1][y])
                    x, y = x[once], y[once]
                w = tiles.exact(a, b, x, y)
                keep = w >= threshold
                out.append((x[keep], y[keep], w[keep]))
        x, y, w = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"a": ids[0].take(pa.array(x)), "b": ids[1].take(pa.array(y)), "cosine": pa.array(w, pa.float64())})

    return run


def near_pairs(vectors: DataFrame, key: str, vector: str, threshold: float, block: int = BLOCK, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """((a, b, cosine) of all pairs of rows whose cosine is at least ``threshold``, (blocks, pairs, met): how many block pairs were formed).

    Each pair is there once, the smaller key as ``a``; equal keys of different rows are pairs too. Rows without key, or whose
    vector is null, zero or not as long as most rows' first in order, have no pair; components must be finite. A table
    without such rows has no pair and no block.

    Rows are dealt to the nearest of ``pivots`` rows (a bounded sample by hash of the key), and cut into blocks by their
    angle to it, so blocks hold vectors of one direction. For each block the least and largest angle to every pivot are
    known. By the triangle inequality of angles two vectors are no nearer than their angles to a pivot differ, so blocks
    whose bounds lie further apart than the threshold's angle are not multiplied. The result is that of all pairs.

    A task has two sides of many blocks each, and compares bounds and vectors of all of them: a block is shipped to as many
    tasks as there are sides, not to one for each block that it meets.
    """
    unit = tiles.usable(vectors, key, vector).select("id", F.col("v").alias("x"))
    spark = vectors.sparkSession
    sizes = unit.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    kind = unit.schema["id"].dataType.simpleString()
    if sizes is None:
        return spark.createDataFrame([], f"a {kind}, b {kind}, cosine double"), spark.createDataFrame([(0, 0, 0)], "blocks long, pairs long, met long")
    dims = sizes["n"]
    unit = unit.where(F.size("x") == dims)
    chosen = np.array([r["x"] for r in unit.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()], float)
    chosen /= np.linalg.norm(chosen, axis=1, keepdims=True)
    wide = unit.schema["x"].dataType.simpleString()
    placed = unit.mapInArrow(_placed(chosen, dims), f"id {kind}, x {wide}, pivot int, angle double")
    rows = row_numbers(placed, ["pivot", "angle", "id"], "number").select("id", "x", "pivot", F.floor((F.col("number") - 1) / block).alias("at"))
    # a block is of one pivot: rows of the next one begin a new block
    row = F.struct("id", "x")
    blocks = rows.groupBy("pivot", "at").agg(F.collect_list(row).alias("r")).select(F.col("at") * pivots + F.col("pivot") % pivots, F.col("r.id"), F.flatten("r.x")).toDF("block", "id", "x")
    blocks = kept(blocks.mapInArrow(_bounded(chosen, dims), f"block bigint, id array<{kind}>, x {wide}, low array<double>, high array<double>"))
    bounds = row_numbers(blocks.select("block", "low", "high"), ["block"], "number")
    chunk = bounds.groupBy(F.floor((F.col("number") - 1) / BOUNDS).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("block", "low", "high"))).alias("r"))
    chunk = chunk.select("chunk", F.struct(*(F.col(f"r.{c}").alias(c) for c in ("block", "low", "high"))).alias("b"))
    n = blocks.count()
    last = (n - 1) // BOUNDS
    left = chunk.select(F.col("chunk").alias("i"), F.col("b").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(last))).alias("j"))
    limit = float(np.arccos(min(1.0, max(-1.0, threshold))))
    met = left.join(chunk.withColumnRenamed("chunk", "j"), "j").where("i <= j").select("a", "b").mapInArrow(_reaching(limit), "met bigint")
    k = tiles.sides(n * block)
    dealt = blocks.withColumn("at", F.pmod(F.xxhash64("block"), F.lit(k)).cast("int"))
    one = dealt.withColumn("i", F.col("at")).withColumn("j", F.explode(F.sequence("i", F.lit(k - 1))))
    two = dealt.withColumn("j", F.col("at")).withColumn("i", F.explode(F.sequence(F.lit(0), "j")))
    one, two = (tiles.by_tile(d, ["block", "id", "x", "low", "high", "i", "j"], ["i", "j"], k * (k + 1) // 2) for d in (one, two))
    pairs = one.cogroup(two).applyInArrow(_multiplied(threshold, limit, dims), f"a {kind}, b {kind}, cosine double")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine")
    return pairs, met.agg(F.sum("met").alias("met")).select(F.lit(n).cast("long").alias("blocks"), F.lit(n * (n + 1) // 2).cast("long").alias("pairs"), "met")
