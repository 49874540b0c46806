"""Greedy leader clustering of groups of any size, by rounds of block products."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ordering import kept, row_numbers

#: Rows of a block: a task multiplies two blocks.
BLOCK = 1024
#: Similarities less than this below the threshold reach it, so that a product of blocks and one of two rows agree.
SLACK = 1e-12
_CANDIDATE, _BLOCKED, _MEMBER, _LEADER = 0, 1, 2, 3


def _gathered(rows: DataFrame) -> DataFrame:
    """One row a block: its rows' numbers, groups, flags and vectors, and how many rows it has."""
    row = F.array_sort(F.collect_list(F.struct("number", "gid", "first", "x")))
    rows = rows.groupBy("block").agg(row.alias("r"))
    return rows.select("block", F.size("r").alias("n"), *(F.col(f"r.{c}").alias(c) for c in ("number", "gid", "first")), F.flatten("r.x").alias("x"))


def _tiles(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of blocks, the left one not after the right one, that have a group in common."""
    of = lambda d, name: d.select(F.col("block").alias(name), F.explode(F.array_distinct("gid")).alias("gid"))
    return of(left, "one").join(of(right, "two"), "gid").where("one <= two").select("one", "two").distinct()


def _meet(left: DataFrame, right: DataFrame, step: Callable, result: str) -> DataFrame:
    """``step`` for each tile of blocks, dealt out over all tasks."""
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = lambda d, name: d.toDF(*(f"{name}_{c}" if c != "block" else name for c in d.columns))
    both = _tiles(left, right).repartition(tasks, "one", "two").join(named(left, "one"), "one").join(named(right, "two"), "two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                side = [{c: batch[f"{s}_{c}"].slice(i, 1).flatten().to_numpy(zero_copy_only=False) for c in ("number", "gid", "first", "x")} for s in ("one", "two")]
                for s in side:
                    s["x"] = s["x"].reshape(len(s["number"]), -1)
                same = batch["one"][i].as_py() == batch["two"][i].as_py()
                yield step(*side, same)

    return both.mapInArrow(run, result)


def _near(one: dict, two: dict, threshold: float) -> np.ndarray:
    """For each row of ``two``, which earlier rows of its group in ``one`` reach the threshold."""
    earlier = (one["number"][:, None] < two["number"]) & (one["gid"][:, None] == two["gid"])
    return earlier & (one["x"] @ two["x"].T >= threshold - SLACK)


def _state(threshold: float) -> Callable:
    """Rows that an open earlier row holds up. Rows of their group's first open block are scanned in order and so settled."""

    def step(one: dict, two: dict, same: bool) -> pa.RecordBatch:
        near = _near(one, two, threshold)
        if same:
            first = two["first"].astype(bool)
            state = np.where(first, _LEADER, np.where(near.any(0), _BLOCKED, _CANDIDATE))
            for j in np.nonzero(first & near.any(0))[0]:
                if (state[near[:, j]] == _LEADER).any():
                    state[j] = _MEMBER
        else:
            state = np.where(near.any(0), _BLOCKED, _CANDIDATE)
        keep = np.nonzero(state)[0]
        return pa.RecordBatch.from_arrays([pa.array(two["number"][keep]), pa.array(state[keep].astype(np.int32))], names=["number", "state"])

    return step


def _first_leader(threshold: float) -> Callable:
    def step(one: dict, two: dict, same: bool) -> pa.RecordBatch:
        near = _near(one, two, threshold)
        keep = np.nonzero(near.any(0))[0]
        return pa.RecordBatch.from_arrays([pa.array(two["number"][keep]), pa.array(one["number"][near[:, keep].argmax(0)])], names=["number", "leader"])

    return step


def leaders(rows: DataFrame, group: str, key: str, vector: str, threshold: float, block: int = BLOCK) -> DataFrame:
    """Greedy leader clustering within groups, in key order: (group, key, leader).

    A row joins the first earlier leader whose cosine is at least ``threshold``, else it leads. Rows whose vector is null, empty
    or zero lead themselves, as do rows that no earlier one of the same length comes near; a null group is a group; null keys
    come first, equal keys in the order of their vectors. An empty table gives an empty result.

    The result is that of a scan in order, found in rounds: an open row leads once no open earlier row of its group is near,
    and joins once a leader is. The first open block of each group is scanned in order, so a chain of rows, each near the one
    before, takes a round a block at most, and other data a few rounds. Products are of two blocks of rows; a group takes as
    many tasks as it has pairs of blocks.
    """
    of = rows.select(F.col(group).alias("group"), F.col(key).alias("key"), F.transform(vector, lambda x: x.cast("double")).alias("x"))
    size = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, x: s + x * x))
    unit = of.withColumn("size", size).withColumn("x", F.when(F.col("size") > 0, F.transform("x", lambda x: x / F.col("size")))).drop("size")
    # rows of other lengths are never near, so a length is part of the group
    unit = unit.withColumn("of", F.struct("group", F.size("x").alias("length")))
    numbered = row_numbers(unit, ["of", "key", "x"], "number")
    starts = numbered.groupBy("of").agg(F.min("number").alias("gid"))
    numbered = kept(numbered.join(starts, "of").withColumn("block", F.struct(F.size("x").alias("length"), F.floor(F.col("number") / block).alias("at"))).drop("of"))
    vectors = numbered.where("x is not null").select("number", "gid", "block", "x")
    open_, found = vectors, numbered.where("x is null").select("number")
    while not open_.isEmpty():
        firsts = open_.groupBy("gid").agg(F.min("block").alias("start"))
        marked = open_.join(firsts, "gid").withColumn("first", F.col("block") == F.col("start")).drop("start")
        blocks = kept(_gathered(marked))
        states = _meet(blocks, blocks, _state(threshold), "number bigint, state int").groupBy("number").agg(F.max("state").alias("state"))
        settled = kept(open_.join(states, "number", "left").withColumn("state", F.coalesce("state", F.lit(_LEADER))))
        new = settled.where(F.col("state") == _LEADER).drop("state")
        found = found.unionByName(new.select("number"))
        rest = settled.where(F.col("state") == _BLOCKED).drop("state").withColumn("first", F.lit(False))
        joined = _meet(_gathered(new.withColumn("first", F.lit(False))), _gathered(rest), _first_leader(threshold), "number bigint, leader bigint")
        open_ = kept(rest.drop("first").join(joined.select("number").distinct(), "number", "left_anti"))
    found = kept(found)
    split = vectors.join(found.withColumn("first", F.lit(True)), "number", "left").withColumn("first", F.coalesce("first", F.lit(False)))
    lead, other = kept(_gathered(split.where("first"))), kept(_gathered(split.where("not first")))
    joined = _meet(lead, other, _first_leader(threshold), "number bigint, leader bigint").groupBy("number").agg(F.min("leader").alias("leads"))
    out = numbered.select("number", "group", "key").join(joined, "number", "left").withColumn("leads", F.coalesce("leads", "number"))
    names = numbered.select(F.col("number").alias("leads"), F.col("key").alias("leader"))
    return out.join(names, "leads").select(F.col("group").alias(group), F.col("key").alias(key), "leader")
