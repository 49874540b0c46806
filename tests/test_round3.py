"""What the third round's findings named, on small inputs."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions import align, formulas, plugins
from lodestone.functions import text as tx
from lodestone.functions.vectors import rounded
from lodestone.operators import graph, nearness, sets, tiles
from lodestone import plans  # noqa: F401  registers the queries
from lodestone.plans import registry


def tables(spark, folder, **rows):
    """Tables of a folder of their own; each is (rows, schema)."""
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_batches_of_one_share_an_arrow_batch(spark):
    """Small batches for the client are no small batches for Spark."""

    class Rows:
        schema = spark.createDataFrame([], "prompt string").schema

        def mapInArrow(self, run, schema):
            return run

    def client(prompts):
        if "7" in prompts:
            raise RuntimeError("refused")
        return [p * 2 for p in prompts] if "8" not in prompts else []

    run = plugins.complete(Rows(), "prompt", client, batch=1)
    (got,) = run(iter([pa.RecordBatch.from_pydict({"prompt": [*map(str, range(3000)), None]})]))
    assert got.num_rows == 3001 and got["response"].to_pylist()[6:10] == ["66", "", "", "99"] and got["response"][3000].as_py() == ""
    assert got["error"].to_pylist()[6:10] == [None, "refused", "0 responses to 1 prompts", None]
    df = spark.createDataFrame([(1, "a"), (2, "7"), (3, None)], "id int, prompt string")
    assert sorted(tuple(r) for r in plugins.complete(df, "prompt", client, batch=1).collect()) == [(1, "a", "aa", None), (2, "7", "", "refused"), (3, None, "", None)]


def test_conversations_of_a_system_turn_only(spark, tmp_path):
    turns = [(5, 0, "system", "s"), (5, 1, "user", "q"), (6, 0, "system", "s"), (6, 1, "user", "q"), (7, 0, "assistant", "a")]
    folder = tables(spark, tmp_path, conversations=(turns, "conv_id long, turn int, role string, text string"))
    assert sorted(tuple(r) for r in registry.QUERIES["sft_valid_turns"](spark, folder).collect()) == [(6, True, 1), (7, False, 1)]


def test_transcripts_without_ascii_letters_are_in_capitals(spark):
    df = spark.createDataFrame([("é ñí, ß.",), ("a é",), ("<sil>ü",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.normalise_transcript(F.col("t"))).collect()] == ["ÉÑÍSS", "AÉ", "Ü", "", None]


def test_groups_behind_four_digits():
    assert formulas.equal("1002,000", "1002000") and formulas.equal("-1002,000", "-1002000") and formulas.equal("1,002,000", "1002000")
    assert not formulas.equal("(1002,000)", "1002000") and not formulas.equal("1002,00", "100200") and formulas.equal("1002, 3", "1002,3")


def test_users_numbered_as_places_are_apart(spark, tmp_path):
    """User 1000 goes to place 1012, and user 1012 to 1011: no way from one place to another."""
    rows = [(60.0, 1000), (1.0, 1012), (1.0, 12)]
    folder = tables(spark, tmp_path, events=(rows, "value double, user_id long"))
    got = sorted(tuple(r) for r in registry.QUERIES["graph_edge_kinds"](spark, folder).collect())
    assert got == [("strong", 1, 1, 4, 2, False), ("weak", 2, 2, 4, 2, False)]


def vectors(spark, n=60, dims=4):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=dims).astype(np.float32).tolist(), 0) for i in range(n)] + [(n, None, 0), (n + 1, [0.0] * dims, 0), (n + 2, [], 0)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def plain(a, b):
    """The cosine as the SQL adds it up."""
    total = one = two = 0.0
    for x, y in zip(a, b, strict=True):
        total, one, two = total + x * y, one + x * x, two + y * y
    return total / math.sqrt(one * two)


def plain_edges(rows, floor):
    return {(i, j) for n, (i, v, _) in enumerate(rows[:-3]) for j, w, _ in rows[n + 1 : -3] if plain(v, w) >= floor}


def test_cosines_are_added_up_in_order(spark):
    rows, df = vectors(spark, dims=64)
    got = {(r.src, r.dst): r.cosine for r in graph.cosines_within(df, "label", "vec_id", "embedding", 16).collect() if r.dst < 60}
    assert got == {(i, j): plain(v, w) for n, (i, v, _) in enumerate(rows[:60]) for j, w, _ in rows[n + 1 : 60]}
    values = spark.createDataFrame([(0.1234565,), (-0.5,), (2.5,), (None,)], "x double").select(rounded(F.col("x"), 0)).collect()
    assert [r[0] for r in values] == [0.0, -1.0, 3.0, None]


def test_a_cosine_below_the_threshold_is_no_pair(spark):
    """0.6 exactly is one, a little less is none."""
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [3.0, 4.0]), (3, [3.0, -4.000000001])], "id long, v array<double>")
    assert [(r.a, r.b) for r in nearness.near_pairs(df, "id", "v", 0.6)[0].collect()] == [(1, 2)]


@pytest.mark.parametrize("most", [7, 1 << 15])
def test_links_and_hops_are_those_of_all_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(tiles, "SMALL", 16)
    rows, df = vectors(spark)
    edges = plain_edges(rows, 0.6)
    links, count = tiles.linked(df, "vec_id", "embedding", 0.6, most)
    assert count.first().edges == len(edges)
    near = {i: {j for e in edges for j in e if i in e and j != i} for i in range(63)}
    def reach(i, hops):
        seen = {i: 0}
        for hop in range(1, hops + 1):
            seen |= {j: hop for k in list(seen) if seen[k] == hop - 1 for j in near[k] if j not in seen}
        return seen
    ids = df.select(F.col("vec_id").alias("id"))
    assert {r.id: r.component for r in graph.components(ids, links).collect()} == {i: min(reach(i, 63)) for i in range(63)}
    assert {r.id: r.hop for r in tiles.within_hops(df, "vec_id", "embedding", 7, 0.6, 3, most).collect()} == reach(7, 3)


def test_all_edges_count_not_a_rows_nearest_ones(spark, tmp_path):
    """15 equal vectors: 105 edges, though none has more than 10 of its own among the nearest."""
    folder = tables(spark, tmp_path, embeddings=([(i, [1.0, 2.0], 0) for i in range(15)], "vec_id long, embedding array<float>, label int"))
    got = registry.QUERIES["graph_stats"](spark, folder).first()
    assert (got.nodes, got.edges, got.components, got.largest) == (15, 105, 1, 15)


def test_steps_of_alignments_come_in_small_batches(monkeypatch):
    """What is held of many alignments is a few thousand steps, not all of a batch of rows."""
    monkeypatch.setattr(align, "STEPS", 100)
    words = [[f"w{i}" for i in range(n)] for n in (30, 0, 80, 5, 40, 0)]
    batch = pa.RecordBatch.from_pydict({"k": [1, 2, 3, 4, 5, 6], "_ref": words, "_hyp": [["x", *w[1:]] for w in words]})
    got = list(align.steps(["k"])(iter([batch])))
    assert [b.num_rows for b in got] == [111, 46]
    assert sum(b["op"].to_pylist().count("cor") for b in got) == 151 and {k for b in got for k in b["k"].to_pylist()} == {1, 2, 3, 4, 5, 6}


def test_edits_are_those_of_the_alignment(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "c", "d"]), ([], []), (None, ["a"]), (["a"], None)], "a array<string>, b array<string>")
    a = align.aligned("a", "b")
    got = df.select(align.edits("a", "b").alias("n"), (a["sub"] + a["ins"] + a["del"]).alias("m")).collect()
    assert [(r.n, r.m) for r in got] == [(2, 2), (0, 0), (1, 1), (1, 1)]


def test_rows_compared_by_one_task_do_not_grow(spark, monkeypatch):
    seen, sides = [], sets._sides
    monkeypatch.setattr(sets, "PART_ROWS", 100, raising=False)
    monkeypatch.setattr(sets, "_sides", lambda *args: seen.append(sides(*args)) or seen[-1])
    rows = lambda *skip: spark.range(2000).where(~F.col("id").isin(*skip)).select((F.col("id") % 50).alias("k"), "id")
    copies = spark.range(3000).select(F.lit(50).cast("long").alias("k"), F.lit(1).cast("long").alias("id"))
    got = {r.k: r.equal for r in sets.same_rows_by(rows(-1).union(copies), rows(7, 1008).union(copies.limit(1)), ["k"]).collect()}
    assert got == {k: k not in (7, 8) for k in range(51)}
    assert max(r["count"] for r in seen[0].groupBy(F.spark_partition_id()).count().collect()) <= 200
