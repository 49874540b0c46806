"""Sinks, table functions, sketches, alias tables, nearness, sound and phrases against plain counterparts."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import calls, phrases, sound
from lodestone.operators import graph, nearness, sketches
from lodestone.sources import arrays


def test_json_arrays(spark, tmp_path):
    path = str(tmp_path / "a")
    df = spark.range(500).selectExpr("id", "concat('ä\"\n', id) AS s", "cast(null AS int) AS n", "array(id, null) AS l")
    kinds = "id long, s string, n int, l array<long>"
    arrays.write_json_arrays(df.repartition(3), path, 2_000)
    rows = lambda: sorted(map(str, arrays.read_json_arrays(spark, path, kinds).collect()))
    want = sorted(map(str, df.collect()))
    assert rows() == want and len(os.listdir(path)) > 4
    with pytest.raises(Exception, match="stop here"):
        arrays.write_json_arrays(spark.range(0, 100, 1, 4).selectExpr("if(id = 77, raise_error('stop here'), id) AS id"), path)
    assert rows() == want  # the manifest of before still counts
    arrays.write_json_arrays(df.limit(2), path, append=True)
    assert len(rows()) == 502
    arrays.write_json_arrays(df.where("id < 0"), path)
    assert rows() == []
    with pytest.raises(Exception):
        arrays.read_json_arrays(spark, str(tmp_path / "none"), "id long")


def test_tool_calls_as_a_table(spark):
    calls.register(spark)
    rows = [(1, 'x {"name":"f","arguments":{"a":"q","n":3.0,"b":true}} {"name":"g","arguments":{"n":"no","b":1}} {bad'), (2, None), (3, '{"outer": {"name": "h", "arguments": {"a": [1], "n": 99999999999999999999}}}'), (4, '{"name": " ", "arguments": {}} {"name": "k"}'), (5, "")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = spark.sql("SELECT id, c.* FROM {t} t, LATERAL tool_calls(t.text, 'a string, n long, b boolean') c", t=df).collect()
    assert sorted(map(tuple, got), key=str) == [(1, 0, "f", "q", 3, True), (1, 1, "g", None, None, None), (3, 0, "h", "[1]", None, None), (4, 0, "k", None, None, None)]
    assert spark.sql("SELECT * FROM tool_calls('', '')").columns == ["place", "name"]
    with pytest.raises(Exception, match="no argument of a call"):
        spark.sql("SELECT * FROM tool_calls('x', 'a blob')")


def test_sketches_of_runs(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(k, rnd.gauss(0, 1) * 10**k, rnd.randrange(3000)) for k in (1, 2) for _ in range(6000)] + [(3, 1.0, 1), (4, None, None), (None, 2.0, 2)]
    df = spark.createDataFrame(rows, "k int, v double, item int")
    path = str(tmp_path / "s")
    for run in range(3):
        part = df.where(F.pmod(F.xxhash64("v", "item"), F.lit(3)) == run)
        for _ in range(1 + (run == 1)):  # a run that is stored twice counts once
            sketches.append_run(sketches.sketched(part, ["k"], "v", "item"), path, f"r{run}")
    got = {r.k: r for r in sketches.merged(spark, path, ["k"]).select("k", "n", *(sketches.quantile(F.col("quantiles"), p).alias(f"q{p}".replace(".", "")) for p in (0.05, 0.5, 0.99)), sketches.distinct(F.col("distinct")).alias("d")).where("k is null or k <> 4").collect()}
    for k in (1, 2):
        values = sorted(v for g, v, _ in rows if g == k)
        for p, name in ((0.05, "q005"), (0.5, "q05"), (0.99, "q099")):
            rank = np.searchsorted(values, got[k][name], "right") / len(values)
            assert abs(rank - p) <= sketches.RANK_ERROR * 2
        items = len({i for g, _, i in rows if g == k})
        assert abs(got[k].d - items) <= 4 * sketches.DISTINCT_ERROR * items and got[k].n == 6000
    assert (got[3].q05, got[3].d, got[None].n) == (1.0, 1, 1)
    assert sum(r.n for r in sketches.merged(spark, path, ["k"], ["r0"]).collect()) < 12_003


def test_alias_slots():
    rng = np.random.default_rng(1)
    for weights in (rng.random(300), np.ones(7), np.array([1e-12, 1.0, 5.0]), np.array([3.0]), rng.pareto(1.0, 1000) + 1e-9):
        share, other = graph.alias_slots(weights.copy())
        p = np.bincount(np.arange(len(share)), share, len(share)) + np.bincount(other, 1 - share, len(share))
        assert np.allclose(p / len(share), weights / weights.sum(), atol=1e-12)


def test_walks_draw_by_weight(spark):
    """5,000 walkers step to a hub and on to one of 20 leaves; its many tables (8 neighbours each) don't show."""
    starts = spark.range(1000, 6000).toDF("id")
    edges = spark.createDataFrame([(0, i, float(i)) for i in range(1, 21)] + [(0, 21, 0.0), (0, 22, None), (None, 3, 1.0)], "src long, dst long, weight double")
    edges = edges.unionByName(starts.select("id", F.lit(0).cast("long"), F.lit(1e-9)).toDF("src", "dst", "weight"))
    walk = graph.random_walks(edges, starts, 2, restart=0.0, table=8)
    seen = {r.id: r["count"] for r in walk.where("step = 2").groupBy("id").count().collect()}
    want = {i: 5000 * i / 210 for i in range(1, 21)}
    assert sum(seen.values()) == 5000 and set(seen) <= set(want) and sum((seen.get(i, 0) - n) ** 2 / n for i, n in want.items()) < 43.8  # one in a thousand
    assert {r.id for r in walk.where("step = 1").select("id").distinct().collect()} == {0}


def test_walkers_without_neighbours_stay(spark):
    edges = spark.createDataFrame([(1, 2, 1.0)], "src long, dst long, weight double")
    starts = spark.createDataFrame([(1,), (9,), (None,)], "id long")
    got = {(r.start, r.step, r.id) for r in graph.random_walks(edges, starts, 2, restart=0.0).collect()}
    assert got == {(1, 0, 1), (1, 1, 2), (1, 2, 1), (9, 0, 9), (9, 1, 9), (9, 2, 9), (None, 0, None)}


def test_near_pairs_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8)) * 3
    vectors = [(i, (centres[i % 12] + rng.normal(size=8) * 0.4).tolist()) for i in range(360)]
    vectors += [(400, vectors[0][1]), (400, vectors[0][1]), (None, vectors[1][1]), (401, None), (402, [0.0] * 8), (403, [1.0]), (404, [])]
    pairs, blocks = nearness.near_pairs(spark.createDataFrame(vectors, "id long, v array<double>"), "id", "v", 0.9, block=16, pivots=12)
    rows = [(i, np.array(v) / np.linalg.norm(v)) for i, v in vectors if i is not None and v and len(v) == 8 and any(v)]
    want = sorted((min(i, j), max(i, j)) for n, (i, x) in enumerate(rows) for j, y in rows[n + 1 :] if x @ y >= 0.9 - 1e-9)
    assert sorted((r.a, r.b) for r in pairs.collect()) == want and len(want) > 1000
    seen = blocks.first()
    assert seen.met < seen.pairs / 3  # blocks of other directions never met
    nothing, none = nearness.near_pairs(spark.createDataFrame([], "id long, v array<double>"), "id", "v", 0.9)
    assert nothing.collect() == [] and none.first().blocks == 0


@pytest.mark.parametrize("rate, to", [(16_000, 22_050), (22_050, 16_000), (8_000, 16_000), (48_000, 16_000), (7, 3)])
def test_resampling_keeps_level_and_pitch(rate, to):
    tone = lambda n, r: 0.5 * np.sin(2 * np.pi * 0.05 * min(rate, to) * np.arange(n) / r)
    got = sound.resample(tone(4000, rate), rate, to)
    inner = slice(len(got) // 6, -(len(got) // 6))
    assert len(got) == -(-4000 * to // rate) and np.abs(got - tone(len(got), to))[inner].max() < 1e-4
    if to < rate:  # what the new rate can't hold is not folded down
        high = np.sin(2 * np.pi * 0.62 * to * np.arange(4000) / rate) if 0.62 * to < rate / 2 else np.zeros(4000)
        assert np.abs(sound.resample(high, rate, to))[inner].max() < 1e-3


def test_resampling_of_odd_rows(spark):
    rows = [([], 8, 16), (None, 8, 16), ([1.0, None, 1.0], 8, 8), ([0.5], 8, 24), ([1.0], None, 8)]
    got = [r[0] for r in spark.createDataFrame(rows, "x array<double>, r int, t int").select(sound.resampled("x", "r", "t")).collect()]
    assert got[:3] == [[], None, [1.0, 0.0, 1.0]] and len(got[3]) == 3 and got[4] is None


def plain_rewrite(table, text):
    out, i = "", 0
    while i < len(text):
        p = max((p for p in table if p and text.startswith(p, i)), key=len, default=None)
        out, i = (out + table[p], i + len(p)) if p else (out + text[i], i + 1)
    return out


def test_phrases_leftmost_longest(spark):
    rnd = random.Random(2)
    for _ in range(500):
        table = {"".join(rnd.choice("ab") for _ in range(rnd.randrange(5))): str(i) for i in range(rnd.randrange(6))}
        text = "".join(rnd.choice("abc") for _ in range(rnd.randrange(20)))
        assert phrases.Automaton(table).rewrite(text) == plain_rewrite(table, text)
    texts = spark.createDataFrame([("漢字abcabd",), (None,), ("",), ("xyz" * 5000,)], "t string")
    table = spark.createDataFrame([("漢字", "汉字"), ("abcab", "1"), ("bc", "2"), ("abd", "3"), ("", "no"), (None, "no"), ("xyz", None), ("bc", "9")], "p string, r string")
    assert [r[0] for r in texts.select(phrases.rewriter(table, "p", "r")(F.col("t"))).collect()] == ["汉字1d", None, "", ""]
    assert [r[0] for r in texts.select(phrases.rewriter(table.limit(0), "p", "r")(F.col("t"))).collect()][:3] == ["漢字abcabd", None, ""]


@pytest.mark.parametrize("block", [1024, 7])
def test_cosines_within_groups(spark, block):
    rng = np.random.default_rng(5)
    rows = [("ab"[i % 2], i, rng.normal(size=4).tolist()) for i in range(50)] + [("a", 90, [0.0] * 4), ("a", 91, None), ("b", 92, []), (None, 93, [1.0] * 4), ("b", None, [1.0] * 4), ("c", 94, [1.0] * 4), ("a", 95, [1.0])]
    got = {(r.src, r.dst): r.cosine for r in graph.cosines_within(spark.createDataFrame(rows, "g string, k long, v array<double>"), "g", "k", "v", block).collect()}
    unit = {k: (g, np.array(v) / (np.linalg.norm(v) or 1)) for g, k, v in rows if v and len(v) == 4 and g and k is not None}
    want = {(i, j): float(unit[i][1] @ unit[j][1]) for i in unit for j in unit if i < j and unit[i][0] == unit[j][0]}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want)
