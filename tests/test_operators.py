"""DataFrame operators on hand-made rows."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.operators import batching, chat, evaluation, graph, groups, leaders, metrics, recognition, sampling, sets
from lodestone.sources import files
from lodestone.streaming import events


def test_sft_records(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 3, "user", "bye"), (2, 0, "assistant", "x"), (3, 0, "user", "only"), (4, 0, "user", "a"), (4, 1, "user", "b"), (4, 2, None, "c")]
    df = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")
    assert [(r.conv_id, [t.text for t in r.turns]) for r in chat.sft_records(df).collect()] == [(1, ["q", "a"])]


def test_group_filters(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 0.0), ("b", 1.0), ("c", 1.0), ("d", None), ("d", 1.0), ("d", 0.0)], "g string, r double")
    assert {r.g for r in groups.varied_groups(df, "g", "r").collect()} == {"b", "c", "d"}
    assert {r.g for r in groups.varied_groups(df, "g", "r", keep_singletons=False).collect()} == {"b", "d"}
    assert {r.g for r in groups.complete_varied_groups(df, "g", "r").collect()} == {"b"}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 500), min_size=1, max_size=40, unique=True))
def test_split_is_disjoint_and_whole(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys], "k int")
    shares = {"train": 80, "val": 15, "test": 5}
    one = {(r.k, r.split) for r in sampling.split(df.repartition(1), "k", shares).collect()}
    many = {(r.k, r.split) for r in sampling.split(df.repartition(7), "k", shares).collect()}
    assert one == many and {k for k, _ in one} == set(keys) and all(s for _, s in one)


def test_same_rows(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y")], "a int, b string")
    b = spark.createDataFrame([(None, "y"), (1.0, "x")], "p double, q string")
    assert sets.same_rows(a, b) and not sets.same_rows(a, b.limit(1)) and not sets.same_rows(a, a.select("a"))
    big = lambda n: spark.createDataFrame([(n,)], "n long")
    assert not sets.same_rows(big(2**53), big(2**53 + 1)) and sets.same_rows(big(2**53 + 1), big(2**53 + 1).select(F.col("n").cast("decimal(20,0)")))
    assert sets.same_rows(spark.createDataFrame([(True,)], "b boolean"), big(1)) and not sets.same_rows(spark.createDataFrame([("1.0",)], "b string"), big(1))


@pytest.mark.parametrize("segment", [1, 7, 25, 10_000])
def test_duration_batches_do_not_depend_on_segments(spark, segment):
    import random

    rnd = random.Random(12)
    rows = [(i, rnd.choice([0.1, 0.7, 1.3, 20.0, 0.0, rnd.random() * 30])) for i in range(180)] + [(900, 400.0), (901, 100.0), (902, 100.0), (903, None), (904, 0.3)]
    got = {r.k: (r.tile, r.batch) for r in batching.duration_batches(spark.createDataFrame(rows, "k int, d double"), "k", "d", 3, 100.0, segment).collect()}
    ordered = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    want, size = {}, -(-len(rows) // 3)
    for n, (k, d) in enumerate(ordered):
        if n % size == 0 or total + (d or 0) > 100.0:
            name, total = n + 1, 0.0
        total += d or 0
        want[k] = (n // size + 1, name)
    assert len(rows) % 3 in (0, 2) and (len(rows) % 3 == 0 or size * 3 - len(rows) == 1) and {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}


def test_runs_stop_when_enough_is_there(spark):
    groups = spark.createDataFrame([(k, k * 10 % 7, k % 2 == 0) for k in range(7)], "k int, done int, ok boolean")  # valid: 0 at 0, 2 at 6, 4 at 5, 6 at 4
    assert {r.k for r in batching.until_valid(groups, "k", "done", "ok", 2).collect()} == {0, 5, 3, 1, 6} - ({5, 3, 1} - {k for k in (5, 3, 1) if k * 10 % 7 <= 4})
    assert batching.until_valid(groups, "k", "done", "ok", 9).count() == 7
    rows = spark.createDataFrame([(b, 10 * b + i) for b in range(5) for i in range(b)], "b int, k int")
    assert sorted(r.k for r in batching.until_full(rows, "b", "k", 4, 5).collect()) == [10, 20, 21, 30]
    with pytest.raises(ValueError):
        batching.until_full(rows, "b", "k", 4, 2)


def test_unknown_roles_are_refused(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "tool", "x")], "conv_id int, turn int, role string, text string")
    assert chat.map_roles(turns.where("role = 'user'"), {"user": "User"}).first().role == "User"
    with pytest.raises(Exception, match="unknown role tool"):
        chat.map_roles(turns, {"user": "User"}).collect()


def test_similarity_edges_equal_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(60)] + [(70, None), (71, [0.0] * 6), (72, []), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows[:60]}
    want = set()
    for i in unit:
        later = sorted(((-float(unit[i] @ unit[j]), j) for j in unit if j > i and unit[i] @ unit[j] >= 0.2))[:3]
        want |= {(i, j) for w, j in later if -w >= 0.4}
    for block in (1000, 16):
        assert {(r.src, r.dst) for r in graph.similarity_edges(df, "id", "v", 0.2, 0.4, 3, block).collect()} == want


def test_median_of_positive_values(spark):
    df = spark.createDataFrame([(v,) for v in (5.0, -1.0, 1.0, 2.0, 9.0, None)], "v double")
    r = metrics.latency_stats(df, "v").first()
    assert (r.n, r.median, r.low, r.high, r.total) == (4, 3.5, 1.0, 9.0, 17.0)
    assert metrics.latency_stats(df.where("v > 100"), "v").first().median is None


def test_transcript_totals(spark):
    rows = spark.createDataFrame([(["a", "7", "東", "x"], ["a", "8", "x", "y"]), ([], ["new"]), (["gone"], [])], "ref array<string>, hyp array<string>")
    pairs = recognition.aligned_pairs(rows, "ref", "hyp")
    t = recognition.totals(pairs).first()
    assert (t.n, t.c, t.s, t.d, t.i, t.wer) == (5, 2, 1, 2, 2, 100.0)
    assert {r.script: (r.n, r.s, r.d, r.i) for r in recognition.by_script(pairs).collect()} == {"English": (3, 0, 1, 2), "Number": (1, 1, 0, 0), "Mandarin": (1, 0, 1, 0)}
    assert {r.word: (r.corr, r.tot_errs, r.in_ref, r.in_hyp) for r in recognition.by_word(pairs).collect()}["8"] == (0, 1, 0, 1)


def test_incomplete_transcripts_are_skipped(spark, tmp_path):
    (tmp_path / "x.txt").write_text("a:\tref=one\na:\thyp=two\nb:\tref=alone\nnoise\n")
    assert [tuple(r) for r in files.recognition_texts(spark, str(tmp_path)).collect()] == [("a", "one", "two")]


def test_evaluation_runs_each_pair_once(spark):
    tables = {"t": spark.range(3).toDF("x")}
    cases = [("a", "<answer>SELECT x FROM t</answer>", "SELECT x FROM t ORDER BY x DESC"), ("a", "<answer>SELECT x FROM t</answer>", "SELECT x FROM t ORDER BY x DESC"), ("b", "none", "SELECT 1"), ("c", "<answer>SELECT y FROM t</answer>", "SELECT z FROM t"), ("d", "<answer>SELECT x + 1 FROM t</answer>", "SELECT x FROM t")]
    got = evaluation.rewards(evaluation.evaluate(spark, cases, tables)).collect()
    assert [(r.sample_id, r.result, r.reward) for r in got] == [("a", "correct", 1.0), ("a", "correct", 1.0), ("b", "parse_error", -1.0), ("c", "correct", 0.0), ("d", "incorrect", 0.0)]


def test_leaders_depend_on_order(spark):
    rows = [("g", 1, [1.0, 0.0]), ("g", 2, [0.8, 0.6]), ("g", 3, [0.28, 0.96]), ("g", 4, None), ("h", 5, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "g string, k int, v array<double>")
    assert {r.k: r.leader for r in leaders.leaders(df, "g", "k", "v", 0.75).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_components(spark):
    nodes, edges = spark.range(1, 8), spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "src long, dst long")
    assert {r.id: r.component for r in graph.components(nodes, edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7}
    assert {r.id: r.hop for r in graph.within_hops(edges, 1, 1).collect()} == {1: 0, 2: 1}


def test_exclusive_percentiles(spark):
    import statistics

    values = [5.0, 1.0, 4.0, 9.0, 2.5]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 3.0), ("b", -1.0)], "g string, v double")
    got = {(r.g, r.p): r.value for r in metrics.exclusive_percentiles(df, "g", "v", [50, 99]).collect()}
    q = statistics.quantiles(values, n=100)
    assert got[("a", 50)] == pytest.approx(q[49]) and got[("a", 99)] == pytest.approx(q[98]) and got[("b", 99)] == 3.0


def test_run_numbers(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate("aabba")], "i int, c string")
    assert [r.run for r in groups.run_numbers(df, "i", "c").orderBy("i").collect()] == [0, 1, 0, 1, 0]


def test_sources(spark, tmp_path):
    import sqlite3

    import pyarrow as pa

    with sqlite3.connect(tmp_path / "u.db") as con:
        con.execute("create table users (name text, age int)")
        con.executemany("insert into users values (?, ?)", [("Alice", 25), ("Bob", 30), ("Charlie", 35)])
    spark.dataSource.register(files.SqliteQuery)
    df = spark.read.format("sqlite").schema("name string, age int").option("path", str(tmp_path / "u.db")).option("query", "select * from users where age > 26").load()
    assert sorted(r.name for r in df.collect()) == ["Bob", "Charlie"]
    t = pa.table({"a": [1, 2]})
    with pa.OSFile(str(tmp_path / "x.arrow"), "wb") as f, pa.ipc.new_file(f, t.schema) as w:
        w.write_table(t)
    assert files.load(spark, str(tmp_path / "x.arrow"), "a long").count() == 2
    with pytest.raises(ValueError):
        files.load(spark, "x.pickle")
    with pytest.raises(ValueError):
        files.load_all(spark, ["a.csv", "b.json"])


def test_session_replay_stream_equals_batch(spark, tmp_path):
    rows = [(1, 0, "hi"), (1, 1, "finish conversation"), (1, 2, "late"), (2, 0, "a"), (2, 1, "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "t"))
    batch = {tuple(r) for r in events.replay_sessions(df, 5, "finish conversation").collect()}
    stream = events.collect_stream(events.replay_sessions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "t")), 5, "finish conversation"), "update")
    assert batch == {(1, 2, "COMPLETED"), (2, 2, "RUNNING")} == {tuple(r) for r in stream.collect()}
