"""Records, histories, batches, joins by place and files by name on awkward rows."""

import os

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import curation
from lodestone.sources import named


def test_reading_records(spark):
    rows = [(10, 10, '{"gt_parse": {"text_sequence": " hi "}}'), (0, 10, '{"gt_parse": {"text_sequence": "x"}}'), (10_000, 5_001, '{"gt_parse": {"text_sequence": "x"}}'), (1, 1, '{"gt_parse": {"text_sequence": 7}}'), (1, 1, '{"gt_parse": {}}'), (1, 1, "{'gt_parse'"), (1, 1, None), (None, 1, '{"gt_parse": {"text_sequence": "x"}}'), (1, 1, '{"gt_parse": {"text_sequence": " \\n"}}')]
    df = spark.createDataFrame(rows, "w int, h int, t string")
    got = [r[0] and [tuple(m) for m in r[0]] for r in df.select(curation.reading_record("Read.", F.col("w"), F.col("h"), F.col("t"))).collect()]
    assert got == [[("user", "Read."), ("assistant", "hi")]] + [None] * 8


def test_one_image_and_truth(spark):
    rows = [("q", "img", "4"), ("see <image 2>", "img", "4"), ("q", "img", None), (None, "img", "4"), ("q", None, "4")]
    df = spark.createDataFrame(rows, "q string, img string, truth string")
    p = curation.image_prompt(F.col("q"), "Think.", F.encode("img", "utf-8"), F.col("img"))
    got = df.withColumn("p", p).select(curation.one_image_and_truth(F.col("p.prompt"), F.col("truth")), F.size("p.images")).collect()
    assert [tuple(r) for r in got] == [(True, 1), (False, 1), (False, 1), (False, 1), (True, 0)]


def test_history_with_results(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "execution", '[{"a": "ä", "b": [1]}, 2]'), (1, 2, "execution", "no json"), (1, 3, "system", "left out"), (1, 4, "agent", None), (1, 5, "execution", "[]"), (2, 0, "execution", None)]
    got = {r.c: r.history for r in curation.history_with_results(spark.createDataFrame(rows, "c int, n int, s string, m string"), "c", "n", "s", "m").collect()}
    assert got == {1: 'user: hi\nexecution: {\n  "a": "ä",\n  "b": [\n    1\n  ]\n}\nexecution: 2\nexecution: no json\nagent: ', 2: ""}


def test_batches_and_places(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(20)], "i int, p int")
    assert sorted(r.i for r in curation.aligned(rows, "p", ["i"], 3, 2).collect()) == list(range(6))
    with pytest.raises(ValueError, match="3 of 4"):
        curation.aligned(rows, "p", ["i"], 4, 2)
    other = spark.createDataFrame([(chr(97 + i),) for i in range(20)], "c string")
    assert [tuple(r) for r in curation.zipped(rows.select("i"), ["i"], other, ["c"]).orderBy("i").limit(2).collect()] == [(0, "a"), (1, "b")]
    with pytest.raises(ValueError, match="20 and 19"):
        curation.zipped(rows, ["i"], other.where("c <> 'a'"), ["c"])
    asked = spark.createDataFrame([(0,), (19,), (20,), (-1,), (None,), (0,)], "at int")
    assert sorted((r["at"], r.c) for r in curation.looked_up(asked, "at", other, ["c"]).collect()) == [(0, "a"), (0, "a"), (19, "t")]


def test_most_common(spark):
    rows = spark.createDataFrame([("b", 1), ("a", 1), ("a", None), ("b", 2), ("c", 3), (None, 3)], "x string, y int")
    assert sorted(map(tuple, curation.most_common(rows, ["x", "y"], 2).collect())) == [("x", "a", 2), ("x", "b", 2), ("y", "1", 2), ("y", "3", 2)]
    assert curation.most_common(rows.limit(0), ["x"]).collect() == []


def test_advice(spark):
    df = spark.createDataFrame([(0.95, 0.9), (0.5, 0.5), (None, 0.9)], "run double, good double")
    reasons, say = curation.advice({c: F.col(c) for c in ("run", "good")}, {"run": 0.9, "good": 0.8}, {"run": "r", "good": "g"}, {"good": "more"})
    assert [tuple(r) for r in df.select(reasons, say).collect()] == [([], []), (["run", "good"], ["r", "g", "more"]), ([], [])]


def test_think_and_boxes(spark):
    texts = ["<think>a</think><answer>b", "<think>a</think>", "<think>a</think><answer><|begin_of_box|>", "</think><think><answer><|end_of_box|><|begin_of_box|>", "", None]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tx.think_answer_boxes(F.col("t"))).collect()] == [True, False, False, True, False, None]


def test_files_by_name(spark, tmp_path):
    source, target = str(tmp_path / "a"), str(tmp_path / "b")
    rows = spark.createDataFrame([("x.json", '{"s": 5}'), ("y.json", '{"s": 3}'), ("z.json", "broken"), ("n.json", None), ("t.json", '{"s": "text"}'), ("w.txt", '{"s": 9}')], "name string, content string").repartition(3)
    named.write_files(rows, source)
    assert sorted(os.listdir(source)) == ["n.json", "t.json", "w.txt", "x.json", "y.json", "z.json"]
    named.copy_above(spark, source, target, "s", 4.0)
    assert os.listdir(target) == ["x.json"] and (tmp_path / "b" / "x.json").read_text() == '{"s": 5}'
    with pytest.raises(Exception, match="one name"):
        named.write_files(rows.union(rows.limit(1)), str(tmp_path / "c"))
    with pytest.raises(Exception, match="no name"):
        named.write_files(spark.createDataFrame([("../x", "y")], "name string, content string"), str(tmp_path / "d"))
    assert not os.listdir(tmp_path / "c") and not os.listdir(tmp_path / "d")
