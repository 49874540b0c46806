"""Scalar functions on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import align, jsons, rewards, vectors
from lodestone.functions import text as tx


def one(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in rows.select("i", f(F.col("v")).alias("r")).orderBy("i").collect()]


def test_formats(spark):
    texts = [
        "<think>a</think>\n<answer>1</answer>", "<think>123</think><think>123</think><answer>456</answer>", "<think> </think><answer>1</answer>",
        "x<think>a</think><answer>1</answer>", "", None,
    ]
    assert one(spark, texts, tx.think_answer_format) == [True, False, False, False, False, None]
    assert one(spark, ["<THINK>a</THINK> b", "<think>a</think> "], tx.thinking_then_content) == [True, False]
    good = "<think>a</think><tool_response>r</tool_response> <think>b</think><answer>SELECT 1</answer>"
    assert one(spark, [good, good.replace("<think>b</think>", "")], tx.tool_answer_format) == [True, False]


def test_numbers_lose_all_their_commas(spark):
    long = ",".join(["123"] * 80)
    assert one(spark, [long, "1,x", "(1,2)", ",5"], tx.normalise_answer) == ["123" * 80, "1,x", "(1,2)", "5"]


def test_characterised(spark):
    texts = ["Hi, 東京は<tag x>ok! a>b", "é-a ß", "<open tag", "", None, "don't stop\u00a0now"]
    want = [["Hi,", "東", "京", "は", "<tag", "x>ok!", "a>b"], ["é-a", "ß"], ["<open", "tag"], [], [], ["don't", "stop", "now"]]
    assert one(spark, texts, align.characterised) == want


def test_last_boxed_closes_its_own_brace(spark):
    texts = ["\\boxed{a}} \\boxed{b{c}d} }", "\\boxed{open", "} \\boxed{x}", "\\fbox{1} \\boxed{2}"]
    assert one(spark, texts, jsons.last_boxed_balanced) == ["\\boxed{b{c}d}", None, "\\boxed{x}", "\\boxed{2}"]


def test_answers(spark):
    assert one(spark, ["\\boxed{1} and \\boxed{\\frac{1}{2}}", "none"], tx.last_boxed) == ["\\frac{1}{2}", ""]
    assert one(spark, ["\\boxed{42}", "\\fbox{3}"], tx.remove_boxed) == ["42", None]
    assert one(spark, ["x = 1,000 dollars", "\\frac12", "$3$", "\\text{cat}", "an 7 units"], tx.normalise_answer) == ["1000", "\\frac{1}{2}", "3", "cat", "7"]
    assert one(spark, ["\\boxed{a{b{c}}}", "\\boxed 42$ x", "\\fbox{3}", "no", None], jsons.last_boxed_balanced) == ["\\boxed{a{b{c}}}", "\\boxed 42", "\\fbox{3}", None, None]


def test_sql_text(spark):
    assert one(spark, ["select\n 1", "a;", " "], tx.clean_sql) == ["select 1;", "a;", ""]
    assert one(spark, ["SELECT (1", "WITH x AS (SELECT 1) SELECT 1", "select 'a"], tx.sql_valid) == [False, False, False]
    assert one(spark, ["WITH x AS (SELECT 1) SELECT 1"], lambda c: tx.sql_valid(c, allow_cte=True)) == [True]
    assert one(spark, ["a <answer> SELECT 1 </answer>", "<answer>1</answer><answer>2</answer>", "<answer><think>x</think></answer>"], tx.sql_answer) == ["SELECT 1", None, None]


def test_json(spark):
    call = '{"name": "f", "arguments": {"a": "}"}}'
    texts = [f"say {{}} {call} end", "```json\n[1]\n```", "plain", None]
    assert one(spark, texts, jsons.extract_json) == [call, "[1]", "plain", None]
    found = one(spark, [f"[{call}, {call}]", '{"name": " ", "arguments": {}}', "x", None], jsons.tool_calls)
    assert [len(f) for f in found] == [1, 0, 0, 0]


def test_rewards(spark):
    assert one(spark, [5000, 7620, 20000], rewards.length_reward, "int") == pytest.approx([-0.3, 0.0, 0.3])
    assert one(spark, [100, 900, 1000], lambda c: rewards.overlong_penalty(c, 1000, 200), "int") == pytest.approx([0, -0.5, -1])
    assert one(spark, [0, 1, 4], lambda c: rewards.pass_at_k(F.lit(4), c, 2), "int") == pytest.approx([0, 0.5, 1])


def test_vectors(spark):
    rows = [([1.0, 0.0], [1.0, 1.0]), ([0.0], [1.0]), (None, [1.0]), ([1.0], [1.0, 2.0])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a array<double>, b array<double>")
    got = [r[0] for r in df.orderBy("i").select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([2**-0.5, 0, 0, 0])
    import statistics

    values = sorted([3.0, 9.5, 1.25, 7.0, 7.0, 2.0, 11.0])
    df = spark.createDataFrame([(values,)], "a array<double>")
    assert df.select(vectors.exclusive_percentile(F.col("a"), 90)).first()[0] == pytest.approx(statistics.quantiles(values, n=100)[89])


def test_alignment():
    a = align.align(list("kitten"), list("sitting"))
    assert (a["all"], a["cor"], a["sub"], a["ins"], a["del"]) == (6, 4, 2, 1, 0)
    for ref, hyp in (("ab", "ba"), ("", "x"), ("x", ""), ("aab", "ab"), ("abc", "abc")):
        a = align.align(list(ref), list(hyp))
        assert a["cor"] + a["sub"] + a["del"] == len(ref) and a["cor"] + a["sub"] + a["ins"] == len(hyp)
    assert [p["op"] for p in align.align(["a", "b"], ["b", "a"])["pairs"]] == ["ins", "cor", "del"]
