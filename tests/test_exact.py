"""Formulas, alignment, leaders and comparison of results against plain counterparts."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import align, formulas
from lodestone.operators import sets
from lodestone.operators.leaders import leaders

EQUAL = [
    (r"\frac{1}{2}", "0.5"), ("1/2", r"\dfrac12"), ("2x+2", "2(x+1)"), ("(x+1)^2", "x^2+2x+1"), (r"\sqrt{8}", r"2\sqrt{2}"), (r"\frac{1}{\sqrt{2}}", r"\frac{\sqrt2}{2}"), ("x=5", "5"), ("1,234", "1234"),
    (r"\frac{x^2-1}{x-1}", "x+1"), ("(1,2)", r"\left( 1 , \frac{4}{2}\right)"), (r"\{1,2\}", r"\{2,1\}"), (r"1\pm\sqrt{3}", r"1-\sqrt{3},1+\sqrt{3}"), (r"50\%", "0.5"), (r"90^\circ", "90"), (r"3\text{ cm}", "3"),
    ("2^{10}", "1024"), (r"\sqrt{6}", r"\sqrt{2}\cdot\sqrt{3}"), (r"1\frac{1}{2}", "3/2"), ("(1+i)^2", "2i"), ("-x+y", "y-x"), (r"2\pi r", r"2r\pi"), ("x<3", "3>x"), ("x+y=2", "2x+2y=4"), (r"\sqrt[3]{27}", "3"),
    ("8^{2/3}", "4"), (r"\sin(2x)", r"\sin{2x}"), (r"x^{-1}", r"\frac1x"), ("3!", "6"), ("|{-3}|", "3"), (r"[0,\infty)", r"[0, \infty)"), (r"\frac{a}{b}+\frac{c}{d}", r"\frac{ad+bc}{bd}"), ("x_1+x_{2}", "x_2+x_1"), ("10^{-2}", "0.01"),
]
UNEQUAL = [
    ("1/2", "1/3"), ("x+1", "x+2"), ("(1,2)", "(2,1)"), ("[0,1)", "(0,1)"), ("x<3", "x>3"), (r"\sqrt{2}", "1.41421356"), ("2x", "x^2"), (r"\{1,2\}", r"\{1,3\}"), ("5", "x"), ("(1,2)", "1"), (r"\sin x", r"\cos x"),
    ("x+y=2", "x+y=3"), ("1", "-1"), (r"\pi", "3.14"), ("10^{10}", "10^{11}"), ("x=5", "6"), ("(1,234)", "1234"), ("2^{5000}", "3^{5000}"),
]


def test_formulas():
    for a, b in EQUAL:
        assert formulas.equal(a, b) is True and formulas.equal(b, a) is True, (a, b)
    for a, b in UNEQUAL:
        assert not formulas.equal(a, b) and not formulas.equal(b, a), (a, b)
    for bad in ("", None, " ", "hello 12 monkeys @", "1/0", r"\frac{1}{x-x}", r"\frac{1}{", "(((", "1 2", "=", "x^", "0^{-1}", "x" * 20_000, "(" * 500 + "1" + ")" * 500, "(a+b+c+d+e+f)^{60}"):
        assert formulas.parse(bad) is None, bad


def test_formula_rewards(spark):
    rows = [("1/2", "0.5"), ("1/3", "0.5"), (None, "1"), (" ", "1"), ("no @", "no @"), ("7", "no @"), ("@", "7"), ("1", None)]
    df = spark.createDataFrame(rows, "a string, g string")
    for bad in (1.0, 0.0):
        got = [r[0] for r in df.select(formulas.formula_reward(F.col("a"), F.col("g"), bad)).collect()]
        assert got == [1.0, 0.0, -1.0, -1.0, 1.0, bad, 0.0, bad]


def plain_walk(ref, hyp):
    n, m = len(ref), len(hyp)
    dist = [[i + j if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            dist[i][j] = min(dist[i - 1][j] + 1, dist[i][j - 1] + 1, dist[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]))
    moves, i, j = [], n, m
    while i or j:
        how = 0 if i and (not j or dist[i][j] == dist[i - 1][j] + 1) else 1 if not i or dist[i][j] == dist[i][j - 1] + 1 else 2
        moves.append(how)
        i, j = i - (how != 1), j - (how != 0)
    return moves, dist[n][m]


@pytest.mark.parametrize("kept, stretch", [(32, 64), (2, 3), (3, 1)])
def test_walk_equals_full_matrices(monkeypatch, kept, stretch):
    monkeypatch.setattr(align, "_KEPT", kept)
    monkeypatch.setattr(align, "_STRETCH", stretch)
    rnd = random.Random(kept)
    for _ in range(60):
        a, b = (np.array([rnd.randrange(rnd.choice([2, 4, 30])) for _ in range(rnd.randrange(50))], np.int64) for _ in "ab")
        assert align._walk(a, b) == plain_walk(a.tolist(), b.tolist())


def test_alignment_of_long_texts_is_small():
    rnd = random.Random(1)
    a, b = ([f"w{rnd.randrange(300)}" for _ in range(n)] for n in (6000, 20_000))
    tracemalloc.start()
    got = align.align(a, b)
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()
    assert got["cor"] + got["sub"] + got["del"] == got["all"] == 6000 and got["ins"] - got["del"] == 14_000


def test_similarity_equals_the_standard_librarys(spark):
    import difflib

    rnd = random.Random(3)
    texts = [("".join(rnd.choices("abcdefgh é"[:k], k=rnd.randrange(n))), "".join(rnd.choices("abcdefgh é"[:k], k=rnd.randrange(n)))) for n in (12, 60, 450) for k in (2, 5, 10) for _ in range(12)]
    texts += [("the quick brown fox " * 15, "the brown quick fox " * 16), ("", "a"), ("İx", "i̇X")]
    for a, b in texts:
        if a and b:
            assert 2.0 * align.matched(a, b) / (len(a) + len(b)) == difflib.SequenceMatcher(None, a, b).ratio(), (a, b)
    got = [r[0] for r in spark.createDataFrame([("AB", "ab"), (None, "a"), ("", ""), ("a", "b")], "a string, b string").select(align.similarity_ratio("a", "b")).collect()]
    assert got == [1.0, 0.0, 0.0, 0.0]


def scanned(rows, threshold):
    out, lead = {}, {}
    for g, k, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        if not v or not any(v):
            out[k] = k
            continue
        u = np.array(v) / np.linalg.norm(v)
        own = lead.setdefault((g, len(v)), [])
        near = [k2 for k2, w in own if w @ u >= threshold - 1e-12]
        out[k] = near[0] if near else k
        if not near:
            own.append((k, u))
    return out


@pytest.mark.parametrize("block", [1024, 16])
def test_leaders_equal_the_scan(spark, block):
    rng = np.random.default_rng(2)
    rows = [(None if g == 3 else f"g{g}", 1000 * g + i, rng.normal(size=3).tolist()) for g in range(10) for i in range(int(rng.integers(1, 40)))]
    rows += [("c", 20_000 + i, [float(np.cos(i * 0.3)), float(np.sin(i * 0.3)), 0.0]) for i in range(60)]  # a chain
    rows += [("d", 30_000 + i, [1.0, 1.0, 1.0]) for i in range(40)]  # ties
    rows += [("g0", 40_000, None), ("g0", 40_001, [0.0] * 3), ("g0", 40_002, []), ("g1", 40_003, [1.0] * 4), ("g1", 40_004, [1.0] * 4)]
    df = spark.createDataFrame(rows, "g string, k long, v array<double>")
    assert {r.k: r.leader for r in leaders(df, "g", "k", "v", 0.9, block).collect()} == scanned(rows, 0.9)


def test_leaders_of_nothing(spark):
    assert leaders(spark.createDataFrame([], "g string, k long, v array<double>"), "g", "k", "v", 0.9).collect() == []


def test_texts_are_not_numbers(spark):
    one = lambda v, kind: spark.createDataFrame([(v,)], f"x {kind}")
    assert not sets.same_rows(one("1", "string"), one(1, "long")) and not sets.same_rows(one(2**53 + 1, "long"), one(float(2**53), "double"))
    assert sets.same_rows(one(2**60, "long"), one(float(2**60), "double")) and sets.same_rows(one(None, "string"), one(None, "int")) and sets.same_rows(one(-0.0, "double"), one(0, "int"))
    assert sets.same_rows(one(1.5, "double"), one(1.5, "double").select(F.col("x").cast("decimal(10,4)"))) and not sets.same_rows(one("null", "string"), one(None, "string"))


def test_same_rows_by_key(spark):
    a = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (None, 3), (4, 4)], "k int, v int")
    b = spark.createDataFrame([(1, 2.0), (1, 1.0), (1, 1.0), (2, 2.0), (None, 3.0)], "k int, v double")
    assert {r.k: r.equal for r in sets.same_rows_by(a, b, ["k"]).collect()} == {1: True, 2: False, None: True, 4: False}


def test_exact_duplicates_with_repeated_keys(spark):
    rows = [(1, "aa"), (1, "bb"), (2, "aa"), (None, "cc"), (None, "cc"), (5, None), (6, None), (7, "bb"), (1, "aa"), (9, "once")]
    got = {r.text: (r.k, r.copies) for r in sets.exact_duplicates(spark.createDataFrame(rows, "k int, text string"), "k", "text").collect()}
    assert got == {"aa": (1, 3), "bb": (1, 2), "cc": (None, 2), None: (5, 2)}
