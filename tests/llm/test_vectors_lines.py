"""Line dedup, hard negatives and vector codes against brute force, and on awkward tables."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import codes, lines, negatives
from lodestone.llm.vectors import whole_vectors


# -- lines ---------------------------------------------------------------------------------------------------------------
def brute_lines(docs, min_chars=40, min_docs=5):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                held.setdefault(key(line), set()).add(doc)
    shared = {k: max((d for d in v if d is not None), default=None) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for doc, text in docs:
        own = (text or "").split("\n")
        kept = [line for line in own if key(line) not in shared or shared[key(line)] == doc]
        out.append((doc, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


LONG = "A line of more than forty characters, with Ümlaut and İ"
DOCS = [(i, f"own {i}\n  {LONG}\t\nshort\n{'x' * 39}\nlast {i}") for i in range(4)]
DOCS += [(i, f"{LONG.lower().replace('ü', 'Ü').replace('i̇', 'İ')}\n\n{LONG.upper().replace('Ü', 'Ü')}") for i in (9, 7)]
DOCS += [(20, None), (21, ""), (22, "\n\n"), (None, f"{LONG}\nno id"), (None, f"{LONG}\nno id"), (23, "\r\n".join(["y" * 50] * 3)), (23, "y" * 50)]
DOCS += [(30 + i, f"{'z' * 40}\nkeep {i}\n{'z' * 40} ") for i in range(5)] + [(34, "z" * 40), (None, "z" * 40)]
DOCS += [(50, "\n".join(f"{LONG} {n}" for n in range(3000)))] + [(51 + i, "w" * 41) for i in range(4)]


@pytest.mark.parametrize("broadcast", [True, False])
def test_line_dedup(spark, monkeypatch, broadcast):
    if not broadcast:
        from lodestone.llm import common

        monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
        monkeypatch.setattr(common, "PLACE", 3)
    df = spark.createDataFrame([(i, t, "k", 1, "r") for i, t in DOCS], "doc_id long, text string, key string, at int, row string").repartition(3)
    assert sorted(map(tuple, lines.digests(df).collect()), key=str) == brute_lines(DOCS)


def test_line_dedup_keeps_columns(spark):
    df = spark.createDataFrame([(i, f"{LONG}\n{i}", "k", 1, "r", "old") for i in range(6)], "doc_id long, text string, key string, at int, row string, kept_text string")
    got = {r.doc_id: r for r in lines.dedup(df).collect()}
    assert got[5].kept_text == f"{LONG}\n5" and got[0].kept_text == "0" and (got[1].key, got[1].at, got[1].row, got[1].n_lines, got[1].n_dropped) == ("k", 1, "r", 2, 1)
    assert lines.dedup(df.limit(0)).collect() == [] and lines.dedup(df, min_docs=7).where("n_dropped > 0").count() == 0


def test_random_lines(spark):
    rnd = random.Random(8)
    pool = [f"{w} " * rnd.randrange(1, 9) + "of a line" for w in ("alpha", "Beta", "gamma", "DELTA")]
    docs = [(rnd.randrange(60), "\n".join(rnd.choice(["", " ", "\t"]) + rnd.choice(pool) for _ in range(rnd.randrange(6)))) for _ in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, lines.digests(df).collect()), key=str) == brute_lines(docs)


# -- hard negatives ------------------------------------------------------------------------------------------------------
def vectors_table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, id string, rank int")


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_negatives(rows):
    kept = [(i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, label in rows if label is not None and usable(v)]
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for n, (i, label, v) in enumerate(kept):
        if i is None or i % 100:
            continue
        scores = [(sum(a * b for a, b in zip(v, w, strict=True)), j, own) for m, (j, own, w) in enumerate(kept) if m != n]
        for s, j, _ in sorted((x for x in scores if x[2] == label), key=order)[:5]:
            found = sorted((x for x in scores if x[2] != label and 80 * s <= 100 * x[0] <= 100 * s), key=order)[:5]
            out += [(i, j, k + 1, f[1], s, f[0]) for k, f in enumerate(found)]
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [(256, 1024, 32), (2, 7, 3)])
def test_hard_negatives(spark, monkeypatch, sizes):
    for name, n in zip(("ANCHORS", "ROWS", "CHUNK"), sizes, strict=True):
        monkeypatch.setattr(negatives, name, n)
    rng = np.random.default_rng(6)
    rows = [(int(i), rng.normal(size=8).round(1).tolist(), int(i) % 3) for i in range(100, 420)]
    rows += [(500, [0.5] * 8, 1), (501, [0.5] * 8, 2), (502, [0.5] * 8, 1), (600, [0.0] * 8, 0), (-100, [0.3] * 8, 2), (None, [0.5] * 8, 2), (None, [0.5] * 8, 1), (800, [0.4] * 8, 9)]
    rows += [(700, None, 1), (701, [0.1] * 8, None), (702, [None] + [0.1] * 7, 1), (703, [float("nan")] + [0.1] * 7, 1), (704, [float("inf")] + [0.1] * 7, 1)]
    rows += [(100, rows[0][1], rows[0][2]), (101, rows[1][1], rows[1][2])]  # copies of an anchor and of another row
    got = negatives.hard_negatives(vectors_table(spark, rows).repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == brute_negatives(rows)
    assert [t for _, t in got.dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]


def test_hard_negatives_of_little(spark):
    for rows in ([], [(100, [0.1], None)], [(1, [0.1, 0.2], 3)], [(100, [0.1, 0.2], 3)], [(100, [], 1), (101, [], 1), (102, [], 2)], [(100, [1.0], 1), (200, [1.0, 2.0], 1)]):
        got = [tuple(r) for r in negatives.hard_negatives(vectors_table(spark, rows)).collect()]
        assert got == ([(100, 101, 1, 102, 0, 0)] if len(rows) == 3 else [])


def test_components_too_large_are_refused(spark):
    with pytest.raises(Exception, match="too large"):
        whole_vectors(vectors_table(spark, [(1, [1e30], 1)]), "embedding", 256).collect()


# -- vector codes --------------------------------------------------------------------------------------------------------
def brute_codes(rows, parts=4, entries=256, rounds=4):
    kept = sorted(((i, [math.floor(1024 * float(np.float32(x))) for x in v], label) for i, v, label in rows if usable(v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        own = [[min(range(len(books[p])), key=lambda e: (far(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]  # noqa: B023
        if r == rounds:
            break
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [c[p] for c, o in zip(cut, own, strict=True) if o[p] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    errors = [sum(far(c[p], books[p][o[p]]) for p in range(parts)) for c, o in zip(cut, own, strict=True)]
    totals = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        totals[label] = totals.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for k in o), e, totals[label], sha) for (i, _, label), o, e in zip(kept, own, errors, strict=True)), key=str)


def test_vector_codes(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 8)) * 0.3
    rows = [(int(i), (centres[i % 40] + rng.normal(size=8) * 0.03).round(2).tolist(), int(i) % 3) for i in range(420)]
    rows += [(1000 + i, rows[i][1], None) for i in range(30)] + [(rows[5][0], rows[5][1], 1), (None, rows[9][1], 2), (None, [0.0] * 8, None)]
    rows += [(2000, None, 1), (2001, [None] * 8, 1), (2002, [float("-inf")] * 8, 1), (2003, [0.25] * 8, -1)]
    got = codes.compress(vectors_table(spark, rows).repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == brute_codes(rows)


def test_vector_codes_with_ties_and_few_rows(spark):
    ties = [(i, [float(x) for x in v], 0) for i, v in enumerate([[0, 0, 0, 0], [2, 2, 2, 2], [1, 1, 1, 1], [1, 1, 1, 1], [-1, -1, 3, 3], [0.0005, -0.0005, 0, 0]])]
    for rows in (ties, ties[:1], [(1, [], 1), (2, [], 1)]):
        if rows[0][1]:
            assert sorted(map(tuple, codes.compress(vectors_table(spark, rows)).collect()), key=str) == brute_codes(rows)
        else:
            assert [tuple(r)[:4] for r in codes.compress(vectors_table(spark, rows)).orderBy("vec_id").collect()] == [(1, "00000000", 0, 0), (2, "00000000", 0, 0)]
    empty = codes.compress(vectors_table(spark, []))
    assert empty.collect() == [] and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError):
        codes.compress(vectors_table(spark, [(1, [1.0] * 6, 1)]))


def test_most_distances_are_skipped(spark):
    """Group bounds leave out distances, and codes decode to what they stand for."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(60, 16))
    rows = [(int(i), (centres[rng.integers(60)] + rng.normal(size=16) * 0.05).tolist(), 1) for i in range(3000)]
    made = whole_vectors(vectors_table(spark, rows).selectExpr("vec_id AS id", "embedding AS x"), "x", 1024)
    trained = codes.train(made, "id")
    assert trained.worked[0][0] == trained.worked[0][1] and all(some < whole * 0.35 for some, whole in trained.worked[2:])
    back = codes.decode(codes.encode(trained), trained).join(made, "id")
    off = F.aggregate(F.zip_with("vector", "x", lambda a, b: (a * 1024 - b) * (a * 1024 - b)), F.lit(0.0), lambda s, x: s + x)
    assert back.where(F.abs(off - F.col("error")) > 0.5).count() == 0 and back.count() == 3000


def test_group_bounds_equal_plain_assignment():
    rng = np.random.default_rng(10)
    for scale in (3, 40, 1 << 23):
        x = rng.integers(-scale, scale, (400, 4))
        entries = rng.integers(-scale, scale, (50, 4))
        book = codes.Codebook(entries, codes.grouped(entries), np.zeros(50, np.int64))
        own, up, low = codes.assign_all(x, book)
        for _ in range(5):
            moved = entries + rng.integers(-scale // 3, scale // 3 + 1, entries.shape)
            book = codes.Codebook(moved, book.group, codes.above(((moved - entries) ** 2).sum(1)))
            own, up, low, _ = codes.assign_again(x, book, own, up, low)
            entries = moved
            d = ((x[:, None].astype(object) - entries) ** 2).sum(2)
            assert (own == np.array([int(np.argmin(r)) for r in d])).all()
