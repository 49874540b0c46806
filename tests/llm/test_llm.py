"""Training-data operators against brute force and on awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import bpe, chroma, decontaminate, langid, lattice, licenses, probminhash, quality, sharding, textblocks, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = "doc_id long, text string, lang string, source string, n_chars long, score double, node string, shard int"


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def words(t):
    return WORD.findall(low(t or ""))


def table(spark, texts):
    """Documents with further columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 9.0, "n", 1) for i, t in texts], TEXTS)


AWKWARD = [(1, None), (2, ""), (3, " \n"), (4, "..."), (5, "one"), (6, "one"), (None, "null id text of some words"), (7, "same row here"), (7, "same row here"), (8, "É" * 3000), (9, "x " * 20000), (10, "<|endoftext|> a\u0085b")]


# -- decontamination -----------------------------------------------------------------------------------------------------
def brute_hits(text, items, k=10):
    w, hit, ids = words(text), set(), set()
    for item_id, it in items:
        v = words(it)
        if not v:
            continue
        n = min(k, len(v))
        for s in range(len(v) - n + 1):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[s : s + n]:
                    hit.update(range(p, p + n))
                    if item_id is not None:
                        ids.add(str(item_id))
    return len(w), len(hit), sorted(ids)


def test_contamination(spark):
    rnd = random.Random(3)
    vocab = ["the", "of", "Ära", "x1", "rare", "b"]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(n))) for i, n in enumerate([1, 9, 10, 11, 25, 40])] + [(90, None), (91, "!!"), (None, "null item words here"), (12, "the of the of the of the of the of the of")]
    docs = [(i, t) for i, t in AWKWARD if i != 9] + [(9, 'x ' * 4000 + 'null item words here ' + 'x ' * 4000)]
    docs += [(None, 'null item words here'), (None, 'a clean one')]
    for i in range(100, 130):
        t = [rnd.choice(vocab) for _ in range(rnd.randint(0, 60))]
        if i % 3:
            v = items[rnd.randrange(6)][1].split()
            t[3:3] = v[rnd.randint(0, len(v) // 2) :]
        docs.append((i, (", " if i % 2 else " ").join(t).upper() if i % 5 == 0 else " ".join(t)))
    docs.append((200, "Null ITEM, words here"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in decontaminate.contamination(table(spark, docs), bench).collect()]
    want = []
    for i, t in docs:
        n, h, ids = brute_hits(t, items) if i != 9 else (8004, 4, [])
        want.append((i, n, h, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), h > 0))
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert decontaminate.contamination(table(spark, []), bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(table(spark, docs), bench.limit(0)).collect())


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    docs = table(spark, [(1, "alpha x beta gamma"), (2, "gamma alpha"), (3, "alpha beta gamma"), (4, None)])
    near = {r.doc_id for r in decontaminate.proximity_matches(docs, bench, slop=1).collect()}
    assert 3 in near and 1 in near and 4 not in near
    assert {r.doc_id for r in decontaminate.proximity_matches(docs, spark.createDataFrame([(1, "alpha nowhere gamma")], "item_id long, text string"), slop=1).collect()} == {1, 3}


# -- licences ------------------------------------------------------------------------------------------------------------
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
GPL2 = """ * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
LICENSED = [
    ("Text.\nReleased under the MIT License.\nmore", "MIT", "licensed", 0),
    (MIT, "MIT", "licensed", 0),
    ("\n".join("# " + x if x else "#" for x in MIT.split("\n")), "MIT", "licensed", 0),
    (MIT.split("\n\n")[0], "", "partial", 1),
    ("\n\n".join(reversed(MIT.split("\n\n"))), "", "partial", 3),
    ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "Apache-2.0", "licensed", 0),
    ('Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance\nwith the License.\nYou may obtain a copy of the License at\n', "Apache-2.0", "licensed", 0),
    ("Licensed under the Apache\nLicense, Version 2.0.", "Apache-2.0", "licensed", 0),
    (GPL2, "GPL-2.0", "licensed", 0),
    ("This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "LGPL-3.0", "licensed", 0),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "MPL-2.0", "licensed", 0),
    ("Licensed under the MIT License.", "MIT", "licensed", 0),
    ("MIT License", "MIT", "licensed", 0),
    ("This work is licensed under CC BY 4.0.", "CC-BY-4.0", "licensed", 0),
    ("This text is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.", "CC-BY-SA-3.0", "licensed", 0),
    ("All rights reserved. Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0,All-rights-reserved", "licensed", 0),
    ("// SPDX-License-Identifier: MPL-2.0", "MPL-2.0", "licensed", 0),
    ("SPDX-License-Identifier: GPL-2.0-only\nx = 1", "GPL-2.0", "licensed", 0),
    ("Released under the MIT License.\nReleased under the MIT License.", "MIT", "licensed", 0),
    ("License: BSD-3-Clause", "BSD-3-Clause", "licensed", 0),
    ("Released under the GPLv3 license", "GPL-3.0", "licensed", 0),
    ("Use of this source code is governed by a BSD-style\nlicense that can be found in the LICENSE file.", "BSD", "licensed", 0),
    ("// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-or-later", "MIT,Apache-2.0,GPL-2.0", "licensed", 0),
    ("Dual licensed under MIT and Apache-2.0.", "MIT,Apache-2.0", "licensed", 0),
    ("License: Apache-2.0 WITH LLVM-exception", "Apache-2.0", "licensed", 0),
    ("Licensed under either of the MIT license or the Common Development and Distribution License 1.0", "MIT,CDDL-1.0", "licensed", 0),
    ("Licensed under MIT or something else", "", "unknown", 0),
    ("MIT or Apache-2.0 license", "", "none", 0),
    ("This file is governed by an unheard-of license", "", "unknown", 0),
    ("Licensed under the Rainbow License.", "", "unknown", 0),
    ("A licence to kill is a film.", "", "none", 0),
    ("No word of rights.", "", "none", 0),
]


def test_licenses(spark):
    texts = [(100 + i, t) for i, (t, *_) in enumerate(LICENSED)] + AWKWARD
    rows = licenses.scan(table(spark, texts)).collect()
    got = {r.doc_id: (r.licenses, r.status, r.n_left) for r in rows}
    for i, (t, *want) in enumerate(LICENSED):
        assert got[100 + i] == tuple(want), t
    assert len(rows) == len(texts) and all(r.status == "none" for r in rows if r.doc_id is None or r.doc_id < 100)
    assert licenses.scan(table(spark, [])).count() == 0


def test_license_rules_consume(spark):
    df = table(spark, [(1, "Released under the MIT License. All rights reserved.")])
    one, two = ("one", ["MIT", "All-rights-reserved"]), ("two", ["MIT"])
    assert licenses.scan(df, [one, two]).first().licenses == "one" and licenses.scan(df, [two, one]).first().licenses == "two"


def test_license_signs_pass_over_no_known_sentence():
    assert all(re.search(licenses.SIGNS, s) for s in [*licenses.SENTENCES, *(f"released under {n}" for n in licenses.NAMES), *(n for n in licenses.NAMES if re.search(licenses.ALONE, n))])


def test_license_sql_agrees(spark, tmp_path):
    import duckdb

    spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(LICENSED)] + AWKWARD, "doc_id long, text string").createOrReplaceTempView("license_texts")
    spark.table("license_texts").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(licenses.oracle_sql())
    got = licenses.scan(spark.table("license_texts")).select(*want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


# -- lattice -------------------------------------------------------------------------------------------------------------
def test_lattice_sums_all_segmentations():
    pieces = [b" a", b" ", b"a", b"b", b"ab", b" ab", b"bb"]
    p = np.array([0.2, 0.1, 0.2, 0.2, 0.1, 0.1, 0.1])
    model = lattice.Lattice(pieces, np.log(p))
    value = dict(zip(pieces, p, strict=True))

    def brute(s):
        return sum(value.get(s[:k], 0) * brute(s[k:]) for k in range(1, len(s) + 1)) if s else 1.0

    strings = [b" a", b" ab", b" abb", b" abbab", b" zz", b" b"]
    got = model.score(strings)
    for s, g in zip(strings, got, strict=True):
        assert (g == -np.inf and brute(s) == 0) or g == pytest.approx(math.log(brute(s)))


def test_long_words_go_in_steps(monkeypatch):
    pieces, p = [b" ", b"a", b"b", b"ab", b"aba", b"bbbb"], np.array([0.1, 0.3, 0.2, 0.2, 0.1, 0.1])
    model, rnd = lattice.Lattice(pieces, np.log(p)), random.Random(3)
    strings = [b" " + bytes(rnd.choice(b"ab") for _ in range(n)) for n in (1, 3, 7, 8, 9, 40, 41)]
    whole = model.score(strings)
    monkeypatch.setattr(lattice, "STEP", 4)
    assert model.score(strings) == pytest.approx(whole)


def test_discounts():
    assert lattice.discounts([0, 0, 0, 0]) == [0.5, 0.75, 0.75]
    y = 100 / 180
    assert lattice.discounts([100, 40, 20, 12]) == pytest.approx([1 - 2 * y * 0.4, 2 - 3 * y * 0.5, 3 - 4 * y * 0.6])


def brute_fit(strings, first, longest, rounds=4, prior=300.0, stretch=256):
    value = first
    for _ in range(rounds):
        weight = {k: prior * v for k, v in first.items()}
        for s in (x[a : a + stretch] for x in strings for a in range(0, len(x), stretch)):
            ways, behind = [1.0], [1.0]
            for t in range(1, len(s) + 1):
                ways.append(sum(ways[t - k] * value.get(s[t - k : t], 0.0) for k in range(1, min(longest, t) + 1)))
                behind.append(sum(behind[t - k] * value.get(s[len(s) - t : len(s) - t + k], 0.0) for k in range(1, min(longest, t) + 1)))
            for a in range(len(s)):
                for b in range(a + 1, min(len(s), a + longest) + 1):
                    if s[a:b] in value and ways[-1]:
                        weight[s[a:b]] += ways[a] * value[s[a:b]] * behind[len(s) - b] / ways[-1]
        whole = sum(weight.values())
        value = {k: v / whole for k, v in weight.items()}
    return value


def test_vocabulary_is_fitted_to_words(spark):
    """Unseen words are likelier with the weights fitted than with the vocabulary's own; without words these stay."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lattice.score_texts(docs, path).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens"), F.sum("lattice_score")).first()
    pieces, logp = lattice.load_pieces(path)
    assert np.allclose(lattice.fitted(spark.createDataFrame([], "word string"), pieces, logp), logp)
    model, words_ = lattice.Lattice(pieces, logp), Counter()
    for r in docs.collect():
        if zlib.crc32(str(r.doc_id).encode()) % 10 == 0:
            words_.update(re.findall(r"[^\x20\x09-\x0D]+", low(r.text or "")))
    own = model.score([b" " + w.encode() for w in words_]) / math.log(10)
    assert rows[3] > (own * np.array(list(words_.values()))).sum() + rows[2]  # by more than one decimal power a token
    assert rows[0] / rows[2] > -5.5


@pytest.mark.parametrize("hot", [3, 100_000])
def test_scores(spark, hot):
    rnd = random.Random(2)
    vocab = ["the", "End", "word", "Ära", "naïve", *(f"w{i}" for i in range(40))]
    texts = [(i, f"the word number {i % 7} the end {rnd.choice(vocab)} " + " ".join(rnd.choices(vocab, k=i % 9))) for i in range(20, 120)] + AWKWARD
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = lattice.score_texts(table(spark, texts), path, hot=hot).collect()
    assert len(rows) == len(texts)
    token = re.compile(r"[^\x20\x09-\x0D]+")
    split = {i: token.findall(low(t or "")) for i, t in texts}
    train = [i for i, _ in texts if zlib.crc32(b"" if i is None else str(i).encode()) % 10]
    c = Counter(w for i, t in texts if zlib.crc32(b"" if i is None else str(i).encode()) % 10 for w in token.findall(low(t or "")))
    n, v = sum(c.values()) + len(train), len(c) + 1
    off = [0.0, *lattice.discounts([sum(x == k for x in c.values()) for k in (1, 2, 3, 4)])]
    mass = sum(off[min(x, 3)] for x in [*c.values(), 3]) / n
    pieces, logp = lattice.load_pieces(path)
    longest = max(map(len, pieces))
    value = brute_fit([b" " + w.encode() for w in c], dict(zip(pieces, np.exp(logp), strict=True)), longest)

    def spelled(w):
        s, alpha = b" " + w.encode(), [1.0]
        for t in range(1, len(s) + 1):
            alpha.append(sum(alpha[t - k] * value.get(s[t - k : t], 0.0) for k in range(1, min(longest, t) + 1)))
        return alpha[-1]

    for r in rows:
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in split[r.doc_id]) + math.log10((len(train) + 0.1) / (n + 0.1 * (v + 1)))
        assert r.n_tokens == len(split[r.doc_id]) + 1 and r.train_tokens == n and r.base_score == pytest.approx(base)
        assert r.n_known == sum(c[w] > 0 for w in split[r.doc_id]) + 1
        each = Counter(split[r.doc_id])
        score = sum(m * math.log10((c[w] - off[min(c[w], 3)]) / n + mass * spelled(w)) for w, m in each.items()) + math.log10((len(train) - off[3]) / n)
        assert r.score == pytest.approx(score, rel=1e-5) and r.lattice_score == pytest.approx(sum(m * math.log10(spelled(w)) for w, m in each.items()), rel=1e-5)
    # Of all words and the end the probabilities add up to one: those of counts, and what is left to spellings.
    assert sum(x - off[min(x, 3)] for x in c.values()) / n + (len(train) - off[3]) / n + mass == pytest.approx(1)
    assert lattice.score_texts(table(spark, []), path).count() == 0


# -- quality: what counts as a label --------------------------------------------------------------------------------------
def test_quality_learns_from_known_labels_only(spark):
    docs = table(spark, [(i, f"text number {i}") for i in range(20)])
    odd = spark.createDataFrame([(i, q) for i, q in enumerate([5, -1, None, 2] * 5)] + [(None, 1)], "doc_id long, quality int")
    assert not quality.fit(docs, odd).learned
    assert quality.fit(docs, odd.unionByName(spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int"))).learned


# -- sharding ------------------------------------------------------------------------------------------------------------
def test_best_fit_decreasing():
    rnd = random.Random(1)
    sizes = [rnd.randint(1, 60) for _ in range(300)]
    got = sharding.best_fit_decreasing(sorted(Counter(sizes).items()), 100)
    rooms: list[int] = []
    for s in sorted(sizes, reverse=True):  # one by one, by search
        fit = [(r, b) for b, r in enumerate(rooms) if r >= s]
        if fit:
            rooms[min(fit)[1]] -= s
        else:
            rooms.append(100 - s)
    used = Counter()
    for size, first, last, b in got:
        used[b] += size * (last - first)
    assert [100 - used[b] for b in range(len(used))] == rooms


def test_capacity_tree():
    rnd, tree, plain = random.Random(5), sharding.CapacityTree(), set()
    for i in range(2000):
        if plain and rnd.random() < 0.45:
            key = rnd.choice(sorted(plain))
            plain.remove(key)
            tree.remove(*key)
        else:
            key = (rnd.randint(0, 50), i)
            plain.add(key)
            tree.insert(*key)
        size = rnd.randint(0, 55)
        assert tree.tightest(size) == min((k for k in plain if k[0] >= size), default=None)


def test_shards(spark):
    texts = [(i, "word " * (i % 37)) for i in range(20, 420)] + AWKWARD
    rows = sharding.shard(table(spark, texts)).collect()
    assert len(rows) == len(texts) and {r.law for r in rows} == {"bytes"}
    for s in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert 0 <= s < 24 and slots == list(range(len(slots)))
    by_text: dict = {}
    place = {r.doc_id: r for r in rows}
    for i, t in texts:
        r = place[i]
        assert r.size == len((t or "").encode()) + 8 and r.text_crc32 == zlib.crc32((t or "").encode())
        assert by_text.setdefault(t, r.shard) == r.shard
    assert sharding.shard(table(spark, [])).count() == 0


def test_shards_are_best_fits_of_exact_sizes(spark):
    rnd = random.Random(4)
    texts = [(i, chr(97 + i % 26) * rnd.choice([10, 500, 70_001, 70_002, 131_073 + i])) for i in range(300)]
    texts += [(1000 + i, "copy " * 40) for i in range(50)]
    rows = sharding.shard(table(spark, texts)).collect()
    groups, place = Counter(), {}
    for r in rows:
        text = dict(texts)[r.doc_id]
        groups[text] += r.size
        assert place.setdefault(text, r.shard) == r.shard
    load = Counter()
    for text, size in groups.items():
        load[place[text]] += size
    capacity, rooms, again = max(load.values()), [], Counter()
    for size in sorted(groups.values(), reverse=True):  # one by one into the tightest
        fit = [(room, b) for b, room in enumerate(rooms) if room >= size]
        b = min(fit)[1] if fit else len(rooms)
        if not fit:
            rooms.append(capacity)
        rooms[b] -= size
        again[b] += size
    assert sorted(again.values()) == sorted(load.values()) and max(load.values()) <= sum(load.values()) / 24 + max(groups.values())


# -- audio ---------------------------------------------------------------------------------------------------------------
def test_chroma_aligns_excerpts(spark):
    rng = np.random.default_rng(2)
    rate = 4000

    def tune(seed, n=96):
        r = np.random.default_rng(seed)
        t = np.arange(512) / rate
        return np.concatenate([np.sin(2 * np.pi * 220 * 2 ** (k / 12) * t) for k in r.integers(0, 30, n)])

    def pcm(x):
        return (x * 9000).astype("<i2").tobytes()

    a, b = tune(1), tune(2)
    cut = a[256 * 40 :] + rng.normal(0, 0.02, len(a) - 256 * 40)
    media = [(20, rate, pcm(a)), (1, rate, pcm(cut)), (2, rate, pcm(b)), (3, rate, pcm(a)), (4, rate, b""), (5, rate, None), (None, rate, pcm(b)), (40, rate, b"\0" * 80000)]
    df = spark.createDataFrame(media, "id long, rate int, pcm binary")
    out = chroma.search(chroma.fingerprints(df), F.col("id") % 20 == 0).collect()
    members = {r.recording_id: r.class_id for r in out if r.kind == "member"}
    assert members[20] == members[3] == 3 and members[None] == 2 and len([r for r in out if r.kind == "member"]) == len(media)
    found = {(r.class_id, r.recording_id): r for r in out if r.kind == "match"}
    assert set(found) == {(3, 1)} and found[(3, 1)].at == 40 and found[(3, 1)].bit_error < 0.2


def test_chroma_compares_every_place(spark):
    rng = np.random.default_rng(5)

    def noisy(x, share):
        flips = (rng.random((len(x), 32)) < share) @ (1 << np.arange(32, dtype=np.uint64))
        return (x.view(np.uint32) ^ flips.astype(np.uint32)).view(np.int32)

    def brute(q, c):
        best = None
        for at in range(-len(c) + 40, len(q) - 40 + 1):
            a, b = q[max(at, 0) :], c[max(-at, 0) :]
            k = min(len(a), len(b))
            wrong = int(np.bitwise_count((a[:k] ^ b[:k]).view(np.uint32)).sum())
            if k >= 40 and wrong <= 0.25 * 32 * k:
                rank = (32 * k - 2 * wrong, -abs(at), at, k, int((a[:k] == b[:k]).sum()), wrong / (32 * k))
                best = max(best or rank, rank)
        return best and best[2:]

    base = [rng.integers(-(2**31), 2**31, n).astype(np.int32) for n in (64, 110, 110, 110, 700)]
    prints = {20 * (i + 1): noisy(x, 0.02) for i, x in enumerate(base)}
    prints |= {20 * (i + 1) + n: noisy(x, share) for i, x in enumerate(base) for n, share in enumerate((0.05, 0.1, 0.15, 0.2, 0.22), 1)}
    prints |= {7: noisy(base[1][50:], 0.18), 8: noisy(base[4][300:380], 0.2), 9: base[2][:39], 11: np.zeros(90, np.int32), 120: np.zeros(50, np.int32)}
    want = {(q, c): found for q in prints if q % 20 == 0 for c in prints if c != q and (found := brute(prints[q], prints[c]))}
    df = spark.createDataFrame([(i, p.tolist()) for i, p in prints.items()], "id long, fp array<int>")
    got = {(r.class_id, r.recording_id): (r["at"], r.frames, r.hits, r.bit_error) for r in chroma.search(df, F.col("id") % 20 == 0, exact=True).collect() if r.kind == "match"}
    assert got == want and len(got) >= 28


def test_chroma_index_finds_what_a_full_search_finds():
    rng = np.random.default_rng(3)
    tone = chroma.tones(4000, 512)
    base = rng.normal(0, 0.125, (700, 64))
    tunes = np.concatenate([base, base[:120] + rng.normal(0, 0.008, (120, 64))])
    prints = [chroma.listen(chroma.play(v.tolist(), tone), 4000) for v in tunes]
    queries, others = prints[700:], prints[:700]
    want = {(i, j): rest for i, j, *rest in chroma.align(queries, others)}
    step, threshold = chroma.fit(queries, others)
    got = {(i, j): rest for i, j, *rest in chroma.align_by_index(queries, others, step, threshold)}
    assert step > 1 and len(want) >= chroma.FEW
    assert len(got) >= 0.97 * len(want) and all(want[k] == v for k, v in got.items())


def test_chroma_index_compares_a_block_at_once(monkeypatch):
    """Prints of any lengths; candidates of all runs are compared by place, and those that match once more, all together."""
    rng = np.random.default_rng(11)
    base = [np.repeat(rng.integers(-(2**31), 2**31, 60), 5).astype(np.int32)[: int(n)] for n in (300, 300, 299, 170, 171, 90, 41, 40, 39, 3, 0)]
    queries = [b[7:] ^ (1 << rng.integers(0, 31, max(len(b) - 7, 0))).astype(np.int32) for b in base] + [np.append(base[0][200:], base[3]), base[6]]
    want = sorted(chroma.align(queries, base))
    calls, places = [], chroma._places
    monkeypatch.setattr(chroma, "_places", lambda *args: calls.append(1) or places(*args))
    for cells in (chroma.CELLS, 2000):
        monkeypatch.setattr(chroma, "CELLS", cells)
        for step in (1, 2, 3, 4):
            calls.clear()
            assert sorted(chroma.align_by_index(queries, base, step, 0.2)) == want and len(calls) == 1
    assert len(want) > 8 and list(chroma.align_by_index([], base, 2, 0.2)) == list(chroma.align_by_index(queries, base, 2, 2.0)) == []


def test_chroma_awkward_tables(spark):
    fp = "id long, fp array<int>, key string, class_id long, q int"
    tie = list(range(60))
    rows = [(20, tie, "k", 1, 2), (20, tie, "k", 1, 2), (40, tie, "k", 1, 2), (None, tie, "k", 1, 2), (60, [], "k", 1, 2), (61, None, "k", 1, 2)]
    out = chroma.search(spark.createDataFrame(rows, fp), F.col("id") % 20 == 0).collect()
    assert sorted(str((r.class_id, r.recording_id)) for r in out) == sorted(map(str, [(20, 20), (20, 20), (20, 40), (20, None), (60, 60), (61, 61)]))
    none = chroma.search(spark.createDataFrame([], fp), F.col("id") % 20 == 0)
    assert none.count() == 0
    assert {r.kind for r in chroma.search(spark.createDataFrame([(1, tie, "", 0, 0), (3, tie[1:], "", 0, 0)], fp), F.col("id") % 20 == 0).collect()} == {"member"}


# -- language ------------------------------------------------------------------------------------------------------------
def test_language(spark):
    de, en = "der schnelle braune fuchs und die katze ", "the quick brown fox and a lazy dog "
    rows = [(i, (de if i % 2 else en) * 3, "de" if i % 2 else "en", "s", 1, 9.0, "n", 1) for i in range(20, 80)]
    rows += [(i, t, None, "s", 0, 9.0, "n", 1) for i, t in AWKWARD] + [(100, "12 34 !", "en", None, None, None, None, None), (101, "東京", None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, TEXTS)
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert all(got[i].lang_pred == ("de" if i % 2 else "en") for i in range(20, 80))
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 100)] == ["und"] * 5
    assert got[101].lang_pred != "und" and all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(df).count() == len(rows) and langid.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def brute_grams(text):
    """Byte n-grams of a text whose letters are lower-cased and whose other runs are one space, with a space at both ends."""
    letters = b"".join(bytes([c + 32 if 65 <= c <= 90 else c]) if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else b" " for c in text.encode())
    flat = b" " + re.sub(rb" +", b" ", letters).strip(b" ") + b" "
    flat = b" " if flat == b"  " else flat
    return [flat[i : i + k] for k in langid.SIZES for i in range(len(flat) - k + 1)]


def test_language_filter_counts_as_sets_do():
    texts = {"de": "der schnelle braune fuchs über die katze", "en": "the quick brown fox, a lazy dog", "xx": "Der dog 12 !! äöü"}
    sets = {k: set(brute_grams(t)) for k, t in texts.items()}

    def hashed(t):
        data = np.frombuffer(t.encode(), np.uint8)
        return np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in langid.grams(data, np.array([0, len(data)])))])

    for t in [*texts.values(), " leading", "trailing ", "", "?", "a"]:
        assert len(hashed(t)) == len(brute_grams(t)), t
    for many in (3, 70):  # one word of languages, and two
        names = [*texts, *(f"l{i}" for i in range(many - 3))]
        place = {k: i * (many - 1) // 2 for i, k in enumerate(texts)}
        every = sorted(set().union(*sets.values()))
        hashes = {g: h for t in texts.values() for g, h in zip(brute_grams(t), hashed(t), strict=True)}
        masks = np.zeros((len(every), -(-many // 64)), np.uint64)
        for k, i in place.items():
            for n, g in enumerate(every):
                if g in sets[k]:
                    masks[n, i // 64] |= np.uint64(1 << (i % 64))
        model = langid.Filter.of(names, np.array([hashes[g] for g in every]), masks)
        for t in texts.values():
            data = np.frombuffer(t.encode(), np.uint8)
            got = model.counts(data, np.array([0, len(data)]))[0]
            for k, i in place.items():
                assert got[i] == pytest.approx(sum(g in sets[k] for g in brute_grams(t)), abs=0.5)


def test_more_than_64_languages(spark):
    rows = [(100 * n + i, f"word{chr(97 + n % 26) * 3}{chr(97 + n // 26) * 4} text of it " * 8, f"l{n:02}") for n in range(70) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert len(model.languages) == 70 and model.masks.shape[1] == 2
    got = langid.predict(df, model, "guess", "sure").collect()
    assert np.mean([r.guess == r.lang for r in got]) > 0.95


# -- WARC ----------------------------------------------------------------------------------------------------------------
def test_warc_round_trip(spark):
    long = "<p>é\r\n\r\nWARC/1.1\r\n" * 9000
    pages = [(1, "http://a", long), (2, "http://b", long), (3, "http://c", "short"), (4, "http://d", "short"), (5, None, None), (6, "u\r\nv", ""), (7, "http://e", "x" * 1000), (8, "http://f", "x" * 1000), (8, "http://f", "x" * 1000), (None, "http://g", "x" * 1000), (9, "http://h", "y" * 999), (10, "http://i", "y" * 999)]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, digest string")
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to), r.complete) for r in warc.round_trip(df).collect())
    want = []
    for i, _, h in pages:
        data = (h or "").encode()
        top = max(p[0] for p in pages if p[0] is not None and (p[2] or "") == (h or "")) if len(data) >= 1000 else None
        kind = "revisit" if top is not None and i != top else "response"
        want.append((str(i), len(data), hashlib.sha1(data).hexdigest(), kind, str(top if kind == "revisit" else None), True))
    assert got == sorted(want)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_broken_archives(spark, tmp_path):
    http = b"HTTP/1.1 200\r\nTransfer-Encoding: chunked\r\n\r\n"
    assert warc.payload(http + b"3\r\nabc\r\n2;x=1\r\nde\r\n0\r\n\r\n") == (b"abcde", True)
    assert warc.payload(http + b"3\r\nabc\r\n") == (b"abc", False) and warc.payload(http + b"3\r\nabc\r\nxyz\r\nde") == (b"abc", False)

    def record(kind, name, block, length=None, more=""):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\nContent-Length: {len(block) if length is None else length}\r\n{more}\r\n".encode() + block + b"\r\n\r\n"

    plain, sha = b"HTTP/1.1 200\r\n\r\nabc", "WARC-Payload-Digest: sha1:" + hashlib.sha1(b"abc").hexdigest() + "\r\n"
    files = {
        "good": record("warcinfo", "i", b"x") + record("response", "a", plain, more=sha) + b"junk\r\n\r\n" + record("response", "b", plain, more=sha + "no colon\r\n"),
        "length": record("response", "c", plain, "many", sha) + record("response", "d", plain, more=sha),
        "cut": record("response", "e", plain, more=sha)[:-20], "header": b"WARC/1.0\r\nWARC-Type: resp", "empty": b"", "chunk": record("response", "f", http + b"zz\r\nabc"),
        "segment": record("continuation", "g", b"part", more="WARC-Segment-Number: two\r\nWARC-Segment-Origin-ID: <h>\r\n") + record("continuation", "j", b"part", more="WARC-Segment-Number: 2\r\nWARC-Segment-Origin-ID: <k>\r\n"),
        "revisit": record("revisit", "l", b"", more="WARC-Refers-To: <nowhere>\r\n"),
    }
    import gzip

    for name, data in files.items():
        (tmp_path / f"{name}.gz").write_bytes(gzip.compress(data[: len(data) // 2]) + gzip.compress(data[len(data) // 2 :]))
    (tmp_path / "plain.warc").write_bytes(files["good"].replace(b"<a>", b"<m>").replace(b"<b>", b"<n>"))
    (tmp_path / "torn.gz").write_bytes(gzip.compress(record("response", "o", plain, more=sha) * 50)[:-30])
    rows = warc.read_archives(str(tmp_path), spark).collect()
    whole = {r.id for r in rows if r.complete}
    assert whole >= {"<a>", "<b>", "<d>", "<m>", "<n>"} and not whole & {"<c>", "<e>", "<f>", "<g>", "<k>", "<l>", None}
    assert {r.id for r in rows} >= {"<c>", "<e>", "<f>", "<g>", "<k>", "<l>", None} and sum(r.kind == "broken" and r.id is None for r in rows) >= 4
    assert all(r.payload_bytes == 3 for r in rows if r.complete)


def test_spread_join_keeps_rows(spark, monkeypatch):
    from lodestone.llm import common

    rows = spark.createDataFrame([(i, "hot" if i % 3 else None) for i in range(90)] + [(100, "other")], "id int, k string")
    few = spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, v int")
    monkeypatch.setattr(common, "PLACE", 7)
    for limit in (common.BROADCAST_BYTES, -1):
        monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
        got = common.spread_join(rows, few, "k", ["id"])
        assert got.count() == 91 and got.where("v = 1").count() == 60 and set(got.columns) == {"id", "k", "v"}


# -- near-duplicates -----------------------------------------------------------------------------------------------------
def shingle_counts(t):
    w = words(t)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_similarity(a, b):
    if not a or not b:
        return 0.0
    jp = sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in a | b) for i in a if i in b)
    return max(jp, len(a.keys() & b.keys()) / len(a.keys() | b.keys()))


def test_probability_jaccard_and_estimate():
    rnd = random.Random(4)
    for _ in range(20):
        a, b = (Counter(rnd.choices(range(30), k=60)) for _ in range(2))
        arr = lambda c: (np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)]))
        assert max(probminhash.probability_jaccard(*arr(a), *arr(b))) == pytest.approx(brute_similarity(a, b))
    items = textblocks.mix(np.arange(400, dtype=np.uint64))
    owner = np.repeat([0, 1], [300, 300])
    both = np.concatenate([items[:300], items[100:]])
    sig = probminhash.signatures(both, owner, np.ones(600), 2, 2048)
    assert (sig[0] == sig[1]).mean() == pytest.approx(0.5, abs=0.05)


def test_near_duplicates(spark):
    rnd = random.Random(8)
    texts = []
    for g in range(12):
        base = [f"w{rnd.randrange(400)}" for _ in range(120)]
        for c in range(5):
            t = list(base)
            for _ in range(c):
                t[rnd.randrange(len(t))] = f"z{rnd.randrange(9999)}"
            texts.append((len(texts) + 100, " ".join(t)))
    texts += [(i, t) for i, t in AWKWARD] + [(300, texts[0][1]), (301, texts[0][1].upper())]
    df = table(spark, texts)
    got = probminhash.classes(df).collect()
    assert len(got) == len(texts)
    parent = {i: i for i in range(len(texts))}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingle_counts(t) for _, t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if (texts[i][1] is not None and texts[i][1] == texts[j][1]) or brute_similarity(sets[i], sets[j]) >= 0.8:
                parent[find(i)] = find(j)
    key = lambda x: 1 << 60 if x is None else x
    least: dict = {}
    for i, (d, _) in enumerate(texts):
        least[find(i)] = min(least.get(find(i), 1 << 60), key(d))
    want = sorted((key(d), least[find(i)]) for i, (d, _) in enumerate(texts))
    assert sorted((key(r.doc_id), key(r.class_id)) for r in got) == want
    kept = probminhash.representatives(df)
    assert kept.columns == df.columns and kept.count() == len(set(least[find(i)] for i in range(len(texts))))
    assert probminhash.classes(table(spark, [])).count() == 0


def test_near_duplicates_that_differ_in_repetitions(spark):
    rnd = random.Random(9)
    texts = []
    for _ in range(20):
        once, line = (" ".join(f"w{rnd.randrange(10**6)}" for _ in range(n)) for n in (60, 10))
        texts += [(len(texts), f"{once} {line}"), (len(texts) + 1, f"{once} {' '.join([line] * 20)}")]
    one, two = (shingle_counts(t) for _, t in texts[:2])
    assert len(one & two) / len(one | two) > 0.9
    got = {r.doc_id: r.class_id for r in probminhash.classes(table(spark, texts)).collect()}
    assert got == {i: i // 2 * 2 for i, _ in texts}


# -- quality -------------------------------------------------------------------------------------------------------------
def test_quality(spark):
    rnd = random.Random(6)
    vocab = ["the", "house", "on", "green", "hill", "is", "old", "and", "small"]
    texts = [(i, " ".join(rnd.choice(vocab) + ("!!" if i % 3 == 0 else "") for _ in range(40))) for i in range(20, 320)] + AWKWARD
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(20, 320)] + [(None, 1, 0), (20, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(table(spark, texts), labels).collect()
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id >= 20]
    assert len(got) == len(texts) and np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert {r.score for r in quality.classify(table(spark, AWKWARD), labels.limit(0)).collect()} == {0.5}
    assert quality.classify(table(spark, []), labels).count() == 0


def test_quality_features_equal_a_plain_count():
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(["one", "two", "three", "FOUR", "!!", "two two"]) for _ in range(n)) for n in (0, 1, 2, 30)] + ["", "?"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    h, doc = quality.tokens(data, offsets)
    context = np.zeros((quality.BUCKETS, quality.DIM))
    for i in range(len(h) - 1):
        if doc[i] == doc[i + 1]:
            for mine, other in ((i, i + 1), (i + 1, i)):
                context[quality._bucket(h[mine : mine + 1])[0]] += quality.index_vectors(h[other : other + 1])[0]
    assert np.allclose(quality.context_sums(h, doc), context)
    got = quality.pooled(data, offsets, context.astype(np.float32))
    for d in range(len(texts)):
        own = h[doc == d]
        mean = [quality.index_vectors(own).mean(0), context[quality._bucket(own)].mean(0)] if len(own) else [np.zeros(quality.DIM)] * 2
        want = [*mean[0], *mean[1], np.linalg.norm(mean[0]), np.linalg.norm(mean[1]), math.log1p(len(own))]
        assert np.allclose(got[d], want, atol=1e-4)


# -- BPE -----------------------------------------------------------------------------------------------------------------
def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, own, rnd = Tokenizer.from_file(path), bpe.Bpe(path), random.Random(1)
    alphabet = [chr(c) for c in [*range(300), 0x2028, 0x200B, 0x3000, 0xFEFF, 0x4E00, 0x1F600, 0x300, 0xFFFD]] + ["'s", "'ll", "  ", "aaaa", "<|endoftext|>", "the"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(400)] + ["a" * 3000, " " * 500, "aaa " * 200, ""]
    for t, (n, ids, back) in zip(texts, own.run(texts), strict=True):
        want = lib.encode(t, add_special_tokens=False).ids
        assert n == len(want) and ids == ",".join(map(str, want)) and back == lib.decode(want, skip_special_tokens=False)
    assert own.decode(own.encode("naïve <|endoftext|>")) == "naïve <|endoftext|>"
    rows = bpe.round_trip(table(spark, AWKWARD), path).collect()
    assert len(rows) == len(AWKWARD) and {r.decoded_sha256 for r in rows if r.doc_id in (1, 2)} == {hashlib.sha256(b"").hexdigest()}
    assert bpe.encode_rows(table(spark, [(1, "a b")]), path).first()["ids"] == lib.encode("a b").ids
    assert bpe.round_trip(table(spark, []), path).count() == 0


# -- pipeline ------------------------------------------------------------------------------------------------------------
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        before, after = {r.doc_id for r in docs.select("doc_id").collect()}, [r.doc_id for r in out.select("doc_id").collect()]
        assert set(after) <= before and len(after) == len(set(after)), name
        if name != "encoding":
            assert out.columns == first.columns
        if name == "near-duplicates":
            assert out.count() == probminhash.classes(docs).select("class_id").distinct().count()
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            grams = {tuple(w[i : i + 10]) for w in (words(t) for _, t in items) for i in range(max(1, len(w) - 9))}
            dirty = lambda t: any(tuple(w[i : i + 10]) in grams for w in [words(t)] for i in range(len(w)))
            assert set(after) == {r.doc_id for r in docs.collect() if not dirty(r.text)}
        docs = out
    final = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in final.collect()} == {r.doc_id for r in docs.select("doc_id").collect()} and final.count() > 50


def awkward_folder(spark, path, docs):
    """Tables of a pipeline run: documents with nulls, repeated ids, clashing names; labels and a benchmark item."""
    from pyspark.sql import types as T

    names = ["score", "predicted", "lang_pred", "n_tokens", "__node", "node", "shard", "_text"]
    schema = T.StructType([*T.StructType.fromDDL("doc_id long, text string, lang string, source string, n_chars long").fields, *(T.StructField(n, T.StringType()) for n in names)])
    rows = [(i, t, lang, "s", len(t or ""), *(f"{n}-{k}" for n in names)) for k, (i, t, lang) in enumerate(docs)]
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(100, 400)] + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


PASSAGE = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo"


def test_pipeline_on_awkward_tables(spark, tmp_path):
    rnd = random.Random(5)
    good, bad = ["the", "house", "on", "green", "hill", "is", "old", "and", "small", "river", "runs", "by"], ["buy!!", "CHEAP", "now!!!", "$$$", "CLICK"]
    text = lambda words, n=60: " ".join(rnd.choice(words) for _ in range(n))
    docs = [(i, text(good if i % 4 else bad), "en") for i in range(100, 400)]
    docs += [(None, text(good), "en"), (None, text(good) + " " + PASSAGE, "en"), (5, text(good), None), (5, text(good) + " " + PASSAGE, "en"), (7, text(good), "en")]
    docs += [(7, docs[-1][1], "en"), (8, docs[-1][1], "en"), (9, None, "en"), (10, "", None), (11, "12 34", "en"), (12, (text(good) + " ") * 400, "en")]
    awkward_folder(spark, str(tmp_path), docs)
    before = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert set(out[0].asDict()) == {*before.columns, *bpe.RESULTS}
    rows = {r["node"]: r for r in before.collect()}
    for r in out:
        old = rows[r["node"]]
        assert all(r[n] == old[n] for n in before.columns if n != "n_tokens") and isinstance(r.n_tokens, int)
    left = [(r.doc_id, r.text) for r in out]
    assert not any(PASSAGE in t for _, t in left) and not any(t is None or "!!" in t for _, t in left)
    assert (None, docs[300][1]) in left and (5, docs[302][1]) in left and len([t for _, t in left if t == docs[304][1]]) == 1
    empty = str(tmp_path / "empty")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_quality_stage_without_usable_labels(spark, tmp_path):
    docs = table(spark, [(i, f"some clean words of text {i}") for i in range(20, 40)])
    held = [i for i in range(20, 40) if zlib.crc32(str(i).encode()) % 4 == 2]
    for n, rows in enumerate(([], [(i, 1, 0) for i in held], [(20, None, 0)])):
        spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{n}/labels.parquet")
        assert corpus_pipeline.keep_quality(spark, docs, f"{tmp_path}/{n}").count() == 20


def test_decontamination_stage_judges_rows_by_their_text(spark, tmp_path):
    passage = "one two three four five six seven eight nine ten eleven"
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = [(None, "clean without id"), (None, None), (7, "clean of a repeated id"), (7, "clean of a repeated id"), (8, "other"), (9, "")]
    dirty = [(None, f"so {passage} it was"), (7, passage), (10, passage), (10, passage)]
    got = corpus_pipeline.keep_uncontaminated(spark, table(spark, clean + dirty), str(tmp_path))
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, clean))


def test_playing_and_listening_in_one_pass(spark):
    rows = [(1, [0.1, -0.2] * 32), (2, None), (3, []), (4, [None] * 64), (1, [0.1, -0.2] * 32)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    two = chroma.fingerprints(chroma.render(df)).collect()
    assert sorted(map(str, chroma.vector_fingerprints(df).collect())) == sorted(map(str, two)) and len(two) == 5
