"""Chroma audio fingerprints and the alignment of recordings.

A recording's spectrum is folded into twelve pitch classes; Haar-like filters over that image, evaluated with its
integral image, give two bits each, packed into one 32-bit integer a frame. Recordings are compared bit by bit at every
difference of their places; they match at the one of the best correlation.

Recordings of equal fingerprints are one class; classes are searched, never their copies against each other. No seed is
asked for, as bits that differ by a quarter leave hardly an integer whole. Instead an index of coarse fingerprints, the
means of bits over a few frames, is searched in blocks of queries and classes, all differences at once through Fourier
transforms; where a place comes near a match, the bits themselves are compared. How coarse, and how near, is fitted on a
bounded sample of queries and classes, so that RECALL of the sample's matches are found; where the sample has too few
matches to tell, every place is compared in full.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import bounded, spread_join, stored

WINDOW, HOP = 1024, 256
LOWEST, HIGHEST = 180.0, 1900.0
#: A match: bits that differ at most, frames that overlap at least.
ERROR, OVERLAP = 0.25, 40
#: Queries and classes of one block; frames whose spectra are held at once, and numbers of an array made of them.
QUERIES, CLASSES, PART, CELLS = 1024, 512, 1 << 16, 1 << 21
#: Of the sample's matches, the share that the index must find; matches that are too few to tell; queries, classes and
#: frames of a recording of the sample; steps of the index, from coarse to fine; places a pair that may be compared after all.
RECALL, FEW, ASKED, KNOWN, FRAMES, STEPS, LOAD = 0.99, 60, 128, 2048, 4096, (8, 6, 4, 3, 2), 0.4
#: Up to this transform length single precision is exact after rounding, and a matrix product is the faster inverse.
SHORT = 1024
#: Filters: kind (0 below less above, 1 later less earlier, 2 the corners, 3 the middle rows, 4 the middle frames), first pitch class, rows, frames.
FILTERS = [(i % 5, (5 * i) % 12 % (12 - 6 + 1), 6 if i % 2 else 3, 4 + 4 * (i % 4)) for i in range(16)]
SPAN = max(f[3] for f in FILTERS)
#: Pairs that are compared at once.
PAIRS = 4096
#: Rendered recordings in one batch.
ROWS = 32
#: Outer limits of a filter's two bits.
LIMIT = 0.12


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Energy of the twelve pitch classes in each frame, smoothed over time; a silent frame is all 0."""
    if len(samples) < WINDOW:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, WINDOW)[::HOP]
    power = np.abs(np.fft.rfft(frames * np.hanning(WINDOW), axis=1)) ** 2
    pitch = np.arange(1, WINDOW // 2 + 1) * rate / WINDOW
    use = (pitch >= LOWEST) & (pitch <= HIGHEST)
    fold = np.zeros((WINDOW // 2 + 1, 12))
    fold[np.nonzero(use)[0] + 1, np.round(12 * np.log2(pitch[use] / 440)).astype(int) % 12] = 1
    image = power @ fold
    padded = np.pad(image, ((2, 2), (0, 0)), "edge")
    image = sum(w * padded[j : j + len(image)] for j, w in enumerate((0.25, 0.75, 1.0, 0.75, 0.25)))
    size = np.linalg.norm(image, axis=1, keepdims=True)
    return np.where(size > 1e-9, image / np.maximum(size, 1e-9), 0)


def fingerprint(image: np.ndarray) -> np.ndarray:
    """A 32-bit integer for each frame from which SPAN frames follow."""
    n = len(image) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    total = np.pad(image.cumsum(0).cumsum(1), ((1, 0), (1, 0)))

    def area(t0, t1, r0, r1):
        rows = total[:, r1] - total[:, r0]
        return rows[t1 : t1 + n] - rows[t0 : t0 + n]

    out = np.zeros(n, np.uint32)
    for kind, row, rows, width in FILTERS:
        top, half, third = row + rows, rows // 2, max(rows // 3, 1)
        whole = area(0, width, row, top)
        if kind == 0:
            b = area(0, width, row, row + half)
        elif kind == 1:
            b = area(0, width // 2, row, top)
        elif kind == 2:
            b = area(0, width // 2, row, row + half) + area(width // 2, width, row + half, top)
        elif kind == 3:
            b = area(0, width, row + third, top - third)
        else:
            b = area(width // 4, width - width // 4, row, top)
        value = np.log((1 + whole - b) / (1 + b))
        level = (value > -LIMIT).astype(np.uint32) + (value > 0) + (value > LIMIT)
        out = out << np.uint32(2) | (level ^ (level >> np.uint32(1))).astype(np.uint32)
    return out.view(np.int32)


def tones(rate: int, note: int) -> np.ndarray:
    """36 semitones from 220 Hz on, and silence, one row each."""
    ramp = np.sin(np.linspace(0, np.pi, note)) ** 0.25
    tone = np.stack([np.sin(2 * np.pi * 220 * 2 ** (k / 12) * np.arange(note) / rate) * ramp for k in range(36)])
    return np.append(tone, np.zeros((1, note)), 0)


def play(vector: list | None, tone: np.ndarray) -> bytes:
    """16-bit samples of a vector's notes."""
    x = np.array([np.nan if a is None else a for a in vector or []], float)
    pitch = np.clip(np.nan_to_num(18 + x * 6 * np.sqrt(max(len(x), 1)), nan=0), 0, 35).astype(int)
    return (tone[np.where(np.isnan(x), 36, pitch)].ravel() * 12000).astype("<i2").tobytes()


def listen(pcm: bytes | None, rate: int | None) -> np.ndarray:
    """The fingerprint of 16-bit samples; empty for null or too short sound."""
    if not pcm or not rate:
        return np.zeros(0, np.int32)
    return fingerprint(chroma(np.frombuffer(pcm[: len(pcm) // 2 * 2], "<i2").astype(float) / 32768, rate))


def render(vectors: DataFrame, rate: int = 4000, note: int = 512) -> DataFrame:
    """Recordings (id, rate, pcm) from ``vectors`` (vec_id, embedding): each number is a note of ``note`` samples.

    The tables hold no sound, so their vectors are played: a number of a unit vector's size falls on one of 36
    semitones. A null vector is silent and empty, a null number in one a silent note. ``pcm``: 16-bit little-endian.
    """

    def run(batches):
        tone = tones(rate, note)
        for b in batches:
            for low in range(0, len(b), ROWS):  # a few recordings at a time, for memory
                part = b.slice(low, ROWS)
                pcm = [play(v, tone) for v in part.column("embedding").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(np.full(len(part), rate), pa.int32()), pa.array(pcm, pa.binary())], ["id", "rate", "pcm"])

    return bounded(vectors).select("vec_id", "embedding").mapInArrow(run, T.StructType([T.StructField("id", vectors.schema["vec_id"].dataType), *T.StructType.fromDDL("rate int, pcm binary").fields]))


def fingerprints(media: DataFrame) -> DataFrame:
    """(id, fp) of ``media`` (id, rate, pcm); too short or null sound has an empty fingerprint.

    Arrow hands over as many rows at once as spark.sql.execution.arrow.maxRecordsPerBatch says: with long recordings
    set it low. ``vector_fingerprints`` plays and listens in one pass instead, so no sound is handed over.
    """

    def run(batches):
        for b in batches:
            out = [listen(p.as_py(), r.as_py()) for r, p in zip(b.column("rate"), b.column("pcm"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.list_(pa.int32()))], ["id", "fp"])

    return bounded(media).select("id", "rate", "pcm").mapInArrow(run, T.StructType([media.schema["id"], *T.StructType.fromDDL("fp array<int>").fields]))


def vector_fingerprints(vectors: DataFrame, rate: int = 4000, note: int = 512) -> DataFrame:
    """``fingerprints`` of ``render``, one recording in memory at a time."""

    def run(batches):
        tone = tones(rate, note)
        for b in batches:
            for low in range(0, len(b), 1000):
                part = b.slice(low, 1000)
                out = [listen(play(v.as_py(), tone), rate) for v in part.column("embedding")]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(out, pa.list_(pa.int32()))], ["id", "fp"])

    return bounded(vectors).select("vec_id", "embedding").mapInArrow(run, T.StructType([T.StructField("id", vectors.schema["vec_id"].dataType), *T.StructType.fromDDL("fp array<int>").fields]))


def levels(fp: np.ndarray, step: int) -> np.ndarray:
    """Bits of a fingerprint, or of several, as -1 and 1, (frame, bit); their means over ``step`` frames each, a rest left out."""
    fp = fp[..., : fp.shape[-1] // step * step]
    bits = 2.0 * ((fp.view(np.uint32)[..., None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)) - 1
    return bits.reshape(*fp.shape[:-1], -1, step, 32).mean(-2)


def _levels(prints: list[np.ndarray], step: int) -> list[np.ndarray]:
    """``levels`` of each print, those of one length at once."""
    out: list = [None] * len(prints)
    sizes: dict[int, list[int]] = {}
    for i, fp in enumerate(prints):
        sizes.setdefault(len(fp), []).append(i)
    for n, names in sizes.items():
        for low in range(0, len(names), more := max(1, PART // max(n, 1))):
            some = names[low : low + more]
            for i, means in zip(some, levels(np.stack([prints[k] for k in some]), step), strict=True):
                out[i] = means
    return out


def _spectra(values: list[np.ndarray], n: int) -> np.ndarray:
    """Transforms of 32 sequences, with zeros up to ``n``: (frequency, print, bit)."""
    padded = np.zeros((len(values), 32, n), np.float32 if n <= SHORT else np.float64)
    for i, v in enumerate(values):
        padded[i, :, : len(v)] = v.T
    return np.ascontiguousarray(np.fft.rfft(padded, axis=2).transpose(2, 0, 1))


def correlations(queries: list[np.ndarray], others: list[np.ndarray], overlap: int):
    """Places ``at`` that leave ``overlap`` frames, and sums of products of ``levels`` there: (first query, at, (at, query, other)).

    Of whole bits these are the equal less the different ones, but for rounding. At ``at``, frame i + at of the query
    lies beside frame i of the other. Some queries a time, for memory.
    """
    long, wide = max(map(len, queries)), max(map(len, others))
    at = np.arange(overlap - wide, long - overlap + 1)
    n = long + wide - overlap + 1  # places with less overlap may coincide, but with none of ``at``
    n += -n % max(1, 1 << max(n.bit_length() - 4, 0))  # of small factors
    q, c = _spectra(queries, n), _spectra(others, n)
    c = np.concatenate([c.real, c.imag], 2).transpose(0, 2, 1)
    f, m = len(q), len(others)
    angle = 2 * np.pi * (np.outer(at, np.arange(f)) % n) / n if n <= SHORT else None
    share = np.where((np.arange(f) == 0) | (2 * np.arange(f) == n), 1, 2) / n
    step = max(1, CELLS // (n * m))
    for low in range(0, len(queries), step):
        x = q[:, low : low + step]
        product = np.matmul(np.concatenate([np.concatenate([x.real, x.imag], 2), np.concatenate([x.imag, -x.real], 2)], 1), c)
        if angle is None:
            pairs = product.reshape(f, 2, -1, m)
            yield low, at, np.fft.irfft(pairs[:, 0] + 1j * pairs[:, 1], n, axis=0)[at % n]
        else:
            inverse = np.stack([np.cos(angle) * share, -np.sin(angle) * share], 2).reshape(len(at), 2 * f).astype(np.float32)
            yield low, at, (inverse @ product.reshape(2 * f, -1)).reshape(len(at), -1, m)


def _parts(prints: list[np.ndarray], least: int):
    """Runs of the prints of ``least`` frames or more by length, fewer where they are long."""
    index = sorted((i for i in range(len(prints)) if len(prints[i]) >= least), key=lambda i: len(prints[i]))
    run: list = []
    for i in index:
        if run and (len(run) + 1) * len(prints[i]) > PART:
            yield run
            run = []
        run.append(i)
    if run:
        yield run


def _overlaps(at: np.ndarray, own: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Frames that lie beside each other, (at, query, other); one column where all lengths are equal."""
    a, b = (x[:1] if (x == x[0]).all() else x for x in (own, size))
    return np.minimum(a[None, :, None] - np.maximum(at, 0)[:, None, None], b[None, None, :] - np.maximum(-at, 0)[:, None, None])


def align(queries: list[np.ndarray], others: list[np.ndarray], error: float = ERROR, overlap: int = OVERLAP):
    """Matches of fingerprints: (query, other, at, frames, hits, bit error) with places in the two lists.

    Of the places of a pair where at least ``overlap`` frames lie beside each other and at most ``error`` of their bits
    differ, that of most equal less different bits, then the nearest. ``hits`` are equal integers there.
    """
    overlap = max(overlap, 1)
    for two in _parts(others, overlap):
        size, theirs = np.array([len(others[j]) for j in two]), [levels(others[j], 1) for j in two]
        for every in _parts(queries, overlap):
            for low, at, equal in correlations([levels(queries[i], 1) for i in every], theirs, overlap):
                one = every[low : low + equal.shape[1]]
                frames = _overlaps(at, np.array([len(queries[i]) for i in one]), size)
                least = np.where(frames >= overlap, 32 * frames * (1 - 2 * error) - 0.5, np.inf)  # for rounding; then exactly
                near = np.nonzero((equal >= least.astype(equal.dtype)).any(axis=0))
                yield from _places(queries, others, [one[i] for i in near[0].tolist()], [two[j] for j in near[1].tolist()], error, overlap)


def _places(queries: list[np.ndarray], others: list[np.ndarray], one: list[int], two: list[int], error: float, overlap: int):
    """``align`` of the pairs ``one[n]``, ``two[n]``, bit by bit at every place."""
    sizes: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, j in zip(one, two, strict=True):
        sizes.setdefault((len(queries[i]), len(others[j])), []).append((i, j))
    for (n, m), pairs in sizes.items():
        for low in range(0, len(pairs), PAIRS):
            some = pairs[low : low + PAIRS]
            x, y = (np.stack([p[k] for k in ks]).view(np.uint32) for p, ks in zip((queries, others), zip(*some, strict=True), strict=True))
            top, place = np.full(len(some), np.iinfo(np.int64).min), np.zeros(len(some), np.int64)
            for at in sorted(range(overlap - m, n - overlap + 1), key=lambda a: (abs(a), -a)):  # of equal ones the first stays
                k = min(n - max(at, 0), m - max(-at, 0))
                wrong = np.bitwise_count(x[:, max(at, 0) : max(at, 0) + k] ^ y[:, max(-at, 0) : max(-at, 0) + k]).sum(axis=1, dtype=np.int64)
                better = (wrong <= error * 32 * k) & (32 * k - 2 * wrong > top)
                top[better], place[better] = 32 * k - 2 * wrong[better], at
            for (i, j), same, at in zip(some, top.tolist(), place.tolist(), strict=True):
                if same > np.iinfo(np.int64).min:
                    a, b = queries[i][max(at, 0) :], others[j][max(-at, 0) :]
                    k = min(len(a), len(b))
                    yield i, j, at, k, int((a[:k] == b[:k]).sum()), (32 * k - same) / 2 / (32.0 * k)


def _coarse(queries: list[np.ndarray], others: list[np.ndarray], step: int, overlap: int):
    """Mean products of levels by ``step``: (queries, others, coarse places, (at, query, other)); too little overlap is -inf."""
    least = max(1, overlap // step - 1)
    short = _levels(queries, step), _levels(others, step)
    for two in _parts(short[1], least):
        for every in _parts(short[0], least):
            for low, at, score in correlations([short[0][i] for i in every], [short[1][j] for j in two], least):
                one = every[low : low + score.shape[1]]
                frames = _overlaps(at, np.array([len(short[0][i]) for i in one]), np.array([len(short[1][j]) for j in two]))
                score *= (1 / (32 * np.maximum(frames, 1))).astype(score.dtype)
                if (frames < least).any():
                    score[np.broadcast_to(frames < least, score.shape)] = -np.inf
                yield one, two, at, score


def fit(queries: list[np.ndarray], others: list[np.ndarray], error: float = ERROR, overlap: int = OVERLAP) -> tuple[int, float]:
    """Step and threshold of the index by a sample; step 1: compare in full. A query's own fingerprint is no match."""
    truth = {(i, j): at for i, j, at, *_ in align(queries, others, error, overlap) if not np.array_equal(queries[i], others[j])}
    if len(truth) < FEW:
        return 1, 0.0
    for step in STEPS:
        found, every, scores = {}, 0, []
        for one, two, at, score in _coarse(queries, others, step, overlap):
            best = {i: n for n, i in enumerate(one)}, {j: n for n, j in enumerate(two)}
            for (i, j), place in truth.items():
                if i in best[0] and j in best[1]:
                    found[i, j] = score[np.abs(at * step - place) <= step // 2, best[0][i], best[1][j]].max(initial=-np.inf)
            scores.append(score[score > 0.2])  # far below any threshold of use
            every += len(one) * len(two)
        threshold = float(np.quantile([found.get(k, -np.inf) for k in truth], 1 - RECALL, method="lower")) - 0.01
        if threshold > 0.2 and sum(int((s >= threshold).sum()) for s in scores) * (step // 2 * 2 + 1) <= LOAD * every:
            return step, threshold
    return 1, 0.0


def align_by_index(queries: list[np.ndarray], others: list[np.ndarray], step: int, threshold: float, error: float = ERROR, overlap: int = OVERLAP):
    """``align`` of the pairs that have a match beside a coarse place of at least ``threshold``.

    Every place is at most half a step from a coarse one. What is near is gathered, CELLS of it at most, then compared by place.
    """
    overlap = max(overlap, 1)
    near: set[tuple[int, int]] = set()
    parts: list = []
    for one, two, at, score in _coarse(queries, others, step, overlap):
        d, rest = np.divmod(np.flatnonzero(score >= threshold), len(one) * len(two))
        i, j = np.divmod(rest, len(two))
        parts.append((at[d] * step, np.array(one)[i], np.array(two)[j]))
        if sum(len(p[0]) for p in parts) > CELLS:
            near.update(_near(queries, others, parts, step, error, overlap))
            parts = []
    near.update(_near(queries, others, parts, step, error, overlap))
    yield from _places(queries, others, [k for k, _ in sorted(near)], [k for _, k in sorted(near)], error, overlap)


def _near(queries: list[np.ndarray], others: list[np.ndarray], parts: list, step: int, error: float, overlap: int):
    """Of the (place, query, other) of ``parts`` the pairs that match at most half a step from the place; some repeat."""
    if not parts:
        return
    place, i, j = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(place, kind="stable")
    starts = np.append(np.unique(place[order], return_index=True)[1], len(order)).tolist()
    some = max(1, CELLS // max(map(len, [*queries, *others])))  # pairs at once, for memory
    for low, high in zip(starts[:-1], starts[1:], strict=True):
        at = int(place[order[low]])
        for start in range(low, high, some):
            pairs = order[start : min(start + some, high)]
            x, y = i[pairs].tolist(), j[pairs].tolist()
            hit = _beside([queries[k] for k in x], [others[k] for k in y], range(at - step // 2, at + step // 2 + 1), error, overlap)
            yield from ((x[k], y[k]) for k in hit)


def _rows(prints: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Prints as rows, with zeros up to the longest, and their lengths."""
    size = np.array([len(p) for p in prints])
    if (size == size[0]).all():
        return np.stack(prints).view(np.uint32), size
    out = np.zeros((len(prints), int(size.max())), np.uint32)
    for row, p in zip(out, prints, strict=True):
        row[: len(p)] = p.view(np.uint32)
    return out, size


def _beside(left: list[np.ndarray], right: list[np.ndarray], places: range, error: float, overlap: int) -> list[int]:
    """Which pairs of prints match at some of ``places``."""
    (x, own), (y, size) = _rows(left), _rows(right)
    found = np.zeros(len(left), bool)
    for place in places:
        first, second = max(place, 0), max(-place, 0)
        k = np.minimum(own - first, size - second)
        if (most := int(k.max())) < overlap:
            continue
        apart = x[:, first : first + most] ^ y[:, second : second + most]
        if (k < most).any():
            apart[np.arange(most) >= k[:, None]] = 0
        even = most & ~1
        wrong = np.bitwise_count(np.ascontiguousarray(apart[:, :even]).view(np.uint64)).sum(axis=1, dtype=np.int64)
        if even < most:
            wrong += np.bitwise_count(apart[:, even])
        found |= (k >= overlap) & (wrong <= error * 32 * k)
    return np.nonzero(found)[0].tolist()


def _prints(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The arrays of a column of lists of int."""
    lists = column.combine_chunks()
    flat, ends = lists.flatten().to_numpy().astype(np.int32, copy=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(flat, ends[:-1]) if len(ends) else []


def _matches(step: int, threshold: float, error: float, overlap: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lists = [_prints(t.column("fp")) for t in (left, right)]
        ids = [t.column(c).combine_chunks() for t, c in ((left, "query"), (right, "class_id"))]
        found = list(align(*lists, error, overlap) if step == 1 else align_by_index(*lists, step, threshold, error, overlap))
        i, j, *rest = (list(x) for x in zip(*found, strict=True)) if found else [[]] * 6
        columns = [ids[0].take(pa.array(i, pa.int64())), ids[1].take(pa.array(j, pa.int64()))]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.float64()]
        return pa.table([*columns, *(pa.array(x, k) for x, k in zip(rest, kinds, strict=True))], ["query", "class_id", "at", "frames", "hits", "bit_error"])

    return run


def matches(heads: DataFrame, error: float = ERROR, overlap: int = OVERLAP, exact: bool = False) -> DataFrame:
    """Matches of the rows of ``heads`` (class_id, fp, asks) that ask with all others, in blocks: a task for each pair of them.

    ``exact``: every place of every pair is compared in full. Else by the index, where a sample has matches enough to fit it.
    """
    short = heads.where(F.size("fp") <= FRAMES)
    sample = [] if exact else [short.where(w).orderBy(F.xxhash64("class_id")).select("fp").limit(n).toArrow().column("fp") for w, n in ((F.col("asks") == 1, ASKED), (F.lit(True), KNOWN))]  # bounded
    step, threshold = (1, 0.0) if exact else fit(*([np.array(x, np.int32) for x in s.to_pylist()] for s in sample), error, overlap)
    n, asking = heads.count(), heads.where(F.col("asks") == 1).count()
    rows, columns = max(1, -(-asking // QUERIES)), max(1, -(-n // CLASSES))
    block = lambda k: F.pmod(F.xxhash64("class_id"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = heads.where(F.col("asks") == 1).select(F.col("class_id").alias("query"), "fp", block(rows).alias("i")).withColumn("j", every(columns))
    right = heads.select("class_id", "fp", block(columns).alias("j")).withColumn("i", every(rows))
    kind = heads.schema["class_id"].dataType
    schema = T.StructType([T.StructField("query", kind), T.StructField("class_id", kind), *T.StructType.fromDDL("at int, frames int, hits long, bit_error double").fields])
    one, two = (d.repartition(rows * columns, "i", "j").groupBy("i", "j") for d in (left, right))
    return one.cogroup(two).applyInArrow(_matches(step, threshold, error, overlap), schema).where(F.col("query") != F.col("class_id"))


def search(prints: DataFrame, is_query, error: float = ERROR, overlap: int = OVERLAP, exact: bool = False) -> DataFrame:
    """Align the queries among ``prints`` (id, fp) with all recordings; ``exact`` asks for all matches, without the index.

    Rows of kind ``member``: class_id and recording_id of every row; equal fingerprints are one class, named by its
    least id, and an empty fingerprint is a class of its own. Rows of kind ``match``: class_id is a class with a query
    in it, recording_id the class that it matches, with ``at`` (frames by which the query is later), ``frames`` of
    overlap, ``hits`` and ``bit_error``. Repeated rows keep their member rows; null ids are members of classes.
    """
    own = F.when(F.size("fp") > 0, F.md5(F.array_join("fp", ","))).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    keyed = stored(prints.select("id", "fp", own.alias("key"), is_query.alias("q")), "prints")
    groups = stored(keyed.groupBy("key").agg(F.min("id").alias("class_id"), F.max(F.col("q").cast("int")).alias("q")), "groups")
    members = spread_join(keyed.select("id", "key"), groups.select("key", "class_id"), "key", ["id"], "inner")
    sound = groups.where(F.col("class_id").isNotNull())
    # Joined by class and id both, so the copies of a recording don't meet in one task.
    head = keyed.where(F.size("fp") > 0).select("key", F.col("id").alias("class_id"), "fp").join(sound.select("key", "class_id", F.col("q").alias("asks")), ["key", "class_id"])
    heads = stored(head.select("class_id", "fp", "asks").dropDuplicates(["class_id"]), "heads")
    found = stored(matches(heads, error, overlap, exact), "matches")
    found = found.select(F.lit("match").alias("kind"), F.col("query").alias("class_id"), F.col("class_id").alias("recording_id"), "at", "frames", "hits", "bit_error")
    none = {"at": "int", "frames": "int", "hits": "long", "bit_error": "double"}
    return found.unionByName(members.select(F.lit("member").alias("kind"), "class_id", F.col("id").alias("recording_id"), *(F.lit(None).cast(t).alias(c) for c, t in none.items())))
