"""Product codes of vectors: integer Lloyd rounds that skip most distances by Yinyang's group bounds.

Entries of a codebook are put into groups once. A vector's part keeps an upper bound of the distance to its entry and, for each
group, a lower bound of the distance to the group's other entries. After a round an entry has moved by its drift, so bounds
move by that much; only groups whose lower bound is no longer above the upper bound are scanned. Bounds are whole numbers
rounded outwards and distances are exact integers, so ties are seen and go to the lower index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bounded, discard, freed, spread_join, stored
from lodestone.llm.vectors import whole_vectors

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Groups of a codebook's entries: one lower bound each.
GROUPS = 16
#: Beyond this component, distances don't fit the mantissa of a double and are summed as integers.
_MANTISSA = 1 << 22


@dataclass
class Codebook:
    """Entries of one part, their groups, and how far each entry (rounded up) moved in the last round."""

    entries: np.ndarray
    group: np.ndarray
    drift: np.ndarray

    @property
    def groups(self) -> int:
        return int(self.group.max()) + 1 if len(self.group) else 0


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` and ``c``."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) * max(x.shape[1], 1) ** 0.5 <= _MANTISSA:
        f, g = x.astype(np.float64), c.astype(np.float64)
        return ((f * f).sum(1)[:, None] - 2 * (f @ g.T) + (g * g).sum(1)).astype(np.int64)
    out = np.zeros((len(x), len(c)), np.int64)
    for j in range(x.shape[1]):
        out += (x[:, j, None] - c[:, j]) ** 2
    return out


def below(d: np.ndarray) -> np.ndarray:
    """A whole number not above the root."""
    return np.floor(np.sqrt(d.astype(np.float64)) * (1 - 1e-12)).astype(np.int64)


def above(d: np.ndarray) -> np.ndarray:
    """A whole number not below the root."""
    return np.ceil(np.sqrt(d.astype(np.float64)) * (1 + 1e-12)).astype(np.int64)


def grouped(entries: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """A group of each entry, by a few rounds of Lloyd among the entries themselves."""
    groups = max(1, min(groups, len(entries)))
    centre = entries[np.linspace(0, len(entries) - 1, groups).astype(int)].astype(np.float64)
    for _ in range(5):
        own = ((entries[:, None] - centre) ** 2).sum(2).argmin(1)
        for g in range(groups):
            if (own == g).any():
                centre[g] = entries[own == g].mean(0)
    return np.unique(own, return_inverse=True)[1]


def _least(d: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, the lower index of equal ones; ``index`` is ascending."""
    at = d.argmin(1)
    return index[at], d[np.arange(len(d)), at]


_FAR = np.int64(1) << 60


def assign_all(x: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first assignment: entry, upper bound, lower bound of each group without the entry itself."""
    d = squared(x, book.entries)
    own, best = _least(d, np.arange(len(book.entries)))
    d[np.arange(len(x)), own] = _FAR
    low = np.stack([below(d[:, book.group == g].min(1)) for g in range(book.groups)], 1)
    return own, above(best), low


def assign_again(x: np.ndarray, book: Codebook, own: np.ndarray, up: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The assignment after entries moved, with new bounds and the number of distances that were worked out."""
    # no entry of a group came nearer than by the group's largest drift
    low = np.maximum(low - np.array([book.drift[book.group == g].max() for g in range(book.groups)]), 0)
    own, up = own.copy(), up + book.drift[own]
    rows = np.nonzero(low.min(1) <= up)[0]  # equality may be a tie
    if not len(rows):
        return own, up, low, 0
    # the exact distance to the own entry mends the upper bound, which closes most groups
    part, bound, before = x[rows], low[rows], own[rows]
    kept = ((part.astype(np.int64) - book.entries[before]) ** 2).sum(1)
    at, best, worked = before.copy(), kept.copy(), len(rows)
    near, first, second = (np.full(bound.shape, v, np.int64) for v in (-1, _FAR, _FAR))
    for g in range(book.groups):
        scan = np.nonzero(bound[:, g] <= above(best))[0]
        if not len(scan):
            continue
        index = np.nonzero(book.group == g)[0]
        d = squared(part[scan], book.entries[index])
        worked += d.size
        near[scan, g], first[scan, g] = _least(d, index)
        if len(index) > 1:
            second[scan, g] = np.partition(d, 1, 1)[:, 1]
        won = (first[scan, g] < best[scan]) | ((first[scan, g] == best[scan]) & (near[scan, g] < at[scan]))
        at[scan[won]], best[scan[won]] = near[scan[won], g], first[scan[won], g]
    # a group scanned is bounded by its nearest entry but the own one; one not scanned may have got back the entry left
    bound = np.where(near < 0, bound, below(np.where(near == at[:, None], second, first)))
    left = np.nonzero((at != before) & (near[np.arange(len(rows)), book.group[before]] < 0))[0]
    there = book.group[before[left]]
    bound[left, there] = np.minimum(bound[left, there], below(kept[left]))
    own[rows], up[rows], low[rows] = at, above(best), bound
    return own, up, low, worked


_BOUNDS = ("own", "up", "low")
_KINDS = "own array<int>, up array<int>, low array<int>, sums array<bigint>"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _lists(rows: np.ndarray) -> pa.Array:
    flat = np.minimum(rows, np.iinfo(np.int32).max).astype(np.int32)
    return pa.ListArray.from_arrays(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1], flat.ravel())


def _step(books: list[Codebook], carried: list[str], first: bool) -> Callable:
    """Batches of vectors and their bounds to batches with new bounds; a task's last row has its sums by entry instead."""
    width = books[0].entries.shape[1]
    cut = np.cumsum([0, *(b.groups for b in books)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(books), len(books[0].entries), width + 1), np.int64)  # the last one of each entry counts
        worked = rows = 0
        for batch in batches:
            if not (n := batch.num_rows):
                continue
            x = _matrix(batch["x"], width * len(books))
            if first:
                own, up, low = (np.zeros((n, w), np.int64) for w in (len(books), len(books), cut[-1]))
            else:
                own, up, low = (_matrix(batch[c], w).astype(np.int64) for c, w in zip(_BOUNDS, (len(books), len(books), cut[-1]), strict=True))
            for p, book in enumerate(books):
                part, mine = x[:, p * width : (p + 1) * width], slice(cut[p], cut[p + 1])
                if first:
                    own[:, p], up[:, p], low[:, mine] = assign_all(part, book)
                    worked += n * len(book.entries)
                else:
                    own[:, p], up[:, p], low[:, mine], some = assign_again(part, book, own[:, p], up[:, p], low[:, mine])
                    worked += some
                np.add.at(sums[p, :, :width], own[:, p], part)
                sums[p, :, width] += np.bincount(own[:, p], minlength=len(book.entries))
            rows += n
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in carried), _lists(own), _lists(up), _lists(low), pa.nulls(n, pa.list_(pa.int64()))], names=[*carried, *_BOUNDS, "sums"])
            kinds = [batch[c].type for c in carried]
        if rows:
            empty = [pa.nulls(1, kind) for kind in [*kinds, *[pa.list_(pa.int32())] * 3]]
            yield pa.RecordBatch.from_arrays([*empty, pa.array([np.append(sums.ravel(), [worked, rows])], pa.list_(pa.int64()))], names=[*carried, *_BOUNDS, "sums"])

    return run


def _moved(book: Codebook, sums: np.ndarray) -> Codebook:
    """Entries replaced by the floors of their parts' means; unused ones stay."""
    n = sums[:, -1]
    used = n > 0
    new = book.entries.copy()
    new[used] = sums[used, :-1] // n[used, None]
    return Codebook(new, book.group, above(((new - book.entries) ** 2).sum(1)))


@dataclass
class Trained:
    """Codebooks of all parts; rows with their vectors ``x`` and, as own, their entries; distances worked out, and of all, by round."""

    books: list[Codebook]
    rows: DataFrame
    worked: list[tuple[int, int]]

    def sha256(self) -> str:
        """Of all entries' integers by part, entry and position within the part, joined by commas."""
        return hashlib.sha256(",".join(str(v) for b in self.books for v in b.entries.ravel().tolist()).encode()).hexdigest()


def train(vectors: DataFrame, id: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Trained | None:
    """Codebooks fitted to all rows of ``vectors`` (columns ``id``, ``x`` array<int> and any others), and each row's entries.

    Codebooks start as the parts of the ``entries`` smallest ids (null ids last, equal ids by vector); there are fewer where
    there are fewer rows. ``rounds`` times all rows are assigned and entries moved; then rows are assigned once more. Rows
    whose vector is not as long as the first one's take no part; that length must be a multiple of ``parts``. None if there
    is no row.

    Each round is one pass: it reads vectors and bounds, and writes new bounds and, in one row a task, sums by entry, which
    Spark adds up; the driver gets one sum for each number of the codebooks. The previous round's table is deleted.
    """
    order = (F.col(id).asc_nulls_last(), "x")
    first = vectors.orderBy(*order).select("x").first()
    if first is None:
        return None
    width, rest = divmod(len(first["x"]), parts)
    if rest:
        raise ValueError(f"vectors of {len(first['x'])} components can't be cut into {parts} equal parts")
    vectors = vectors.where(F.size("x") == width * parts)
    seed = [r["x"] for r in vectors.orderBy(*order).select("x").limit(entries).collect()]
    start = np.array(seed, np.int64).reshape(len(seed), parts, width)
    books = [Codebook(start[:, p], grouped(start[:, p]), np.zeros(len(start), np.int64)) for p in range(parts)]
    rows = bounded(vectors)
    carried = rows.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    worked, state = [], None
    for turn in range(rounds + 1):
        done = stored(rows.mapInArrow(freed(_step(books, carried, turn == 0)), f"{kinds}, {_KINDS}"), f"codes-{turn}")
        if state is not None:
            discard(state)
        state, rows = done, done.where("sums is null").drop("sums")
        # only the column of sums is read here
        sums = done.where("sums is not null").select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
        flat = np.zeros(len(sums), np.int64)
        for r in sums:
            flat[r["at"]] = r["v"]
        worked.append((int(flat[-2]), int(flat[-1]) * parts * len(start)))
        if turn < rounds:
            by_part = flat[:-2].reshape(parts, len(start), width + 1)
            books = [_moved(b, s) for b, s in zip(books, by_part, strict=True)]
    return Trained(books, rows.drop("up", "low"), worked)


def _coded(books: list[Codebook], carried: list[str]) -> Callable:
    """Code and exact error of each row whose entries are known."""
    digits = np.array([f"{k:02x}" for k in range(max(ENTRIES, len(books[0].entries)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _matrix(batch["own"], len(books))
            at = np.concatenate([b.entries[own[:, p]] for p, b in enumerate(books)], 1)
            error = ((_matrix(batch["x"], at.shape[1]).astype(np.int64) - at) ** 2).sum(1)
            code = ["".join(r) for r in digits[own].tolist()]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in carried), pa.array(code, pa.string()), pa.array(error)], names=[*carried, "code", "error"])

    return run


def encode(trained: Trained) -> DataFrame:
    """The trained rows with ``code`` (two hex digits a part) and ``error`` (squared distance to what the code stands for) in place of ``x``."""
    carried = [c for c in trained.rows.columns if c not in ("x", "own")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in trained.rows.schema if f.name in carried)
    return trained.rows.mapInArrow(_coded(trained.books, carried), f"{kinds}, code string, error bigint".removeprefix(", "))


def decode(codes: DataFrame, trained: Trained, code: str = "code", vector: str = "vector", scale: int = SCALE) -> DataFrame:
    """``codes`` with the vector (array<double>) that each code stands for; null codes have none."""
    pieces = []
    for p, book in enumerate(trained.books):
        k = F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int")
        pieces.append(F.get(F.array(*(F.array(*map(F.lit, e)) for e in (book.entries / scale).tolist())), k))
    return codes.withColumn(vector, F.concat(*pieces))


def compress(embeddings: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """id, code, error, label_error and codebooks_sha256 of each usable row of ``embeddings``.

    Rows whose vector is null or has null or non-finite components are left out. Repeated rows are rows of their own and have
    equal codes; a null id is a result with a null id; null labels are one label. Other columns are not read. No usable row
    gives an empty result. Components beyond 2^24 after scaling are an error, as sums would not be exact.
    """
    rows = whole_vectors(embeddings.select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(vector).alias("x")), "x", SCALE)
    trained = train(rows, "id")
    if trained is None:
        return embeddings.sparkSession.createDataFrame([], embeddings.select(F.col(id).alias("vec_id")).schema.add("code", "string").add("error", "long").add("label_error", "long").add("codebooks_sha256", "string"))
    coded = encode(trained).withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    coded = stored(coded, "coded")
    totals = coded.groupBy("key").agg(F.sum("error").alias("label_error"))
    out = spread_join(coded, totals, "key", ["id", "code", "error", F.spark_partition_id()], "inner")
    return out.select(F.col("id").alias(id), "code", "error", "label_error", F.lit(trained.sha256()).alias("codebooks_sha256"))


def oracle_sql() -> str:
    """DuckDB SQL: codebooks of each round as a table, assignments by a join with all entries."""
    with_ = [
        """k AS (SELECT vec_id, label, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
        "w AS MATERIALIZED (SELECT max(len(v)) // 4 AS w FROM k)",
        "p AS MATERIALIZED (SELECT vec_id, label, part, v[part * w + 1:part * w + w] AS x FROM k, w, range(4) t(part))",
        "b0 AS MATERIALIZED (SELECT part, e, x AS c FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e FROM p) WHERE e < 256)",
    ]
    near = "SELECT vec_id, label, p.part, x, min(CAST(list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS BIGINT) * 256 + e) AS d FROM p JOIN b{} b ON p.part = b.part GROUP BY ALL"
    for r in range(ROUNDS):
        with_.append(f"a{r} AS MATERIALIZED ({near.format(r)})")
        with_.append(f"m{r} AS (SELECT part, d % 256 AS e, i, floor(sum(x[i]) / count(*)) AS y FROM a{r}, w, range(1, w + 1) t(i) GROUP BY ALL)")
        with_.append(f"b{r + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(n.c, b.c) AS c FROM b{r} b LEFT JOIN (SELECT part, e, list(y ORDER BY i) AS c FROM m{r} GROUP BY ALL) n ON b.part = n.part AND b.e = n.e)")
    with_.append(f"f AS MATERIALIZED ({near.format(ROUNDS)})")
    with_.append("r AS (SELECT vec_id, label, string_agg(printf('%02x', d % 256), '' ORDER BY part) AS code, CAST(sum(d // 256) AS BIGINT) AS error FROM f GROUP BY ALL)")
    with_.append(f"s AS (SELECT sha256(string_agg(CAST(CAST(c[i] AS BIGINT) AS VARCHAR), ',' ORDER BY part, e, i)) AS codebooks_sha256 FROM b{ROUNDS}, w, range(1, w + 1) t(i))")
    return "WITH " + ",\n".join(with_) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r, s"
