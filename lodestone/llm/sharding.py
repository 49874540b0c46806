"""Sharding by best-fit-decreasing bin packing over groups that stay whole.

Groups (equal texts) are placed by falling size, each into the shard with the least room that still takes it; a
balanced tree finds that shard. Groups of one size are placed as a run: the tightest shard takes as many as fit, which
is what placing them one by one does. The driver therefore packs a histogram of exact sizes, never a list of groups.
Different sizes add up to the whole input at most, so of T bytes the histogram has at most sqrt(2 T) rows: 14 million
for 100 TB if every size up to 14 MB occurs, in fact as many as there are lengths of texts. Ranks within a size and
slots within a shard come from a range sort and the counts of its partitions.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import small, spread_join, stored

SHARDS = 24
OVERHEAD = 8
#: The search for the least capacity ends within this share of it.
PRECISION = 1e-5


class CapacityTree:
    """A balanced (AA) tree of (room, bin): insert, remove, and the least entry that has at least some room."""

    def __init__(self) -> None:
        self.root = None

    # A node is [key, level, left, right].
    @staticmethod
    def _skew(n):
        if n and n[2] and n[2][1] == n[1]:
            left = n[2]
            n[2], left[3] = left[3], n
            return left
        return n

    @staticmethod
    def _split(n):
        if n and n[3] and n[3][3] and n[3][3][1] == n[1]:
            right = n[3]
            n[3], right[2] = right[2], n
            right[1] += 1
            return right
        return n

    def _add(self, n, key):
        if not n:
            return [key, 1, None, None]
        side = 2 if key < n[0] else 3
        n[side] = self._add(n[side], key)
        return self._split(self._skew(n))

    def _cut(self, n, key):
        if not n:
            return None
        if key == n[0]:
            if not n[2] and not n[3]:
                return None
            side = 2 if n[2] else 3
            m = n[side]
            while m[5 - side]:
                m = m[5 - side]
            n[0] = m[0]
            n[side] = self._cut(n[side], m[0])
        else:
            side = 2 if key < n[0] else 3
            n[side] = self._cut(n[side], key)
        level = min(n[2][1] if n[2] else 0, n[3][1] if n[3] else 0) + 1
        if level < n[1]:
            n[1] = level
            if n[3] and n[3][1] > level:
                n[3][1] = level
        n = self._skew(n)
        n[3] = self._skew(n[3])
        if n[3]:
            n[3][3] = self._skew(n[3][3])
        n = self._split(n)
        n[3] = self._split(n[3])
        return n

    def insert(self, room: int, number: int) -> None:
        self.root = self._add(self.root, (room, number))

    def remove(self, room: int, number: int) -> None:
        self.root = self._cut(self.root, (room, number))

    def tightest(self, size: int) -> tuple[int, int] | None:
        n, best = self.root, None
        while n:
            if n[0] >= (size, -1):
                best, n = n[0], n[2]
            else:
                n = n[3]
        return best


def best_fit_decreasing(runs: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int, int]] | None:
    """Pack ``runs`` (size, how many) into bins of ``capacity``: (size, first, last + 1, bin) by rank within a size.

    Opens bins as needed; None if more than ``most`` would be needed. A size over the capacity gets bins of its own.
    """
    tree, bins, out = CapacityTree(), 0, []
    for size, n in sorted(runs, reverse=True):
        done = 0
        while done < n:
            if (best := tree.tightest(size)) is None:
                if most is not None and bins == most:
                    return None
                best, bins = (max(capacity, size), bins), bins + 1
            else:
                tree.remove(*best)
            room, number = best
            fit = min(n - done, room // size if size else n - done)
            out.append((size, done, done + fit, number))
            done += fit
            tree.insert(room - fit * size, number)
    return out


def pack(runs: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """Best fit decreasing into ``shards`` bins, at the least capacity (by bisection, to PRECISION) for which it needs no more."""
    total, largest = sum(s * n for s, n in runs), max((s for s, _ in runs), default=0)
    low = max(-(-total // shards), largest)
    high, best = low + largest, None
    if (found := best_fit_decreasing(runs, low, shards)) is not None:
        return found
    while high - low > PRECISION * low:
        mid = (low + high) // 2
        if (found := best_fit_decreasing(runs, mid, shards)) is None:
            low = mid + 1
        else:
            best, high = found, mid
    return best if best is not None else best_fit_decreasing(runs, high, shards)


def numbered(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: the place of each row among those of its ``key``, gapless from 0, by ``order``."""
    rows = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    rows = stored(rows.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")), "numbered")
    runs = rows.groupBy("_part", key).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = stored(runs.select("_part", key, (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift")), "runs")
    return rows.join(small(runs), ["_part", key]).withColumn(name, F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``: shards of near equal size. Equal texts stay together, so a group larger than a shard's share
    fills its shard beyond it. A null text has size 8 and the checksum of no bytes, 0; null texts are a group apart
    from empty ones. Repeated rows keep their rows. Other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")).alias("group"),
    )
    rows = stored(rows, "sized")
    groups = numbered(rows.groupBy("group").agg(F.sum("size").alias("total")), "total", ["group"], "rank")
    sizes = groups.groupBy("total").count().toArrow()  # a row a size
    spans = pack(list(zip(sizes.column(0).to_pylist(), sizes.column(1).to_pylist(), strict=True)), shards)
    spans = docs.sparkSession.createDataFrame(pa.table(dict(zip(("total", "since", "until", "shard"), map(list, zip(*spans, strict=True)), strict=True)) if spans else {k: pa.array([], pa.int64()) for k in ("total", "since", "until", "shard")}))
    placed = groups.join(small(spans), "total").where((F.col("rank") >= F.col("since")) & (F.col("rank") < F.col("until")))
    placed = stored(placed.select("group", F.col("shard").cast("int").alias("shard")), "placed")
    found = numbered(spread_join(rows, placed, "group", ["doc_id"], "inner"), "shard", ["doc_id", "group"], "slot")
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, assigned: DataFrame, path: str) -> None:
    """Write ``docs`` (doc_id unique) as one folder a shard, in the order of their slots."""
    docs.join(assigned.select("doc_id", "shard", "slot"), "doc_id").repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
