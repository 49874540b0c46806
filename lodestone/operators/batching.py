"""Batches under a limit, and runs that stop when enough is there."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.ordering import kept, row_numbers, tile


def _next_break(durations: np.ndarray, start: int, total: float, limit: float) -> tuple[int, float]:
    """Where a batch with ``total`` so far (none: nan) ends that takes rows from ``start``, and what it has by then.

    Totals are added up row by row, so they round as in one scan.
    """
    step = 256
    first = np.isnan(total)
    while start < len(durations):
        some = durations[start : start + step]
        sums = np.cumsum(some if first else np.append(total, some))[0 if first else 1 :]
        over = sums > limit
        if first:
            over[0] = False  # a row above the limit is a batch of its own
        if over.any():
            k = int(over.argmax())
            return start + k, float(sums[k - 1]) if k else total
        start, total, first, step = start + len(some), float(sums[-1]), False, step * 2
    return len(durations), total


def _ends(t: pa.Table, duration: str, limit: float) -> pa.Table:
    """How a segment hands on what it is handed: its head, and the batch open at its end for each row where one may begin.

    A batch begins at the first row, or at the first one that makes the batch from before too large: within the head, which
    is the rows up to a sum above the limit.
    """
    t = t.sort_by("number")
    d = np.nan_to_num(t[duration].to_numpy(zero_copy_only=False).astype(float))
    head = min(len(d), int(np.searchsorted(np.cumsum(np.maximum(d, 0)), limit, "right")) + 1)
    known: dict[int, tuple[int, float]] = {}
    for start in range(head):
        path, at = [], start
        while at not in known:
            end, total = _next_break(d, at, float("nan"), limit)
            path.append(at)
            if end >= len(d):
                known[at] = (at, total)
                break
            at = end
        for p in path:
            known[p] = known[at]
    ends = [known[p] for p in range(head)]
    numbers = t["number"].to_numpy()
    row = {"tile": t["tile"][0].as_py(), "segment": t["segment"][0].as_py(), "whole": head == len(d), "head": d[:head].tolist(), "numbers": numbers[:head].tolist(), "last": [int(numbers[a]) for a, _ in ends], "total": [b for _, b in ends]}
    return pa.Table.from_pylist([row], schema=_ENDS)


_ENDS = pa.schema([("tile", pa.int64()), ("segment", pa.int64()), ("whole", pa.bool_()), ("head", pa.list_(pa.float64())), ("numbers", pa.list_(pa.int64())), ("last", pa.list_(pa.int64())), ("total", pa.list_(pa.float64()))])


def _carry(t: pa.Table, limit: float) -> pa.Table:
    """The batch that is open when each segment of a tile begins: its first row's number and its total."""
    out, open_, total = [], None, float("nan")
    for s in t.sort_by("segment").to_pylist():
        out.append({"tile": s["tile"], "segment": s["segment"], "open": open_, "so_far": None if open_ is None else total})
        head = np.array(s["head"])
        k, so_far = _next_break(head, 0, total, limit) if open_ is not None else (0, total)
        if k < len(head):
            open_, total = s["last"][k], s["total"][k]
        else:  # the whole segment goes into the open batch
            total = so_far
    return pa.Table.from_pylist(out, schema=pa.schema([("tile", pa.int64()), ("segment", pa.int64()), ("open", pa.int64()), ("so_far", pa.float64())]))


def duration_batches(rows: DataFrame, key: str, duration: str, buckets: int, limit: float, segment: int = 100_000) -> DataFrame:
    """(key, duration, tile, batch): rows by duration in ``buckets`` tiles, each cut into batches of at most ``limit``.

    A batch takes rows in order until the next would go beyond the limit; a row above the limit is a batch of its own. A
    batch's name is the number of its first row. Null durations count as 0 and come first; negative ones are an error.

    A tile is cut by many tasks, each with ``segment`` rows at most: they first find, for each row of a segment's head where a
    batch may begin, which batch is open at its end; one pass over these heads (a batch's rows of each segment) tells what
    each segment begins with; then all segments are cut. So the result does not depend on the segments.
    """
    positive = F.when(F.col(duration) < 0, F.raise_error("a duration is negative").cast(rows.schema[duration].dataType)).otherwise(F.col(duration))
    numbered = row_numbers(rows.select(key, positive.alias(duration)), [duration, key], "number")
    tiled = numbered.withColumn("tile", tile(F.col("number"), numbered.count(), buckets).cast("long")).withColumn("segment", F.floor((F.col("number") - 1) / segment))
    of = tiled.groupBy("tile", "segment")
    heads = of.applyInArrow(lambda t: _ends(t, duration, limit), "tile long, segment long, whole boolean, head array<double>, numbers array<long>, last array<long>, total array<double>")
    begun = kept(heads.groupBy("tile").applyInArrow(lambda t: _carry(t, limit), "tile long, segment long, open long, so_far double"))

    def cut(t: pa.Table) -> pa.Table:
        t = t.sort_by("number")
        d = np.nan_to_num(t[duration].to_numpy(zero_copy_only=False).astype(float))
        numbers = t["number"].to_numpy()
        batch = np.zeros(len(d), np.int64)
        at, name, total = 0, t["open"][0].as_py(), t["so_far"][0].as_py()
        while at < len(d):
            fresh = name is None
            end, _ = _next_break(d, at, float("nan") if fresh else total, limit)
            batch[at:end] = numbers[at] if fresh else name
            at, name = end, None
        return t.select([key, duration, "tile"]).append_column("batch", pa.array(batch))

    schema = T.StructType([tiled.schema[key], tiled.schema[duration], T.StructField("tile", T.LongType()), T.StructField("batch", T.LongType())])
    return tiled.join(begun, ["tile", "segment"]).groupBy("tile", "segment").applyInArrow(cut, schema)


def until_valid(groups: DataFrame, key: str, order: str, valid: str, wanted: int) -> DataFrame:
    """Groups in the order of their completion up to the one that makes ``wanted`` valid ones; all, if there are fewer.

    Valid groups are numbered by range partitions, so no group and no order is gathered in one task.
    """
    good = row_numbers(groups.where(valid).select(key, order), [order, key], "number")
    last = good.where(F.col("number") == wanted).select(F.struct(order, key).alias("last")).first()
    if last is None:
        return groups
    stop = last["last"]
    return groups.where(F.struct(order, key) <= F.struct(F.lit(stop[order]).alias(order), F.lit(stop[key]).alias(key)))


def until_full(rows: DataFrame, batch: str, key: str, wanted: int, most: int) -> DataFrame:
    """Filtered rows of batch after batch until ``wanted`` are there, those beyond left out by key.

    More than ``most`` batches are not tried: that is an error. One pass counts the batches' rows.
    """
    sizes = rows.groupBy(batch).agg(F.count("*").alias("n")).orderBy(batch).limit(most).collect()  # ``most`` rows
    total, whole, last, rest = 0, [], None, 0
    for b, n in sizes:
        if total + n >= wanted:
            last, rest = b, wanted - total
            break
        whole.append(b)
        total += n
    if last is None:
        raise ValueError(f"{total} of {wanted} rows after {len(sizes)} batches of at most {most}")
    return rows.where(F.col(batch).isin(whole)).unionByName(rows.where(F.col(batch) == last).orderBy(key).limit(rest))
