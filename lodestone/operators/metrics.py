"""Latency statistics, percentiles and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ordering import row_numbers


def finite(c: Column) -> Column:
    """Null for infinity and not-a-number."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def latency_stats(rows: DataFrame, value: str) -> DataFrame:
    """n, mean, median, low, high and total of positive values. The median is picked by rank, not from one buffer."""
    v = rows.where(F.col(value) > 0).select(F.col(value).alias("v"))
    counts = v.agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"), F.sum("v").alias("total"))
    ranked = row_numbers(v, ["v"], "r").crossJoin(F.broadcast(counts.select("n")))
    middle = ranked.where((F.col("r") == F.floor((F.col("n") + 1) / 2)) | (F.col("r") == F.floor(F.col("n") / 2) + 1)).agg(F.avg("v").alias("median"))
    return counts.crossJoin(middle).select("n", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "low", "high", F.round("total", 2).alias("total"))


def exclusive_percentiles(rows: DataFrame, group: str, value: str, percents: list[int]) -> DataFrame:
    """(group, p, value): exclusive percentiles of positive values; few values extrapolate.

    Values are numbered by range partitions and the counts of groups, so no group is sorted in one task or collected in
    one row; then the values at the two places that a percentile needs are picked.
    """
    v = rows.where(F.col(value) > 0).select(group, F.col(value).alias("v"))
    ranked = row_numbers(v, [group, "v"], "at")
    sizes = ranked.groupBy(group).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    places = sizes.withColumn("p", F.explode(F.array(*map(F.lit, percents))))
    places = places.withColumn("j", F.greatest(F.lit(1), F.least(F.col("n") - 1, F.floor((F.col("n") + 1) * F.col("p") / 100))))
    d = (F.col("n") + 1) * F.col("p") - F.col("j") * 100
    pick = F.when(F.col("n") == 1, F.array(F.struct(F.col("first").alias("at"), F.lit(100).cast("long").alias("weight"))))
    pick = pick.otherwise(F.array(*(F.struct((F.col("first") + F.col("j") + k - 1).alias("at"), w.cast("long").alias("weight")) for k, w in ((0, 100 - d), (1, d)))))
    wanted = places.select(group, "p", F.explode(pick).alias("x")).select(group, "p", "x.at", "x.weight")
    return ranked.select("at", "v").join(wanted, "at").groupBy(group, "p").agg((F.sum(F.col("v") * F.col("weight")) / 100).alias("value"))


def equi_width_histogram(rows: DataFrame, value: str, buckets: int) -> DataFrame:
    """(bucket, n) of positive values from 0 to the largest; empty buckets stay."""
    v = rows.where(F.col(value) > 0)
    top = v.agg(F.max(value).alias("top"))
    placed = v.crossJoin(F.broadcast(top)).select(F.least(F.floor(F.col(value) / (F.col("top") / buckets)), F.lit(buckets - 1)).cast("long").alias("bucket"))
    counts = placed.groupBy("bucket").agg(F.count("*").alias("n"))
    return rows.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
