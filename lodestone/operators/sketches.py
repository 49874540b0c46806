"""Quantiles and distinct counts as sketches that are stored by run and merged later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A rank from a quantile sketch of this size is off by less than RANK_ERROR with a confidence of 99 %.
SIZE, RANK_ERROR = 400, 0.0077
#: Binary logarithm of a distinct sketch's registers: the relative standard error is 1.04 / 2^(LOG / 2), here 0.8 %.
LOG, DISTINCT_ERROR = 14, 0.00813


def sketched(rows: DataFrame, by: list[str], value: str, item: str) -> DataFrame:
    """(by, n, quantiles, distinct): a sketch of ``value`` and one of ``item`` for each key; nulls are left out of either.

    Tasks make sketches of their rows, which the shuffle merges: a few KB for each key and task, whatever the rows.
    """
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), SIZE).alias("quantiles"), F.hll_sketch_agg(item, LOG).alias("distinct"))


def append_run(sketches: DataFrame, path: str, run: str) -> None:
    """Store a run's sketches beside those of earlier runs; the same run again takes the place of its rows."""
    spark = sketches.sparkSession
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    sketches.withColumn("run", F.lit(run)).write.mode("overwrite").partitionBy("run").parquet(path)


def merged(spark: SparkSession, path: str, by: list[str], runs: list[str] | None = None) -> DataFrame:
    """(by, n, quantiles, distinct) over all runs at ``path``, or those named; the rows that made them are not read again."""
    stored = spark.read.parquet(path)
    if runs is not None:
        stored = stored.where(F.col("run").isin(runs))
    return stored.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("quantiles", SIZE).alias("quantiles"), F.hll_union_agg("distinct").alias("distinct"))


def quantile(sketch: Column, p: float) -> Column:
    """The value whose rank is about ``p``."""
    return F.kll_sketch_get_quantile_double(sketch, F.lit(p))


def rank(sketch: Column, value: Column) -> Column:
    """About which share of values is at most ``value``."""
    return F.kll_sketch_get_rank_double(sketch, value)


def distinct(sketch: Column) -> Column:
    return F.hll_sketch_estimate(sketch)
