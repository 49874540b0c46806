"""Statistics over groups of rollouts of one prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.ordering import row_numbers


def varied_groups(rows: DataFrame, group: str, reward: str, keep_singletons: bool = True) -> DataFrame:
    """Groups whose rewards differ (or that have one row): (group, n, low, high). Aggregates before any join."""
    g = rows.groupBy(group).agg(F.count("*").alias("n"), F.min(reward).alias("low"), F.max(reward).alias("high"))
    varied = F.col("low") != F.col("high")
    return g.where(varied | (F.col("n") == 1) if keep_singletons else varied)


def complete_varied_groups(rows: DataFrame, group: str, reward: str) -> DataFrame:
    """Groups without a missing reward whose rewards differ; single rows go."""
    g = rows.groupBy(group).agg(F.count("*").alias("n"), F.count(reward).alias("scored"), F.min(reward).alias("low"), F.max(reward).alias("high"))
    return g.where((F.col("scored") == F.col("n")) & (F.col("low") != F.col("high")))


def majority(rows: DataFrame, group: str, answer: str) -> DataFrame:
    """The most frequent answer of each group, of ties the least: (group, answer, votes)."""
    votes = rows.groupBy(group, answer).agg(F.count("*").alias("votes"))
    best = votes.groupBy(group).agg(F.min(F.struct((-F.col("votes")).alias("v"), F.col(answer).alias("a"))).alias("b"))
    return best.select(group, F.col("b.a").alias(answer), (-F.col("b.v")).alias("votes"))


def run_numbers(rows: DataFrame, order: str, value: str, within: str | None = None) -> DataFrame:
    """Add ``run``: place since ``value`` last changed, in ``order``."""
    by = [within] if within else []
    w = Window.partitionBy(*by).orderBy(order)
    changed = F.coalesce((F.lag(value).over(w) != F.col(value)).cast("int"), F.lit(1))
    rows = rows.withColumn("_island", F.sum(changed).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("run", F.row_number().over(Window.partitionBy(*by, "_island").orderBy(order)) - 1).drop("_island")


def round_robin(rows: DataFrame, key: str, workers: int) -> DataFrame:
    """(key, place, worker): distinct keys numbered from 0 and dealt in order."""
    keys = row_numbers(rows.select(key).distinct(), [key], "place")
    return keys.select(key, (F.col("place") - 1).alias("place"), ((F.col("place") - 1) % workers).alias("worker"))


def rollouts(prompts: DataFrame, n: int, index: str) -> DataFrame:
    """Each prompt ``n`` times, with its place in the batch."""
    return prompts.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("rollout_index", F.col(index) * n + F.col("k"))


def rate(part: Column, whole: Column) -> Column:
    """part / whole as a double, 0 for an empty whole."""
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))
