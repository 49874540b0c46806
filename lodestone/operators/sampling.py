"""Samples and splits that depend on keys and a seed only, not on how rows are spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.ordering import row_numbers


def ticket(key: str, seed: int = 42) -> Column:
    """A digest that orders keys as if shuffled."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))


def bucket(key: str, n: int, seed: int = 42) -> Column:
    """A number below ``n`` from the digest's first 28 bits."""
    return F.conv(F.substring(ticket(key, seed), 1, 7), 16, 10).cast("long") % n


def sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer): a top-n, never a full sort."""
    return rows.orderBy(ticket(key, seed), key).limit(n)


def sample_each(rows: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    w = Window.partitionBy(group).orderBy(ticket(key, seed), key)
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def split(rows: DataFrame, key: str, shares: dict[str, int], seed: int = 42) -> DataFrame:
    """Add ``split``: names dealt in proportion to ``shares`` by the key's bucket."""
    total, upto, out = sum(shares.values()), 0, F.lit(None).cast("string")
    b = bucket(key, total, seed)
    for name, share in shares.items():
        out = F.when((b >= upto) & (b < upto + share), name).otherwise(out)
        upto += share
    return rows.withColumn("split", out)


def oversample(rows: DataFrame, key: str, n: int, total: int, seed: int = 42) -> DataFrame:
    """``total`` rows out of ``n``: all in shuffled order, then again from the front. Adds ``copy``."""
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(-(-total // max(n, 1)) - 1))))
    return copies.orderBy("copy", ticket(key, seed), key).limit(total)


def partners(rows: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """(key, partner): for each row ``n`` others of its group (all, if there are fewer), the next ones in shuffled order.

    Rows meet by their numbers, so a group is never joined with itself.
    """
    placed = row_numbers(rows.select(group, key, ticket(key, seed).alias("_ticket")), [group, "_ticket", key], "_at")
    sizes = placed.groupBy(group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    asked = placed.join(sizes, group).withColumn("_j", F.explode(F.sequence(F.lit(1), F.lit(n)))).where(F.col("_j") < F.col("_n"))
    asked = asked.select(key, (F.col("_first") + (F.col("_at") - F.col("_first") + F.col("_j")) % F.col("_n")).alias("_at"))
    return asked.join(placed.select("_at", F.col(key).alias("partner")), "_at").select(key, "partner")


def holdout(rows: DataFrame, key: str, last: int, seed: int = 42) -> DataFrame:
    """Add ``held_out``: whether a row is among the ``last`` in shuffled order. The border is one key's digest."""
    names = rows.select(F.col(key).alias("k"), ticket(key, seed).alias("t"))
    border = names.orderBy(F.desc("t"), F.desc("k")).limit(last).agg(F.min(F.struct("t", "k")).alias("b")).first()["b"]
    if border is None:
        return rows.withColumn("held_out", F.lit(False))
    return rows.withColumn("held_out", F.struct(ticket(key, seed).alias("t"), F.col(key).alias("k")) >= F.struct(F.lit(border["t"]).alias("t"), F.lit(border["k"]).alias("k")))


def interleave(parts: list[tuple[DataFrame, float]], key: str) -> DataFrame:
    """Rows of several sources with a ``turn``: ordered by it, each source comes in proportion to its weight."""
    out = None
    for number, (rows, weight) in enumerate(parts):
        rows = row_numbers(rows.withColumn("stream", F.lit(number)), [key], "turn").withColumn("turn", F.col("turn") / F.lit(float(weight)))
        out = rows if out is None else out.unionByName(rows)
    return out


def quota(rows: DataFrame, group: str, order: str, target: int) -> DataFrame:
    """An equal whole share of ``target`` for each group, in order. The limit is a number, so ranks are cut early."""
    share = target // max(rows.select(group).distinct().count(), 1)
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= share).drop("_rank")
