"""Global row numbers and tiles without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.storage import shared_dir


def kept(df: DataFrame) -> DataFrame:
    """Cut lineage with checkpoint() in the session's shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def row_numbers(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add ``name``, the place of each row from 1 in a total ``order``.

    Rows are range-partitioned and sorted where they are; only the partitions' counts are summed in one place.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = kept(rows.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")))
    parts = rows.groupBy("_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row a partition
    parts = parts.select("_part", (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return rows.join(F.broadcast(parts), "_part").withColumn(name, F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift")


def tile(number: Column, total: int, tiles: int) -> Column:
    """The tile, from 1, of a row's number among ``total``: as ntile, the first tiles are one larger."""
    size, more = divmod(total, tiles)
    large = F.lit(more * (size + 1))
    return F.when(number <= large, F.floor((number - 1) / (size + 1)) + 1).otherwise(F.lit(more) + F.floor((number - 1 - large) / max(size, 1)) + 1)
