"""Vectors as whole numbers: which rows take part, and their floors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whole components up to this size keep squared distances and products of up to 4,096 components exact in 64 bits.
LARGEST = 1 << 24


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~odd


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, x as double. Components beyond LARGEST raise an error, as sums would not be exact."""

    def one(x: Column) -> Column:
        y = F.floor(x.cast("double") * scale)
        return F.when(F.abs(y) <= LARGEST, y.cast("int")).otherwise(F.raise_error("vector component too large for exact sums").cast("int"))

    return F.transform(vector, one)


def whole_vectors(df: DataFrame, vector: str, scale: int) -> DataFrame:
    """Rows of ``df`` whose vector is usable, with array<int> in its place."""
    return df.where(usable(F.col(vector))).withColumn(vector, whole(F.col(vector), scale))
