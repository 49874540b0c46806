"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import string
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.storage import ARROW_LIMITS, bounded, scratch  # noqa: F401  limits as before by these names

#: ASCII characters that end a word; every other character but A-Z (lower-cased first) is part of one.
WORD_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: White space that ends a token of the language model.
SPACES = r"[\x20\x09-\x0D]+"
#: A side of at most this many bytes, as measured, is broadcast; beyond it the same join shuffles.
BROADCAST_BYTES = 16 << 20
#: Rows of one key that one task should meet.
PLACE = 50_000


def freed(work: Callable) -> Callable:
    """A function of Arrow batches like ``work`` that gives unused memory back to the system at the end of a task.

    Workers outlive their tasks, and what one stage needed would else stay with them through all later ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
            trim(0)

    return run


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for name in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(name).getParent()
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def _bytes(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
            return F.coalesce(F.aggregate(value, F.lit(16).cast("long"), lambda a, x: a + _bytes(x, kind.elementType)), F.lit(16).cast("long"))
        return F.greatest(F.size(value), F.lit(0)).cast("long") * 8 + 16
    if isinstance(kind, T.StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(8).cast("long"))
    return F.lit(8).cast("long")


def measured(df: DataFrame) -> int:
    """About how many bytes the rows of ``df`` take together."""
    row = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16).cast("long"))
    return df.agg(F.sum(row).alias("b")).first()["b"] or 0


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if its rows take at most BROADCAST_BYTES, else ``df`` itself; either join is exact."""
    return F.broadcast(df) if measured(df) <= BROADCAST_BYTES else df


def spread_join(rows: DataFrame, few: DataFrame, on: str, by: list[str], how: str = "left") -> DataFrame:
    """Join ``rows`` with ``few`` on a key of which a large share of the rows may have one value.

    ``few`` is broadcast if it is measured to be small. Else keys of more than PLACE rows are counted; what ``few`` has of
    them goes to a place for each PLACE rows, between which the rows are dealt by the columns ``by``. Rows without a key
    are spread too.
    """
    if measured(few) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(few), on, how)
    hot = rows.where(F.col(on).isNotNull()).groupBy(on).agg(F.ceil(F.count("*") / PLACE).cast("int").alias("__places")).where(F.col("__places") > 1)
    hot = small(stored(hot, "hot"))
    deal = lambda n: F.pmod(F.xxhash64(*by), n).cast("int")
    rows = rows.join(hot, on, "left")
    rows = rows.withColumn("__place", F.when(F.col(on).isNull(), deal(F.lit(1 << 20))).otherwise(F.coalesce(deal(F.col("__places")), F.lit(0)))).drop("__places")
    few = few.join(hot, on, "left").withColumn("__place", F.explode(F.sequence(F.lit(0), F.coalesce("__places", F.lit(1)) - 1))).drop("__places")
    return rows.join(few, [on, "__place"], how).drop("__place")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts without other characters than ASCII take the fast built-in."""
    exact = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(exact)


def split_words(text: Column, breaks: str = WORD_BREAKS) -> Column:
    """Words of ``text`` in order; a first or last element may be empty, see ``lead``."""
    return F.split(ascii_lower(F.coalesce(text, F.lit(""))), breaks)


def words(text: Column, breaks: str = WORD_BREAKS) -> Column:
    """Words of ``text`` in order; none for null."""
    return F.filter(split_words(text, breaks), lambda w: w != "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n: the fold of a document. A null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n
