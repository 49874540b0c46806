"""Set comparison and de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Rows that one task compares; tasks that copies of one row are dealt to at first.
PART_ROWS, DEALS = 400_000, 64


def _canonical(value: Column, kind: T.DataType) -> Column:
    """A text that equal values share: whole numbers as such whatever their type, texts apart from numbers, null by itself."""
    if isinstance(kind, T.NullType):
        return F.lit("null")
    if isinstance(kind, T.BooleanType | T.IntegralType):
        text = F.concat(F.lit("n"), value.cast("int").cast("string") if isinstance(kind, T.BooleanType) else value.cast("string"))
    elif isinstance(kind, T.DecimalType):
        text = F.concat(F.lit("n"), F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ""))
    elif isinstance(kind, T.FractionalType):
        # whole doubles of 64 bits are written out in full; larger ones are equal to doubles only
        x = value.cast("double")
        whole = (x == F.floor(x)) & (F.abs(x) < 9.2e18)
        text = F.concat(F.lit("n"), F.when(whole, F.when(whole, x).cast("bigint").cast("string")).otherwise(x.cast("string")))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: F.to_json(F.struct(_canonical(x, kind.elementType).alias("v")))), ","))
    elif isinstance(kind, T.StringType | T.BinaryType):
        text = F.concat(F.lit("s" if isinstance(kind, T.StringType) else "b"), value.cast("string") if isinstance(kind, T.StringType) else F.hex(value))
    else:
        text = F.concat(F.lit(kind.typeName()[0].upper() + kind.typeName()[1:] + " "), value.cast("string") if isinstance(kind, T.DatetimeType) else F.to_json(F.struct(value.alias("v"))))
    return F.coalesce(text, F.lit("null"))


def row_digests(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, row): a digest of each row by position, columns of ``by`` left out; equal rows have equal digests anywhere."""
    by = by or []
    plain = df.select(*by, *(c for c in df.columns if c not in by)).toDF(*by, *(f"c{i}" for i in range(len(df.columns) - len(by))))
    values = F.to_json(F.struct(*(_canonical(F.col(f.name), f.dataType).alias(f.name) for f in plain.schema.fields[len(by) :]), F.lit(1).alias("end")))
    return plain.select(*by, F.unhex(F.sha2(values.cast("binary"), 256)).alias("row"))


def _sides(a: DataFrame, b: DataFrame, by: list[str], parts: int | None = None) -> DataFrame:
    """Distinct digests of both sides' rows with the sum of the sides that have them: 3 if both do.

    With ``parts``, digests are dealt out to so many tasks before they are grouped, so what a task holds depends on neither the
    files' splits nor the session's shuffle partitions. Copies of one digest are first dealt to several tasks.
    """
    both = row_digests(a, by).withColumn("sides", F.lit(1)).unionByName(row_digests(b, by).withColumn("sides", F.lit(2)))
    if parts:
        dealt = both.withColumn("deal", F.spark_partition_id() % DEALS).repartition(parts, *by, "row", "deal")
        both = dealt.groupBy(*by, "row", "deal").agg(F.bit_or("sides").alias("sides")).repartition(parts, *by, "row")
    return both.groupBy(*by, "row").agg(F.bit_or("sides").alias("sides"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal as sets of rows by position: order, repeats and names don't count, null equals null, 1 equals 1.0 and true.

    Numbers are compared by their exact values, so 2^53 + 1 is not the double 2^53; a text is never equal to a number.
    Each side runs once: the digests of its rows are counted by the side they come from.
    """
    return len(a.columns) == len(b.columns) and _sides(a, b, []).where("sides <> 3").isEmpty()


def same_rows_by(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """(by, equal): ``same_rows`` of the rows of each key at once, the key's columns left out; a null key is a key.

    The rows are counted first, as a task compares PART_ROWS of them, however many there are.
    """
    parts = max(1, -(-(a.count() + b.count()) // PART_ROWS))
    return _sides(a, b, by, parts).groupBy(*by).agg((F.bool_and(F.col("sides") == 3) & F.lit(len(a.columns) == len(b.columns))).alias("equal"))


def first_by_signature(rows: DataFrame, signature: Column, order: str) -> DataFrame:
    """The first row, in order, of each signature."""
    w = Window.partitionBy("_sig").orderBy(order)
    return rows.withColumn("_sig", signature).withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_sig", "_n")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the last in order, by aggregation: a frequent key is reduced before the shuffle."""
    rest = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest, order), order).alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in [*rest, order]))


def exact_duplicates(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(text, key, copies): each text that several rows have, the least of their keys (null if none has one), and their number.

    Rows are grouped by digest and length. A group's text is taken from any one of its rows, as a join of the digests brings
    back the texts of those that are repeated only; null is a text of its own, an empty table gives an empty result.
    """
    mark = F.struct(F.md5(F.col(text).cast("binary")).alias("digest"), F.octet_length(text).alias("size"))
    of = rows.select(F.col(key).alias("key"), F.col(text).alias("text"), mark.alias("mark"))
    several = of.groupBy("mark").agg(F.min("key").alias("key"), F.count("*").alias("copies")).where("copies > 1")
    # the row of the least key brings the text; equal keys and null ones may be several rows, of which one is kept
    found = several.join(of.withColumnRenamed("key", "own"), "mark").where(F.col("own").eqNullSafe(F.col("key")))
    found = found.groupBy("mark").agg(F.any_value("text").alias("text"), F.any_value("key").alias("key"), F.any_value("copies").alias("copies"))
    return found.select(F.col("text").alias(text), F.col("key").alias(key), "copies")
