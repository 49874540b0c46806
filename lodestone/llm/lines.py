"""Lines that many documents share: explode, hash, count documents, drop, reassemble by position. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import ascii_lower, discard, spread_join, stored

#: Characters stripped at both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
#: Keys of fewer code points are never dropped; keys of at least so many documents are.
MIN_CHARS, MIN_DOCS = 40, 5


def split_lines(text: Column) -> Column:
    """Lines of a text; null and empty texts are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """What lines are compared by: stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _row(doc: Column, text: Column) -> Column:
    """What tells rows apart: id and text. Rows alike in both have the same result."""
    mark = F.when(doc.isNull(), "n").otherwise(F.concat(F.lit("i"), doc.cast("string"), F.lit(" ")))
    return F.unhex(F.md5(F.concat(mark, F.coalesce(text, F.lit(""))).cast("binary")))


def _long_lines(docs: DataFrame, doc: str, text: str, min_chars: int) -> DataFrame:
    """One row for each line that may be dropped: row, id, place and the digest of the line's key."""
    # a key is no longer than its line, so short lines are left out before any work on them
    lines = docs.where(F.length(text) >= min_chars).select(_row(F.col(doc), F.col(text)).alias("row"), F.col(doc).alias("doc"), F.posexplode(split_lines(F.col(text))).alias("at", "line"))
    lines = lines.where(F.length("line") >= min_chars).withColumn("line", F.btrim("line", F.lit(BLANKS)))
    return lines.where(F.length("line") >= min_chars).select("row", "doc", "at", F.unhex(F.md5(ascii_lower(F.col("line")).cast("binary"))).alias("key"))


def shared_keys(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Digests of the keys that at least ``min_docs`` documents hold: key, n_docs, keeper (the largest id, null if there is none).

    Rows of one id are one document; all rows without id are one too, below all others.
    """
    lines = _long_lines(docs, doc, text, min_chars)
    n = F.count_distinct("doc") + F.max(F.col("doc").isNull().cast("int"))
    return lines.groupBy("key").agg(n.alias("n_docs"), F.max("doc").alias("keeper")).where(F.col("n_docs") >= min_docs)


def dedup(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, kept: str = "kept_text", n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """``docs`` with the text that is left (``kept``) and the numbers of lines before and of lines dropped.

    A line goes if its key has at least ``min_chars`` code points, at least ``min_docs`` documents hold the key, and this is not
    the document of the largest id among them (there all its lines stay). What is left is joined by line feeds in its order;
    null and empty texts are one empty line, which stays. Rows of one id are one document, so none counts twice, and each row is
    cut by its own text; rows alike have the same result; rows without id are one document below all others. All columns stay;
    the three named ones replace columns of those names. An empty table gives an empty result.

    Lines are counted by digests, in partial sums. Shared keys, and then the places to drop, are broadcast if measured to be
    small; else frequent keys are spread over many tasks, so a line in a third of all documents meets no single task.
    """
    keys = stored(shared_keys(docs, doc, text, min_chars, min_docs).drop("n_docs"), "shared-lines")
    task = F.spark_partition_id()  # rows alike are told apart by the task that read them
    lines = spread_join(_long_lines(docs, doc, text, min_chars), keys, "key", ["row", "at", task], "inner")
    gone = lines.where(~F.col("doc").eqNullSafe(F.col("keeper"))).groupBy("row").agg(F.collect_set("at").alias("__gone"))
    gone = stored(gone.withColumnRenamed("row", "__row"), "dropped-lines")
    discard(keys)
    # rows too short for a key to be dropped have no counterpart: no key, so they are dealt out freely
    own = F.when(F.length(text) >= min_chars, _row(F.col(doc), F.col(text)))
    out = spread_join(docs.withColumn("__row", own), gone, "__row", [doc, text, task]).drop("__row")
    out = out.withColumn("__lines", split_lines(F.col(text))).withColumn("__gone", F.coalesce("__gone", F.array().cast("array<int>")))
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__gone")
    rest = F.array_join(F.transform(left, lambda at: F.get("__lines", at)), "\n")
    return out.withColumns({kept: rest, n_lines: F.size("__lines").cast("long"), n_dropped: F.size("__gone").cast("long")}).drop("__gone", "__lines")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of each row of ``docs``."""
    out = dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
shared AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT doc_id, line, place, shared.key IS NOT NULL AND doc_id <> keeper AS gone FROM k LEFT JOIN shared USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id"""
