"""A corpus pipeline of five stages over ``documents``; each takes all rows that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontaminate, langid, probminhash, quality
from lodestone.llm.common import stored, table

#: A prediction of a language other than the given one counts from this score on.
SURE = 0.6
#: Names that stages use inside, so that columns of documents keep theirs.
KEPT, SCORE = "__pipeline_kept", "__pipeline_score"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the classifier's threshold; null texts are scored as empty ones.

    Where no label is of use (none, or all held out) nothing is learned, and all documents stay.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    if not model.learned:
        return docs
    return quality.score(docs, model, score=SCORE, predicted=KEPT).where(F.col(KEPT) == 1).drop(SCORE, KEPT)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language that does not surely contradict the given one; without letters they go."""
    found = langid.predict(docs, langid.fit(docs), lang=KEPT, score=SCORE)
    other = F.coalesce((F.col(KEPT) != F.col("lang")) & (F.col(SCORE) >= SURE), F.lit(False))
    return found.where((F.col(KEPT) != "und") & ~other).drop(SCORE, KEPT)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the least id."""
    return probminhash.representatives(docs).select(*docs.columns)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark passage occurs; each row is judged by its own text, whatever its id."""
    text = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    found = decontaminate.contamination(docs.select(text.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id").distinct()
    found = stored(found.withColumnRenamed("doc_id", KEPT), "contaminated")
    return docs.withColumn(KEPT, text).join(found, KEPT, "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left, with token counts and digests of ids and of the decoded text (in place of equal names)."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", keep_quality), ("language", keep_language), ("near-duplicates", keep_one_of_each), ("decontamination", keep_uncontaminated), ("encoding", encode)]

#: No SQL can express the trained stages; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
