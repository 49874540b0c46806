"""Errors of recognised transcripts: tokens, alignments, and their counts by corpus, script and word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import align
from lodestone.functions import text as tx
from lodestone.storage import bounded

#: Signs that may stand in a word without changing its script.
NEUTRAL = "[&'@℃=.\\-_#+;]"
#: Scripts that a word can be of as a whole.
SCRIPTS = {"Number": "[0-9]+", "Mandarin": r"\p{IsHan}+", "English": r"\p{IsLatin}+", "Japanese": r"\p{IsHiragana}+"}


def normalised_tokens(tokens: Column, ignored: list[str], parts: dict[str, list[str]], upper: bool = True, tags: bool = True) -> Column:
    """Tokens in capitals without ignored ones, their tags stripped, empty ones dropped, some cut into parts."""
    out = F.transform(tokens, F.upper) if upper else tokens
    out = F.filter(out, lambda x: ~x.isin(ignored)) if ignored else out
    out = F.filter(F.transform(out, tx.strip_tags) if tags else out, lambda x: x != "")
    if not parts:
        return out
    table = F.create_map(*(c for k, v in parts.items() for c in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.flatten(F.transform(out, lambda x: F.coalesce(F.try_element_at(table, x), F.array(x))))


def script(word: Column) -> Column:
    """The script that all letters and digits of a word are of, else Other."""
    bare, out = F.regexp_replace(word, NEUTRAL, ""), F.lit("Other")
    for name, pattern in reversed(SCRIPTS.items()):
        out = F.when(bare.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def aligned_pairs(rows: DataFrame, ref: str, hyp: str, *by: str) -> DataFrame:
    """(by, op, ref, hyp): a row for each step of the alignments of two token arrays."""
    some = bounded(rows.select(*by, F.col(ref).alias("_ref"), F.col(hyp).alias("_hyp")))
    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in some.schema.fields[:-2])
    return some.mapInArrow(align.steps(list(by)), own + "op string, ref string, hyp string")


def _counts(rate: bool = True) -> list[Column]:
    n = lambda *ops: F.count_if(F.col("op").isin(*ops))
    out = [n("cor", "sub", "del").alias("n"), n("cor").alias("c"), n("sub").alias("s"), n("del").alias("d"), n("ins").alias("i")]
    return [*out, F.round(F.try_divide(100.0 * n("sub", "del", "ins"), n("cor", "sub", "del")), 6).alias("wer")] if rate else out


def totals(pairs: DataFrame, *by: str) -> DataFrame:
    """n words, c correct, s substituted, d deleted, i inserted, and the error rate in percent (null without words)."""
    return pairs.groupBy(*by).agg(*_counts())


def by_script(pairs: DataFrame) -> DataFrame:
    """``totals`` for each script: of the reference's word, of an inserted one the hypothesis's."""
    return pairs.groupBy(script(F.when(F.col("op") == "ins", F.col("hyp")).otherwise(F.col("ref"))).alias("script")).agg(*_counts())


def by_word(pairs: DataFrame) -> DataFrame:
    """(word, corr, tot_errs, in_ref, in_hyp): a substitution is an error of both of its words."""
    sides = F.array(
        F.struct(F.col("ref").alias("word"), F.lit("ref").alias("side")), F.struct(F.col("hyp").alias("word"), F.lit("hyp").alias("side")),
    )
    each = pairs.select("op", F.explode(sides).alias("x")).select("op", "x.word", "x.side").where(F.col("word") != "")
    ref, right = F.col("side") == "ref", F.col("op") == "cor"
    return each.groupBy("word").agg(F.count_if(right & ref).alias("corr"), F.count_if(~right).alias("tot_errs"), F.count_if(ref).alias("in_ref"), F.count_if(~ref).alias("in_hyp"))


def hypothesis_error(hypothesis: Column, rewritten: Column) -> Column:
    """Edits from a hypothesis to its rewritten form by its length, to four digits; 1 for an empty one."""
    return F.when(F.size(hypothesis) == 0, F.lit(1.0)).otherwise(F.round(align.edits(hypothesis, rewritten) / F.size(hypothesis), 4))
