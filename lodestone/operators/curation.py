"""Multimodal prompts and records, histories with results, schemas in prompts, counters, batches and joins by place."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import text as tx
from lodestone.operators.ordering import row_numbers

IMAGE_TAG = "<image"
#: Fixed value: pixels of a picture at most.
PIXELS = 50_000_000


def image_prompt(question: Column, system: str, image: Column, path: Column) -> Column:
    """A user message that names one image before the question, with the list of images; without bytes the list is empty."""
    content = F.concat(F.lit("<image>\n"), question, F.lit("  " + system))
    images = F.array_compact(F.array(F.when(image.isNotNull(), F.struct(image.alias("bytes"), path.alias("path")))))
    return F.struct(F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))).alias("prompt"), images.alias("images"))


def one_image_and_truth(prompt: Column, truth: Column) -> Column:
    """Whether there is a ground truth and the first message names exactly one image; a null message names none."""
    return truth.isNotNull() & (F.coalesce(tx.count_of(F.get(prompt, F.lit(0))["content"], IMAGE_TAG).cast("int"), F.lit(0)) == 1)


def reading_record(prompt: str, width: Column, height: Column, truth: Column) -> Column:
    """Messages that ask for a picture's text and give it, stripped; null where the picture has no pixels or more than PIXELS, or
    ``truth`` (JSON) has no text at gt_parse.text_sequence."""
    text = F.try_variant_get(F.try_parse_json(truth), "$.gt_parse.text_sequence", "variant")
    text = F.when(F.schema_of_variant(text) == "STRING", F.try_variant_get(text, "$", "string"))
    pixels = width.cast("long") * height.cast("long")
    fits = (width > 0) & (height > 0) & (pixels <= PIXELS)
    say = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.when(F.coalesce(fits & (F.length(tx.strip(text)) > 0), F.lit(False)), F.array(say("user", F.lit(prompt)), say("assistant", tx.strip(text))))


@F.pandas_udf(T.ArrayType(T.StringType()))
def printed_results(messages: pd.Series) -> pd.Series:
    """Each element of a JSON list, printed with an indent of two; a text that is no such list is its one element."""

    def lines(m):
        if m is None:
            return []
        try:
            value = json.loads(m)
        except ValueError:
            return [m]
        return [json.dumps(x, ensure_ascii=False, indent=2) for x in value] if isinstance(value, list) else [m]

    return messages.map(lines)


def history_with_results(turns: DataFrame, key: str, order: str, sender: str, message: str) -> DataFrame:
    """(key, history): a line ``sender: message`` a turn, one for each result of an execution's list; other senders are left out."""
    rows = turns.where(F.col(sender).isin("user", "agent", "execution"))
    parts = F.when(F.col(sender) == "execution", printed_results(F.col(message))).otherwise(F.array(F.coalesce(message, F.lit(""))))
    rows = rows.select(key, order, F.transform(parts, lambda p: F.concat(F.col(sender), F.lit(": "), p)).alias("lines"))
    gathered = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "lines"))).alias("t"))
    return gathered.select(key, F.array_join(F.flatten("t.lines"), "\n").alias("history"))


def ddl(name: str, df: DataFrame) -> str:
    """A table's CREATE statement from its schema."""
    return f"CREATE TABLE {name} (" + ", ".join(f"{f.name} {f.dataType.simpleString().upper()}" for f in df.schema.fields) + ")"


def schema_chat(question: Column, schema: Column, knowledge: Column, system: str) -> Column:
    """System and user messages: schema, knowledge (none: left out) and question in the user's."""
    user = F.concat_ws("\n", F.concat(F.lit("Schema:\n"), schema), F.when(F.length(knowledge) > 0, F.concat(F.lit("Knowledge: "), knowledge)), F.concat(F.lit("Question: "), question))
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def most_common(rows: DataFrame, counters: list[str], k: int = 10) -> DataFrame:
    """(counter, name, n): the ``k`` most frequent values of each column, equal ones by name; nulls don't count.

    One pass counts all columns; what a task has of a value is summed before the shuffle.
    """
    named = F.explode(F.array(*(F.struct(F.lit(c).alias("counter"), F.col(c).cast("string").alias("name")) for c in counters))).alias("x")
    counts = rows.select(named).where("x.name is not null").groupBy("x.counter", "x.name").agg(F.count("*").alias("n"))
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("counter").orderBy(F.desc("n"), "name"))  # cut in each task before the shuffle
    return counts.withColumn("place", place).where(F.col("place") <= k).drop("place")


def aligned(rows: DataFrame, prompt: str, order: list[str], prompts: int, n: int) -> DataFrame:
    """The first ``prompts`` x ``n`` rows in ``order``; fewer than ``prompts`` different prompts are an error."""
    found = rows.select(prompt).distinct().limit(prompts).count()
    if found < prompts:
        raise ValueError(f"{found} of {prompts} prompts")
    return row_numbers(rows, order, "place").where(F.col("place") <= prompts * n).drop("place")


def zipped(left: DataFrame, left_order: list[str], right: DataFrame, right_order: list[str]) -> DataFrame:
    """Rows of both sides at the same place of their orders side by side; sides of different length are an error."""
    a, b = row_numbers(left, left_order, "_place"), row_numbers(right, right_order, "_place")
    n, m = a.count(), b.count()
    if n != m:
        raise ValueError(f"{n} and {m} rows can't be zipped")
    return a.join(b, "_place").drop("_place")


def looked_up(rows: DataFrame, index: str, table: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with the row of ``table`` at their ``index`` (from 0, in ``order``); rows whose index is null or outside are left out."""
    numbered = row_numbers(table, order, "_place").withColumn("_place", F.col("_place") - 1)
    return rows.join(numbered, F.col(index) == F.col("_place")).drop("_place")


def advice(rates: dict[str, Column], least: dict[str, float], say: dict[str, str], also: dict[str, str]) -> tuple[Column, Column]:
    """(reasons, recommendations): rates below their threshold, and what to do about them; ``also`` adds one for a reason, at the end."""
    short = {k: F.coalesce(rates[k] < v, F.lit(False)) for k, v in least.items()}
    pick = lambda texts: F.array_compact(F.array(*(F.when(short[k], t) for k, t in texts)))
    return pick([(k, k) for k in least]), pick([*say.items(), *also.items()])
