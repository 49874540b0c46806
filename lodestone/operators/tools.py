"""Agents, tools and tasks: schemas, validation and lookups that keep order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def function_schema(params: Column, more: tuple[str, ...] = ()) -> Column:
    """JSON of parameters (name, type, description, required): an object with properties and the required names.

    ``more`` names further fields, such as enum and default; a parameter without one leaves it out.
    """
    fields = ("type", "description", *more)
    props = F.map_from_entries(F.transform(params, lambda p: F.struct(p["name"], F.struct(*(p[f].alias(f) for f in fields)))))
    needed = F.transform(F.filter(params, lambda p: p["required"]), lambda p: p["name"])
    return F.to_json(F.struct(F.lit("object").alias("type"), props.alias("properties"), needed.alias("required")))


def resolvable(tools: Column, known: Column, least: int = 2) -> Column:
    """Of an agent's tools those that are known, in order; null if they are fewer than ``least``."""
    kept = F.filter(tools, lambda x: F.array_contains(known, x))
    return F.when(F.size(kept) >= least, kept)


def tool_text(name: Column, function: Column, params: Column) -> Column:
    """A tool for a prompt; the separator is a backslash and an n."""
    lines = F.transform(params, lambda p: F.concat(F.lit("- "), p["name"], F.lit(" ("), p["type"], F.lit(")"), F.when(p["required"], F.lit(" [Required]")).otherwise(F.lit(""))))
    return F.concat(F.lit("**"), name, F.lit("**\\nFunction: "), function, F.lit("\\n"), F.array_join(lines, "\\n"))


def with_defaults(rows: DataFrame, **defaults) -> DataFrame:
    """Missing values replaced, column by column."""
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def scenario_valid(name: Column, description: Column, context: Column) -> Column:
    some = lambda c: c.isNotNull() & (c != "")
    return some(name) & some(description) & some(context) & (F.length(description) >= 10)


def tool_valid(name: Column, description: Column, params: Column) -> Column:
    some = lambda c: F.coalesce(c != "", F.lit(False))
    return some(name) & some(description) & F.forall(params, lambda p: p["name"].isNotNull() & p["type"].isNotNull() & p["description"].isNotNull())


def task_valid(checkpoints: Column, tools: Column) -> Column:
    """Checkpoints are there, and each one that calls a tool names one that is available."""
    calls = F.filter(checkpoints, lambda c: F.contains(c, F.lit("(")))
    return (F.size(checkpoints) > 0) & F.forall(calls, lambda c: F.array_contains(tools, F.trim(F.substring_index(c, "(", 1))))


def ordered_lookup(rows: DataFrame, key: str, ids: str, table: DataFrame, id_name: str, value: str, least: int = 1) -> DataFrame:
    """(key, values): what ``ids`` name in ``table``, in their order, missing ones left out; rows with fewer than ``least`` go."""
    each = rows.select(key, F.posexplode(ids).alias("_pos", id_name))
    joined = each.join(table.select(id_name, F.col(value).alias("_value")), id_name)
    g = joined.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_pos", "_value"))).alias("_v")).where(F.size("_v") >= least)
    return g.select(key, F.transform("_v", lambda x: x["_value"]).alias("values"))


def upsert(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``base``, each column from ``new`` where its key is there; keys that are only new are not added."""
    n = new.select(F.col(key), *(F.col(c).alias(f"_new_{c}") for c in new.columns if c != key), F.lit(True).alias("_hit"))
    rows = base.join(n, key, "left")
    pick = lambda c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in new.columns and c != key else F.col(c)
    return rows.select(*(pick(c) for c in base.columns))


def error_result(kind: Column) -> Column:
    """The record that stands for a failed call of a kind."""
    return F.struct(F.lit(False).alias("success"), F.when(kind == "timeout", "TimeoutError").when(kind == "missing", "ToolNotFound").otherwise("ExecutionError").alias("error_type"), F.concat(F.lit("failed: "), kind).alias("message"))
