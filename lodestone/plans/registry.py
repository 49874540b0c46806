"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of Tables under its name."""

    def wrap(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return wrap


def spark_sql(name: str, text: str, tables: str, oracle: str | None = None):
    """Register SQL text that runs as it is in Spark and as its own oracle."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sub = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables.split()}
        return spark.sql(_braced(text, sub), **sub)

    QUERIES[name] = run
    ORACLES[name] = oracle or text


def _braced(text: str, tables: dict) -> str:
    """Names after FROM and JOIN as DataFrame parameters, so that no view is left behind."""
    import re

    return re.sub(r"\b(FROM|JOIN)(\s+)(" + "|".join(tables) + r")\b", r"\1\2{\3}", text)
