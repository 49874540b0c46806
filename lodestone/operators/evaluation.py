"""Text-to-SQL evaluation: predicted and gold SQL run on the session's tables, compared as sets, aggregated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators.sets import same_rows


def run_query(spark: SparkSession, sql: str | None, tables: dict[str, DataFrame]) -> tuple[DataFrame | None, str | None]:
    """The query's rows, or why it failed. Only SELECT and WITH run."""
    if not sql or sql.lstrip().split(None, 1)[0].upper() not in ("SELECT", "WITH"):
        return None, "not a query"
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    try:
        df = spark.sql(sql.rstrip().rstrip(";"))
        df.schema  # noqa: B018  analysis
        return df, None
    except Exception as e:  # noqa: BLE001
        return None, type(e).__name__
    finally:
        for name in tables:
            spark.catalog.dropTempView(name)


def judge(spark: SparkSession, sql: str | None, gold: str, tables: dict[str, DataFrame]) -> dict:
    """correct, incorrect, parse_error or error for one query (null: no valid one); both queries failing counts as correct."""
    if not sql:
        return {"result": "parse_error", "error": None}
    (a, why), (b, _) = run_query(spark, sql, tables), run_query(spark, gold, tables)
    if a is None and b is None:
        return {"result": "correct", "error": why}
    if a is None or b is None:
        return {"result": "error", "error": why}
    try:
        return {"result": "correct" if same_rows(a, b) else "incorrect", "error": None}
    except Exception as e:  # noqa: BLE001
        return {"result": "error", "error": type(e).__name__}


def answers(responses: DataFrame) -> DataFrame:
    """Add ``sql``: the valid query of each ``response``, else null."""
    sql = tx.clean_sql(tx.sql_answer(F.col("response")))
    return responses.withColumn("sql", F.when(tx.sql_valid(sql, allow_cte=True), sql))


def evaluate(spark: SparkSession, predictions: list[tuple[str, str, str]], tables: dict[str, DataFrame]) -> DataFrame:
    """(sample_id, response, gold) to sample_id, result, error.

    All responses are parsed in one pass; each distinct pair of queries runs once, from the driver, as SQL can't run
    inside executors.
    """
    parsed = answers(spark.createDataFrame(predictions, "sample_id string, response string, gold string")).select("sample_id", "sql", "gold").collect()
    known: dict = {}
    done = []
    for sample, sql, gold in parsed:
        if (sql, gold) not in known:
            known[sql, gold] = judge(spark, sql, gold, tables)
        done.append((sample, *known[sql, gold].values()))
    return spark.createDataFrame(done, "sample_id string, result string, error string")


def rewards(results: DataFrame) -> DataFrame:
    """Add ``reward``: -1 for a wrong format, 1 for equal results, else 0; here both queries failing is 0."""
    value = F.when(F.col("result") == "parse_error", -1.0).when((F.col("result") == "correct") & F.col("error").isNull(), 1.0).otherwise(0.0)
    return results.withColumn("reward", value)


def summary(results: DataFrame) -> DataFrame:
    """Counts of each result, rates, and accuracy by sample: one correct trajectory is enough."""
    names = ("correct", "incorrect", "parse_error", "error")
    one = results.groupBy("sample_id").agg(F.bool_or(F.col("result") == "correct").alias("ok"), *(F.count_if(F.col("result") == n).alias(n) for n in names), F.count("*").alias("n"))
    return one.agg(F.count("*").alias("samples"), F.sum("n").alias("trajectories"), *(F.sum(n).alias(n) for n in names), F.round(F.avg(F.col("ok").cast("double")), 6).alias("sample_accuracy"))


def pretty(df: DataFrame, most: int = 9000, rows: int = 50) -> str:
    """A result as text: whole if short, else its first rows with a notice, and that cut if it is still too long.

    Rows are made text where they are and cut to ``most`` characters; as each is a line, ``most`` of them tell enough.
    """
    cells = (F.coalesce(F.col(f"c{i}").cast("string"), F.lit("NULL")) for i in range(len(df.columns)))
    lines = df.toDF(*(f"c{i}" for i in range(len(df.columns)))).select(F.substring(F.concat_ws(" | ", *cells), 1, most + 1).alias("line"))
    head = [" | ".join(df.columns), *(r["line"] for r in lines.limit(most).toLocalIterator())]
    text = "\n".join(head)
    if len(text) <= most:
        return text
    text = f"Truncated to {rows} rows since returned response too long: " + "\n".join(head[: rows + 1])
    return text if len(text) <= most else text[:most] + "... (further truncated)"
