"""Event-time streams and stateful replays, with batch forms that give the same rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.storage import scratch


def read_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Parquet files as a stream, their schema taken from what is there."""
    single = path.endswith(".parquet")
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if single:  # a stream reads folders: take this file by name
        folder, _, name = path.rstrip("/").rpartition("/")
        return reader.option("pathGlobFilter", name if "*" in name else f"*{name}").parquet(folder) if not _is_folder(spark, path) else reader.parquet(path)
    return reader.parquet(path)


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def collect_stream(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and read its result back."""
    spark = df.sparkSession
    out, state = scratch(spark, "stream"), scratch(spark, "stream-state")
    if mode == "append":
        df.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(df.schema).parquet(out)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def collect_changes(df: DataFrame) -> DataFrame:
    """Run a stream in update mode over all that is there; the rows of every batch, a batch that runs again once."""
    spark = df.sparkSession
    out, state = scratch(spark, "changes"), scratch(spark, "changes-state")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    df.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out).select(*df.columns)


def _watermarked(events: DataFrame, late: str) -> DataFrame:
    """A stream with its watermark, which needs time stamps with a zone; a batch as it is."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; batch or stream."""
    rows = _watermarked(events, late)
    g = rows.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of a user: rows with gaps of less than ``gap``."""
    rows = _watermarked(events, late)
    g = rows.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("s.start").alias("start"), "n")


def distinct_within(events: DataFrame, keys: list[str], late: str = "2 days") -> DataFrame:
    """The first row of each key; a stream keeps keys as long as the watermark."""
    if events.isStreaming:
        return _watermarked(events, late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def replay_sessions(turns: DataFrame, most: int, phrase: str) -> DataFrame:
    """Turn loops replayed with state: (conv_id, turns, state) when a session ends at ``most`` turns or a phrase.

    A stream of (conv_id, turn, text) goes through applyInPandasWithState; a batch gives the same final states.
    """
    spec = "conv_id long, turns long, state string"

    def step(key, n: int, done: bool, rows: pd.DataFrame):
        for text in rows.sort_values("turn")["text"]:
            if done:
                break
            n += 1
            done = n >= most or phrase in (text or "").lower()
        return n, done

    if not turns.isStreaming:

        def whole(key, rows: pd.DataFrame) -> pd.DataFrame:
            n, done = step(key, 0, False, rows)
            return pd.DataFrame({"conv_id": [key[0]], "turns": [n], "state": ["COMPLETED" if done else "RUNNING"]})

        return turns.groupBy("conv_id").applyInPandas(whole, spec)

    from pyspark.sql.streaming.state import GroupStateTimeout

    def with_state(key, batches, state):
        n, done = state.get if state.exists else (0, False)
        for rows in batches:
            n, done = step(key, n, done, rows)
        state.update((n, done))
        yield pd.DataFrame({"conv_id": [key[0]], "turns": [n], "state": ["COMPLETED" if done else "RUNNING"]})

    return turns.groupBy("conv_id").applyInPandasWithState(with_state, spec, "n long, done boolean", "update", GroupStateTimeout.NoTimeout)
