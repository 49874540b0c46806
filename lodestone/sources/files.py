"""Readers for the formats that data sets come in, and writers that mirror them."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

FORMATS = {"parquet": "parquet", "json": "json", "jsonl": "jsonl", "csv": "csv", "txt": "text", "orc": "orc", "arrow": "arrow"}


def load(spark: SparkSession, path: str, schema: T.StructType | str | None = None, kind: str | None = None) -> DataFrame:
    """Read by the path's ending: parquet, orc, csv, txt, json (one array a file), jsonl or arrow; else ValueError."""
    kind = kind or path.rstrip("/").removesuffix(".gz").rsplit(".", 1)[-1].lower()
    if kind not in FORMATS:
        raise ValueError(f"no reader for .{kind}")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind == "json":
        return reader.option("multiLine", True).json(path)
    if kind == "jsonl":
        return reader.json(path)
    if kind == "csv":
        return reader.option("header", True).csv(path)
    if kind == "arrow":
        spark.dataSource.register(ArrowFiles)
        return spark.read.format("arrow_files").schema(schema).load(path)
    return reader.format(FORMATS[kind]).load(path)


def load_all(spark: SparkSession, paths: list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """Several files of one format as one table; missing columns are null. Mixed formats are refused."""
    kinds = {p.rstrip("/").removesuffix(".gz").rsplit(".", 1)[-1].lower() for p in paths}
    if len(kinds) != 1:
        raise ValueError(f"files of one format expected, not {sorted(kinds)}")
    out = None
    for p in paths:
        part = load(spark, p, schema)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def jsonl_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines without the malformed ones."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every *.json of a folder, one document or array each, with ``_source_file``."""
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(path).select("*", F.col("_metadata.file_name").alias("_source_file"))


def parquet_folder(spark: SparkSession, path: str, skip: str) -> DataFrame:
    """Parquet files of a folder and those below it, but for paths that match ``skip`` (a pattern, any case)."""
    rows = spark.read.option("recursiveFileLookup", True).parquet(path)
    return rows.where(~F.col("_metadata.file_path").rlike(f"(?i){skip}"))


def json_objects(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The JSON objects of a folder's *.json files, and how many files were read, unreadable or no objects."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path)
    parsed = F.try_parse_json("value")
    kind = F.when(parsed.isNull(), "unreadable").when(F.trim("value").startswith("{"), "read").otherwise("no_object")
    rows = files.select("value", kind.alias("kind"), F.col("_metadata.file_name").alias("_source_file"))
    found = rows.where(F.col("kind") == "read").select(F.from_json("value", schema).alias("v"), "_source_file").select("v.*", "_source_file")
    return found, rows.groupBy("kind").agg(F.count("*").alias("n"))


def latest_of(spark: SparkSession, path: str, globs: list[str]) -> str | None:
    """The newest file by the first pattern that any file's name matches."""
    return next((found for g in globs if (found := latest_file(spark, path, g))), None)


def latest_file(spark: SparkSession, path: str, glob: str) -> str | None:
    """The path of the newest file whose name matches."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("p")).first()["p"]


def catalog_table(data_source: str, db_id: str) -> str:
    """The catalog name of a benchmark's database; unknown sources are refused."""
    if data_source not in ("synsql", "spider", "bird"):
        raise ValueError(f"unknown data source {data_source}")
    return f"{data_source}_{db_id}".lower()


def catalog_name(source: Column, db_id: Column) -> Column:
    """``catalog_table`` of columns."""
    low = F.lower(source)
    refuse = F.raise_error(F.concat(F.lit("unknown data source "), F.coalesce(source, F.lit("null")))).cast("string")
    return F.concat(F.when(low.isin("synsql", "spider", "bird"), low).otherwise(refuse), F.lit("_"), F.lower(db_id))


def sqlite_rows(spark: SparkSession, path: str, sql: str, schema: str) -> DataFrame:
    """The rows of one query of a SQLite file, rolled back afterwards."""
    spark.dataSource.register(SqliteQuery)
    return spark.read.format("sqlite").schema(schema).option("path", path).option("query", sql).load()


def sqlite_tool(calls: DataFrame, path: str, call: str, schema: str) -> DataFrame:
    """For each call ({"name": "execute_sql", "arguments": {"sql": ...}}) of ``calls`` its row beside each row of its query.

    Other tools, broken calls and queries that fail or are no SELECT give no row.
    """
    sql = F.when(F.get_json_object(call, "$.name") == "execute_sql", F.get_json_object(call, "$.arguments.sql"))
    rest = [f for f in calls.schema.fields if f.name != call]
    out = T.StructType([*rest, *T.StructType.fromDDL(schema).fields])
    arrow = to_arrow_schema(out)

    def run(batches):
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
            for b in batches:
                rows = []
                for *own, q in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if not q or q.split(None, 1)[0].upper() not in ("SELECT", "WITH"):
                        continue
                    try:
                        rows += [(*own, *r) for r in con.execute(q)]
                    except sqlite3.Error:
                        continue
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)] if rows else [pa.array([], f.type) for f in arrow], schema=arrow)

    return calls.select(*(f.name for f in rest), sql.alias("_sql")).mapInArrow(run, out)


def pipe_labels(spark: SparkSession, path: str) -> DataFrame:
    """audio|prompt_text|prompt_audio|text lines; empty fields are removed and four must be left."""
    parts = F.filter(F.split("value", r"\|"), lambda x: x != "")
    rows = spark.read.text(path).select(parts.alias("p")).where(F.size("p") == 4)
    return rows.select(*(F.col("p")[i].alias(n) for i, n in enumerate(("audio", "prompt_text", "prompt_audio", "text"))))


def recognition_texts(spark: SparkSession, path: str) -> DataFrame:
    """(id, ref, hyp) of lines ``id:<tab>ref=...`` and ``id:<tab>hyp=...``; other lines and incomplete pairs are skipped, a later line wins."""
    pattern = r"(?i)^(\S+):\t(ref|hyp)=(.*)$"
    rows = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("n"))
    rows = rows.select(F.regexp_extract("value", pattern, 1).alias("id"), F.lower(F.regexp_extract("value", pattern, 2)).alias("kind"), F.regexp_extract("value", pattern, 3).alias("text"), "n").where(F.col("kind") != "")
    pick = lambda k: F.max_by(F.when(F.col("kind") == k, F.col("text")), F.when(F.col("kind") == k, F.col("n")))
    return rows.groupBy("id").agg(pick("ref").alias("ref"), pick("hyp").alias("hyp")).where(F.col("ref").isNotNull() & F.col("hyp").isNotNull())


def audio_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime) of all *.wav below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(path).drop("content")


def wav_samples(files: DataFrame) -> DataFrame:
    """(path, rate, samples) of 16-bit WAV contents (path, content), first channel."""

    def run(batches):
        import io
        import wave

        import numpy as np

        for b in batches:
            rates, samples = [], []
            for c in b.column("content").to_pylist():
                with wave.open(io.BytesIO(c)) as w:
                    rates.append(w.getframerate())
                    samples.append((np.frombuffer(w.readframes(w.getnframes()), "<i2")[:: w.getnchannels()] / 32768).astype("float32"))
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(rates, pa.int32()), pa.array(samples, pa.list_(pa.float32()))], ["path", "rate", "samples"])

    return files.select("path", "content").mapInArrow(run, "path string, rate int, samples array<float>")


def npy_units(spark: SparkSession, records: DataFrame, folder: str) -> DataFrame:
    """Records (units: file name, length) with the int array of their .npy file; lengths must agree."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("units"), "content")

    def run(batches):
        import io

        import numpy as np

        for b in batches:
            arrays = [np.load(io.BytesIO(c)).astype("int32").ravel() for c in b.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("units"), pa.array(arrays, pa.list_(pa.int32()))], ["units", "codes"])

    joined = records.join(files.mapInArrow(run, "units string, codes array<int>"), "units")
    same = F.assert_true(F.size("codes") == F.col("length"), "unit count differs from length")
    return joined.where(F.coalesce(same.cast("string"), F.lit("")) == "")


class _Part(InputPartition):
    pass


class SqliteQuery(DataSource):
    """``format("sqlite").option("path", file).option("query", sql)``: a query's rows, rolled back afterwards."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _SqliteReader(self.options)

    def schema(self) -> str:
        raise ValueError("give a schema")


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.query = options["path"], options["query"]

    def partitions(self) -> list[InputPartition]:
        return [_Part(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            con.execute("BEGIN")
            yield from con.execute(self.query)
            con.rollback()


class ArrowFiles(DataSource):
    """``format("arrow_files")``: Arrow stream or file format, a partition for each path (comma-separated)."""

    @classmethod
    def name(cls) -> str:
        return "arrow_files"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _ArrowReader(self.options, schema)


class _ArrowReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.paths, self.names = options["path"].split(","), schema.names

    def partitions(self) -> list[InputPartition]:
        return [_Part(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        with pa.memory_map(partition.value) as source:
            try:
                table = pa.ipc.open_file(source).read_all()
            except pa.ArrowInvalid:
                source.seek(0)
                table = pa.ipc.open_stream(source).read_all()
        yield from table.select(self.names).to_batches()


# -- sinks ---------------------------------------------------------------------------------------------------------------
def write_parquet(df: DataFrame, path: str, single: bool = False, max_rows: int | None = None) -> None:
    df = df.coalesce(1) if single else df
    writer = df.write.mode("overwrite")
    (writer.option("maxRecordsPerFile", max_rows) if max_rows else writer).parquet(path)


def write_nonempty(df: DataFrame, path: str) -> bool:
    """Write parquet unless there are no rows; whether it was written."""
    if df.isEmpty():
        return False
    write_parquet(df, path)
    return True


def write_jsonl(df: DataFrame, path: str, by: str | None = None, mode: str = "overwrite") -> None:
    """JSON lines; with ``by`` a folder for each of its values; ``mode`` append for logs."""
    writer = df.write.mode(mode)
    (writer.partitionBy(by) if by else writer).json(path)


def write_transcripts(df: DataFrame, path: str) -> None:
    """Two lines an utterance: ``id:<tab>ref=...`` and ``id:<tab>hyp=...``."""
    lines = F.array(*(F.concat("id", F.lit(f":\t{k}="), k) for k in ("ref", "hyp")))
    df.select(F.explode(lines).alias("value")).write.mode("overwrite").text(path)


def _write_bytes(spark: SparkSession, path: str, contents: dict[str, bytes]) -> None:
    """Small files by name, through the file system of ``path``."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name, data in contents.items():
        target = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        out = target.getFileSystem(conf).create(target, True)
        out.write(bytearray(data))
        out.close()


def write_texts(spark: SparkSession, path: str, texts: dict[str, str]) -> None:
    _write_bytes(spark, path, {name: text.encode() for name, text in texts.items()})


def write_npy(spark: SparkSession, path: str, arrays: dict[str, list[int]]) -> None:
    import io

    import numpy as np

    def packed(values):
        np.save(buffer := io.BytesIO(), np.array(values, np.int64))
        return buffer.getvalue()

    _write_bytes(spark, path, {name: packed(v) for name, v in arrays.items()})


def write_wav(spark: SparkSession, path: str, waves: dict[str, list[float]], rate: int) -> None:
    """16-bit WAV files of one channel."""
    import io
    import wave

    import numpy as np

    def packed(values):
        with wave.open(buffer := io.BytesIO(), "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(rate)
            w.writeframes((np.array(values) * 32767).round().astype("<i2").tobytes())
        return buffer.getvalue()

    _write_bytes(spark, path, {name: packed(v) for name, v in waves.items()})


def write_sqlite(df: DataFrame, path: str, table: str) -> None:
    """A small table as a SQLite file, from the driver."""
    rows = df.collect()
    with sqlite3.connect(path) as con:
        con.execute(f"CREATE TABLE {table} ({', '.join(df.columns)})")
        con.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(df.columns))})", [tuple(r) for r in rows])
    con.close()


def write_evaluation(df: DataFrame, path: str, config: dict) -> None:
    """Results with the run's settings as columns; nested logs stay nested."""
    write_parquet(df.select("*", *(F.lit(v).alias(k) for k, v in config.items())), path)


def write_run(df: DataFrame, path: str, run_id: str) -> None:
    """Append a run's rows in its own partition."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def cached(spark: SparkSession, path: str, make, max_rows: int | None = None) -> DataFrame:
    """The table at ``path``; it is made and written first if nothing is there, in files of ``max_rows`` at most."""
    try:
        return spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    write_parquet(make(), path, max_rows=max_rows)
    return spark.read.parquet(path)


def latest_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")
