"""JSON arrays as a data source of its own: tasks write parts, the commit publishes them all at once."""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

MANIFEST = "manifest.json"
#: Bytes of a part at most, but for a longer single row.
PART_BYTES = 64 << 20


@dataclass
class _Written(WriterCommitMessage):
    """Parts of a task: name, rows, bytes."""

    task: int
    parts: list[tuple[str, int, int]]


class JsonArrays(DataSource):
    """Write one text column, each a JSON value, as files that are JSON arrays; a manifest names those that count."""

    @classmethod
    def name(cls) -> str:
        return "json_arrays"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        if [f.dataType for f in schema.fields] != [T.StringType()]:
            raise ValueError("json_arrays takes one text column")
        return _Writer(self.options["path"], int(self.options.get("part_bytes", PART_BYTES)), overwrite)


class _Writer(DataSourceArrowWriter):
    """Files have names of their own, so a task that runs twice harms nothing: only what a commit was told of is listed."""

    def __init__(self, path: str, part_bytes: int, overwrite: bool):
        self.path, self.part_bytes, self.overwrite = path, part_bytes, overwrite

    def _place(self) -> tuple[fs.FileSystem, str]:
        system, path = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        system.create_dir(path, recursive=True)
        return system, path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        system, path = self._place()
        parts: list[tuple[str, int, int]] = []
        out, rows, size = None, 0, 0

        def close() -> None:
            nonlocal out
            out.write(b"\n]")
            out.close()
            parts.append((name, rows, size))
            out = None

        name = ""
        try:
            for batch in iterator:
                for value in batch.column(0).to_pylist():
                    data = ("null" if value is None else value).encode()
                    if out and size + len(data) > self.part_bytes:
                        close()
                    if out is None:
                        name, rows, size = f"part-{uuid.uuid4().hex}.json", 0, 0
                        out = system.open_output_stream(posixpath.join(path, name))
                    out.write((b",\n" if rows else b"[\n") + data)
                    rows, size = rows + 1, size + len(data)
            if out:
                close()
        except BaseException:
            if out:
                out.close()
                parts.append((name, rows, size))
            _delete(system, path, [p[0] for p in parts])
            raise
        return _Written(TaskContext.get().partitionId(), parts)

    def commit(self, messages: list[_Written | None]) -> None:
        """Name all parts in the order of tasks; the manifest comes into being by a move, after which older parts are deleted."""
        system, path = self._place()
        parts = [{"file": f, "rows": n, "bytes": b} for m in sorted((m for m in messages if m), key=lambda m: m.task) for f, n, b in m.parts]
        target = posixpath.join(path, MANIFEST)
        before = _listed(system, target)
        if not self.overwrite:
            parts = before + parts
        draft = posixpath.join(path, f"_draft-{uuid.uuid4().hex}")
        with system.open_output_stream(draft) as out:
            out.write(json.dumps({"rows": sum(p["rows"] for p in parts), "parts": parts}).encode())
        if system.get_file_info(target).type != fs.FileType.NotFound and not isinstance(system, fs.LocalFileSystem):
            system.delete_file(target)
        system.move(draft, target)
        if self.overwrite:
            _delete(system, path, [p["file"] for p in before])

    def abort(self, messages: list[_Written | None]) -> None:
        system, path = self._place()
        _delete(system, path, [p[0] for m in messages if m for p in m.parts])


def _listed(system: fs.FileSystem, manifest: str) -> list[dict]:
    if system.get_file_info(manifest).type == fs.FileType.NotFound:
        return []
    with system.open_input_stream(manifest) as f:
        return json.loads(f.read())["parts"]


def _delete(system: fs.FileSystem, path: str, names: list[str]) -> None:
    for name in names:
        if system.get_file_info(posixpath.join(path, name)).type != fs.FileType.NotFound:
            system.delete_file(posixpath.join(path, name))


def write_json_arrays(df: DataFrame, path: str, part_bytes: int = PART_BYTES, append: bool = False) -> None:
    """All rows as JSON arrays under ``path``, in parts that tasks write; a job that fails leaves what was there before."""
    df.sparkSession.dataSource.register(JsonArrays)
    rows = df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}).alias("value"))
    rows.write.format("json_arrays").mode("append" if append else "overwrite").option("part_bytes", part_bytes).save(path)


def read_json_arrays(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The rows that the manifest under ``path`` lists; files that no commit named are not read. Without a manifest, an error."""
    text = spark.read.option("wholetext", True).text(f"{path}/{MANIFEST}").first()
    files = [f"{path}/{p['file']}" for p in json.loads(text["value"])["parts"]] if text else []
    return spark.read.schema(schema).option("multiLine", True).json(files) if files else spark.createDataFrame([], schema)
