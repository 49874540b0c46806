"""Files by name as a data source: each row is a file; a commit moves all of them into place."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


@dataclass
class _Drafts(WriterCommitMessage):
    """(draft, name) of a task's files."""

    files: list[tuple[str, str]]


class NamedFiles(DataSource):
    """Write rows (name, content) as files; equal names are an error of the commit, before any file is in place."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        if [f.dataType for f in schema.fields] != [T.StringType(), T.BinaryType()]:
            raise ValueError("named_files takes a name and binary content")
        return _Writer(self.options["path"])


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def _place(self) -> tuple[fs.FileSystem, str]:
        system, path = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        system.create_dir(path, recursive=True)
        return system, path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Drafts:
        system, path = self._place()
        files: list[tuple[str, str]] = []
        try:
            for batch in iterator:
                for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if not name or "/" in name or name.startswith((".", "_")):
                        raise ValueError(f"no name of a file: {name!r}")
                    draft = posixpath.join(path, f"_draft-{uuid.uuid4().hex}")
                    files.append((draft, name))
                    with system.open_output_stream(draft) as out:
                        out.write(content or b"")
        except BaseException:
            self._drop(system, files)
            raise
        return _Drafts(files)

    def _drop(self, system: fs.FileSystem, files: list[tuple[str, str]]) -> None:
        for draft, _ in files:
            if system.get_file_info(draft).type != fs.FileType.NotFound:
                system.delete_file(draft)

    def commit(self, messages: list[_Drafts | None]) -> None:
        system, path = self._place()
        files = [f for m in messages if m for f in m.files]
        if len({name for _, name in files}) < len(files):
            self._drop(system, files)
            raise ValueError("several rows have one name")
        for draft, name in files:
            system.move(draft, posixpath.join(path, name))

    def abort(self, messages: list[_Drafts | None]) -> None:
        self._drop(self._place()[0], [f for m in messages if m for f in m.files])


def write_files(rows: DataFrame, path: str) -> None:
    """Each row of (name, content) as a file under ``path``, in place of one of that name."""
    rows.sparkSession.dataSource.register(NamedFiles)
    rows.select("name", F.col("content").cast("binary").alias("content")).write.format("named_files").mode("append").save(path)


def copy_above(spark, source: str, target: str, field: str, least: float) -> DataFrame:
    """(name, score): the JSON files under ``source`` whose ``field`` is above ``least``, which are copied to ``target`` as they are.

    Files that don't parse or have no such number are not copied. Tasks read and write the files; each is held whole.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(source)
    score = F.try_variant_get(F.try_parse_json(F.col("content").cast("string")), "$." + field, "double")
    good = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content", score.alias("score")).where(F.col("score") > least)
    write_files(good, target)
    return good.select("name", "score")
