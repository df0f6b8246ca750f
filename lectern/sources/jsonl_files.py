"""JSON lines as a data source of its own: ``spark.read.format("lectern_jsonl")`` and ``df.write.format("lectern_jsonl")``.

Each task writes a file of its own under a hidden name; only the files of the attempts that Spark accepts get their names when the job commits, so retried and
speculative tasks leave no doubled lines. Each file is a partition when it is read. Filters on equal values of ``id`` are pushed down: other lines aren't parsed.
The path is one that all machines share: a folder, or a URI that Arrow's file systems open.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "lectern_jsonl"
SCHEMA = "id string, text string, metadata map<string,string>"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    hidden: str | None
    rows: int


@dataclass
class OneFile(InputPartition):
    path: str


class JsonLines(DataSource):
    """Options: path. Columns are strings, and maps of them."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return JsonLinesReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return JsonLinesWriter(self.options["path"], overwrite)


class JsonLinesReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema, self.ids = path, schema, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("id",):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.ids = own if self.ids is None else self.ids & own
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        files, folder = opened(self.path)
        found = files.get_file_info(fs.FileSelector(folder))
        return [OneFile(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.base_name.startswith("part-")] or [OneFile("")]

    def read(self, partition: OneFile) -> Iterator[tuple]:
        if not partition.path:
            return
        files, _ = opened(self.path)
        names = [f.name for f in self.schema.fields]
        marks = None if self.ids is None else [f'"id": {json.dumps(i)}'.encode() for i in self.ids]
        with files.open_input_stream(partition.path) as stream:
            for line in _lines(stream):
                if marks is not None and not any(m in line for m in marks):
                    continue
                row = json.loads(line)
                if self.ids is None or row.get("id") in self.ids:
                    yield tuple(row.get(n) for n in names)


def _lines(stream: pa.NativeFile, size: int = 1 << 20) -> Iterator[bytes]:
    """Lines of a file, a part of it at a time."""
    rest = b""
    while chunk := stream.read(size):
        *whole, rest = (rest + chunk).split(b"\n")
        yield from (x for x in whole if x)
    if rest:
        yield rest


class JsonLinesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, folder = opened(self.path)
        files.create_dir(folder, recursive=True)
        hidden, rows = f"{folder}/_{self.run}-{uuid.uuid4().hex}", 0
        with files.open_output_stream(hidden) as out:
            for batch in iterator:
                for row in batch.to_pylist(maps_as_pydicts="strict"):
                    out.write(json.dumps({k: v for k, v in row.items() if v is not None}).encode() + b"\n")
                rows += batch.num_rows
        return Written(hidden, rows)

    def commit(self, messages: list[Written | None]) -> None:
        files, folder = opened(self.path)
        files.create_dir(folder, recursive=True)
        before = [f.path for f in files.get_file_info(fs.FileSelector(folder)) if f.base_name.startswith("part-")] if self.overwrite else []
        for i, m in enumerate(m for m in messages if m is not None):
            files.move(m.hidden, f"{folder}/part-{i:05d}-{self.run}.jsonl")
        for path in before:
            files.delete_file(path)
        self._sweep()

    def abort(self, messages: list[Written | None]) -> None:
        self._sweep()

    def _sweep(self) -> None:
        """What attempts of this run left that weren't accepted."""
        files, folder = opened(self.path)
        for f in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if f.base_name.startswith(f"_{self.run}-"):
                files.delete_file(f.path)


def registered(spark: SparkSession) -> SparkSession:
    """The session, which knows the format, with filters pushed down to it."""
    spark.dataSource.register(JsonLines)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark
