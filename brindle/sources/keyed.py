"""A data source of our own: Arrow files by ranges of a key, listed in a manifest, read file by file or as a stream."""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from brindle.session import ship

NAME = "brindle_keyed"
#: Filters on the key that leave files unread, as tests of a file's least and greatest key.
_TESTS = {
    EqualTo: lambda low, high, v: low <= v <= high,
    GreaterThan: lambda low, high, v: high > v,
    GreaterThanOrEqual: lambda low, high, v: high >= v,
    LessThan: lambda low, high, v: low < v,
    LessThanOrEqual: lambda low, high, v: low <= v,
}


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, any that Arrow knows, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _commits(path: str) -> list[dict]:
    """All commits in order, each {"files": [{name, low, high, rows}], "schema": ...}."""
    fs, at = _store(path)
    found = [f.path for f in fs.get_file_info(pafs.FileSelector(f"{at}/commits", allow_not_found=True)) if f.base_name.startswith("c")]
    return [json.loads(fs.open_input_stream(p).read()) for p in sorted(found)]


@dataclass
class Piece(InputPartition):
    name: str


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class KeyedFiles(DataSource):
    """format("brindle_keyed"), options path and key (a column of whole numbers). Appending and overwriting; reading; streams of commits."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        commits = _commits(self.options["path"])
        if not commits:
            raise ValueError(f"nothing is written at {self.options['path']}")
        return StructType.fromJson(commits[-1]["schema"])

    def reader(self, schema: StructType) -> DataSourceReader:
        kind = FilteredReader if self.options.get("filtered") == "true" else KeyedReader
        return kind(self.options["path"], self.options["key"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return KeyedStream(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return KeyedWriter(self.options["path"], self.options["key"], schema, overwrite)


class KeyedReader(DataSourceReader):
    """One partition for each file whose range of keys the filters allow."""

    def __init__(self, path: str, key: str):
        self.path, self.key, self.tests = path, key, []

    def partitions(self) -> list[Piece]:
        files = [f for c in _commits(self.path) for f in c["files"]]
        asked = [f for f in files if not self.tests or f["low"] is not None and all(_TESTS[t](f["low"], f["high"], v) for t, v in self.tests)]
        return [Piece(f["name"]) for f in asked] or [Piece("")]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        yield from _batches(self.path, partition.name)


class FilteredReader(KeyedReader):
    """The same, for load(): it is offered filters."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute == (self.key,) and f.value is not None:
                self.tests.append((type(f), f.value))
            yield f  # files are left out by their ranges only: Spark tests the rows


class KeyedStream(DataSourceStreamReader):
    """Batches are runs of commits; an offset is the number of those read."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"commits": 0}

    def latestOffset(self) -> dict:
        return {"commits": len(_commits(self.path))}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return [Piece(f["name"]) for c in _commits(self.path)[start["commits"] : end["commits"]] for f in c["files"]]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        yield from _batches(self.path, partition.name)


def _batches(path: str, name: str) -> Iterator[pa.RecordBatch]:
    if not name:
        return
    fs, at = _store(path)
    with fs.open_input_file(f"{at}/files/{name}") as f, pa.ipc.open_file(f) as rows:
        for i in range(rows.num_record_batches):
            yield rows.get_batch(i)


class KeyedWriter(DataSourceArrowWriter):
    """Each task writes a file; they count once the commit that names them is there. One writer at a time."""

    def __init__(self, path: str, key: str, schema: StructType, overwrite: bool):
        self.path, self.key, self.schema, self.overwrite = path, key, schema.jsonValue(), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, at = _store(self.path)
        name, low, high, rows, out = f"{uuid.uuid4().hex}.arrow", None, None, 0, None
        for batch in iterator:
            if out is None:
                fs.create_dir(f"{at}/files", recursive=True)
                sink = fs.open_output_stream(f"{at}/files/{name}")
                out = pa.ipc.new_file(sink, batch.schema)
            out.write_batch(batch)
            rows += batch.num_rows
            ends = pc.min_max(batch.column(batch.schema.get_field_index(self.key))).as_py()
            if ends["min"] is not None:
                low, high = (ends["min"] if low is None else min(low, ends["min"])), (ends["max"] if high is None else max(high, ends["max"]))
        if out is None:
            return Written([])
        out.close()
        sink.close()
        return Written([{"name": name, "low": low, "high": high, "rows": rows}])

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = _store(self.path)
        fs.create_dir(f"{at}/commits", recursive=True)
        old = [f.path for f in fs.get_file_info(pafs.FileSelector(f"{at}/commits")) if f.base_name.startswith("c")]
        files = [f for m in messages if m for f in m.files]
        draft = f"{at}/commits/draft-{uuid.uuid4().hex}"
        with fs.open_output_stream(draft) as out:
            out.write(json.dumps({"schema": self.schema, "files": files}).encode())
        number = 1 + max((int(p.rsplit("/c", 1)[1][:-5]) for p in old), default=-1)
        fs.move(draft, f"{at}/commits/c{number:010d}.json")
        if self.overwrite:
            for p in old:
                fs.delete_file(p)

    def abort(self, messages: list[Written | None]) -> None:
        fs, at = _store(self.path)
        for m in messages:
            for f in m.files if m else ():
                fs.delete_file(f"{at}/files/{f['name']}")


def register(spark: SparkSession) -> None:
    """Make the format known to the session.

    The classes are sent as they are, not by their names: the process that plans a Python stream is not given files sent to workers.
    """
    ship(spark)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(KeyedFiles)


def load(spark: SparkSession, path: str, key: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """The rows whose key is not below ``low`` nor above ``high``; files out of the range are not opened.

    Limits reach the source as filters that Spark offers it, and so do others put on the result. Spark 4.1 keeps what a
    Python source made of its last filters for later plans over one loaded table that have none to offer. With a limit
    every plan has one; without any, the source that takes no filters is used.
    """
    register(spark)
    rows = spark.read.format(NAME).option("key", key)
    if low is None and high is None:
        return rows.load(path)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    found = rows.option("filtered", "true").load(path)
    found = found if low is None else found.where(F.col(key) >= low)
    return found if high is None else found.where(F.col(key) <= high)
