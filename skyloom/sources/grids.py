"""A data source of weather messages: files of gridded fields, one partition a message, pruned before anything but headers is read.

A file is messages one after the other: a mark, the lengths of header and payload, the header (name, level, hour, number of values) and the
payload, three numbers a value (latitude, longitude, value). Paths may be of any file system that pyarrow opens.

Equalities, lists and bounds on name, level and hour decide which messages are opened if the session enables
``spark.sql.python.filterPushdown.enabled``; otherwise Spark filters the rows.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

MARK = b"SKYGRID1"
KEYS = ("name", "level", "hour")
SCHEMA = "name string, level int, hour long, latitude double, longitude double, value double"
_HEAD = struct.Struct("<8sIQ")


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def headers(path: str) -> Iterator[tuple[str, int, dict]]:
    """(file, place of the payload, header) of every message below ``path``; payloads are skipped."""
    system, top = _open(path)
    for f in sorted(system.get_file_info(fs.FileSelector(top, recursive=True)), key=lambda f: f.path):
        if f.type != fs.FileType.File or not f.path.endswith(".grid"):
            continue
        with system.open_input_file(f.path) as file:
            at = 0
            while at < f.size:
                file.seek(at)
                mark, head, body = _HEAD.unpack(file.read(_HEAD.size))
                if mark != MARK:
                    raise ValueError(f"{f.path}: no message at {at}")
                yield f.path, at + _HEAD.size + head, json.loads(file.read(head))
                at += _HEAD.size + head + body


@dataclass
class Message(InputPartition):
    """A message of a file."""

    path: str
    at: int
    header: dict


_TESTS = {
    EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
}


class GridReader(DataSourceReader):
    """Every message is a partition; its header alone is read before."""

    def __init__(self, path: str):
        self.path, self.tests = path, []

    def wanted(self, header: dict) -> bool:
        return all(header[c] is not None and _TESTS[kind](header[c], v) for kind, c, v in self.tests)

    def partitions(self) -> list[Message]:
        return [Message(*m) for m in headers(self.path) if self.wanted(m[2])]

    def read(self, partition: Message) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Message):
            return  # no message is left
        system, _ = _open(self.path)
        n = partition.header["n"]
        with system.open_input_file(partition.path) as file:
            file.seek(partition.at)
            values = np.frombuffer(file.read(24 * n), "<f8").reshape(n, 3)
        same = lambda c, kind: pa.array([partition.header[c]] * n, kind)
        nan = lambda x: pa.array(x, pa.float64(), from_pandas=True)
        yield pa.RecordBatch.from_arrays([same("name", pa.string()), same("level", pa.int32()), same("hour", pa.int64()), *[nan(values[:, k].copy()) for k in range(3)]], ["name", "level", "hour", "latitude", "longitude", "value"])


class PruningReader(GridReader):
    """Takes filters on name, level and hour; messages that don't pass are never opened."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in KEYS:
                self.tests.append((type(f), f.attribute[0], f.value))
            else:
                yield f


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class GridWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex[:12]

    def write(self, rows: Iterator[Row]) -> Written:
        system, top = _open(self.path)
        system.create_dir(top, recursive=True)
        path, out, key, values = f"{top}/{self.run}-{uuid.uuid4().hex[:12]}.grid", None, None, []

        def put() -> None:
            nonlocal out
            out = out or system.open_output_stream(f"{path}.part")
            head = json.dumps(dict(zip(KEYS, key, strict=True)) | {"n": len(values)}).encode()
            body = np.array(values, "<f8").tobytes()
            out.write(_HEAD.pack(MARK, len(head), len(body)) + head + body)

        for r in rows:
            if values and (r.name, r.level, r.hour) != key:
                put()
                values = []
            key = (r.name, r.level, r.hour)
            values.append(tuple(float("nan") if x is None else x for x in (r.latitude, r.longitude, r.value)))
        if values:
            put()
        if out is None:
            return Written(None)
        out.close()
        return Written(path)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        # files get their names once all tasks are done, so a task that ran twice leaves one file
        system, top = _open(self.path)
        new = [m.path for m in messages if m and m.path]
        if self.overwrite and system.get_file_info(top).type == fs.FileType.Directory:
            for f in system.get_file_info(fs.FileSelector(top, recursive=True)):
                if f.type == fs.FileType.File and f.path.endswith(".grid"):
                    system.delete_file(f.path)
        for path in new:
            system.move(f"{path}.part", path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _ = _open(self.path)
        for m in messages:
            if m and m.path:
                system.delete_file(f"{m.path}.part")


class GridSource(DataSource):
    """``skyloom_grid``: reads and writes folders of message files."""

    @classmethod
    def name(cls) -> str:
        return "skyloom_grid"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> GridReader:
        # Spark refuses a reader that takes filters where the session doesn't push them
        return (PruningReader if self.options.get("prune") == "true" else GridReader)(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> GridWriter:
        return GridWriter(self.options["path"], overwrite)


def write_grid(grid: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows (name, level, hour, latitude, longitude, value) as messages: all values of a name, level and hour are one, in the order of places."""
    rows = grid.select(*[f.split()[0] for f in SCHEMA.split(", ")]).repartition(*KEYS).sortWithinPartitions(*KEYS, "latitude", "longitude")
    grid.sparkSession.dataSource.register(GridSource)
    rows.write.format("skyloom_grid").mode(mode).save(path)


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """The messages below ``path``; pruned by filters where the session pushes them to Python sources."""
    spark.dataSource.register(GridSource)
    return spark.read.format("skyloom_grid").option("prune", spark.conf.get("spark.sql.python.filterPushdown.enabled")).load(path)
