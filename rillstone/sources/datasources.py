"""Spark data sources for the binary containers. ``register(spark)`` makes the formats known.

* ``flow_capture``: captures, streams or batches <-> messages.
* ``flow_snapshot``: snapshots <-> flows, one snapshot a partition.
* ``schema_catalog``: catalogs <-> schemas.

Tasks open files by Arrow's file systems, so a path is one of this machine, of hdfs, s3 or gs, that driver
and executors share; one file is one partition. Written files stand under a staging folder until the
driver commits the job and moves those of the tasks that won into place. :func:`read_captures` and
:func:`stream_captures` take any path that Spark itself can read.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, InputPartition, WriterCommitMessage

from ..types import CAPTURE_MAGIC, FLOWS, MESSAGES
from . import framing
from .messages import message_rows, parse_streams

#: Bytes of streams after which the sink starts another capture file, and that a reader sends on at once.
MAX_FILE_BYTES, BATCH_BYTES = 16 << 20, 4 << 20


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def _files(path: str) -> list[str]:
    """The file, or all files below the folder but hidden ones, as paths of its file system."""
    system, at = _at(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [at]
    found = system.get_file_info(fs.FileSelector(at, recursive=True))
    hidden = lambda p: any(part.startswith(("_", ".")) for part in p.removeprefix(at).split("/"))
    return sorted(f.path for f in found if f.type == fs.FileType.File and not hidden(f.path))


def _content(root: str, path: str) -> bytes:
    with _at(root)[0].open_input_stream(path) as f:
        return f.read()


@dataclass
class FilePartition(InputPartition):
    path: str


def streams_of(data: bytes, framing_name: str = "auto") -> Iterator[tuple[int | None, bytes]]:
    """(timestamp, stream) pairs; ``auto`` tells captures by their magic from single streams."""
    if framing_name == "capture" or framing_name == "auto" and data[:4] == CAPTURE_MAGIC:
        yield from framing.parse_capture(data)
    elif framing_name == "batch":
        yield from ((None, s) for s in framing.parse_batch(data))
    else:
        yield None, data


def file_rows(path: str, data: bytes, framing_name: str, transport: str, strict: bool) -> Iterator[tuple]:
    """The i-th stream of a file has transport i, or with ``transport=file`` all share the file's."""
    try:
        found = list(streams_of(data, framing_name))
    except framing.FramingError as e:
        yield (path, None, None, None, None, None, None, None, None, None, str(e))
        return
    for i, (ts, raw) in enumerate(found, 1):
        yield from message_rows(f"{path}#{i}", i if transport == "record" else 1, ts, raw, strict)


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.names: set[str] | None = None

    def pushFilters(self, filters: list) -> Iterator:
        """Equality with a type name is applied while reading; everything else is Spark's."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("type_name",):
                self.names = (self.names or {f.value}) & {f.value}
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [FilePartition(f) for f in _files(self.options["path"])]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        data = _content(self.options["path"], partition.path)
        for row in file_rows(partition.path, data, self.options.get("framing", "auto"), self.options.get("transport", "record"), self.options.get("strict", "false") == "true"):
            if self.names is None or row[6] in self.names:
                yield row


@dataclass
class Staged(WriterCommitMessage):
    name: str
    more: tuple[str, ...] = ()


class FileWriter(DataSourceWriter):
    """A file a partition, unless :meth:`files` cuts it into several."""

    suffix = ""

    def __init__(self, options: dict, overwrite: bool = False):
        self.path, self.overwrite = options["path"], overwrite
        self.options = options
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        system, at = _at(self.path)
        system.create_dir(f"{at}/{self.staging}")
        names = []
        for content in self.files(iterator):
            names.append(f"part-{uuid.uuid4().hex}.{self.suffix}")
            with system.open_output_stream(f"{at}/{self.staging}/{names[-1]}") as f:
                f.write(content)
        return Staged(names[0], tuple(names[1:]))

    def commit(self, messages: list) -> None:
        """What tasks that were run again, or twice, have left in the staging folder goes with it."""
        system, at = _at(self.path)
        old = _files(self.path) if self.overwrite and system.get_file_info(at).type == fs.FileType.Directory else []
        system.create_dir(at)
        for name in (name for m in messages if m is not None for name in (m.name, *m.more)):
            system.move(f"{at}/{self.staging}/{name}", f"{at}/{name}")
        for path in old:
            system.delete_file(path)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        system, at = _at(self.path)
        if system.get_file_info(f"{at}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{at}/{self.staging}")

    def files(self, rows: Iterator) -> Iterator[bytes]:
        yield self.pack(rows)


class CaptureWriter(FileWriter):
    """Rows (ts, stream) -> capture files, a new one whenever one has ``maxFileBytes``: a reader holds a whole file."""

    suffix = "cap"

    def files(self, rows: Iterator) -> Iterator[bytes]:
        most, held, size, any_file = int(self.options.get("maxFileBytes", MAX_FILE_BYTES)), [], 0, False
        for r in rows:
            held.append((r[0], bytes(r[1])))
            size += len(held[-1][1])
            if size >= most:
                yield framing.capture(held)
                held, size, any_file = [], 0, True
        if held or not any_file:
            yield framing.capture(held)


class SnapshotWriter(FileWriter):
    suffix = "snap"

    def pack(self, rows: Iterator) -> bytes:
        return framing.snapshot(tuple(r[c] or 0 for c in framing.SNAPSHOT_COLUMNS) for r in rows)


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "flow_capture"

    def schema(self):
        return MESSAGES

    def reader(self, schema) -> DataSourceReader:
        return CaptureReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return CaptureWriter(self.options, overwrite)


class SnapshotReader(CaptureReader):
    def pushFilters(self, filters: list) -> Iterator:
        yield from filters

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        yield from framing.parse_snapshot(_content(self.options["path"], partition.path))


class SnapshotSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "flow_snapshot"

    def schema(self):
        return FLOWS

    def reader(self, schema) -> DataSourceReader:
        return SnapshotReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return SnapshotWriter(self.options, overwrite)


class CatalogReader(SnapshotReader):
    def read(self, partition: FilePartition) -> Iterator[tuple]:
        yield from framing.parse_catalog(_content(self.options["path"], partition.path))


class CatalogWriter(FileWriter):
    """Rows (schema_id, version, fields) -> one catalog a partition."""

    suffix = "cat"

    def pack(self, rows: Iterator) -> bytes:
        return framing.catalog((r[0], r[1], [tuple(f) for f in r[2] or ()]) for r in rows)


class CatalogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "schema_catalog"

    def schema(self) -> str:
        return "schema_id int, version int, fields array<struct<id:int,type:string,width:int,name:string>>"

    def reader(self, schema) -> DataSourceReader:
        return CatalogReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return CatalogWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (CaptureSource, SnapshotSource, CatalogSource):
        spark.dataSource.register(source)


def read_captures(spark: SparkSession, path: str, framing_name: str = "auto", strict: bool = False, transport: str = "record") -> DataFrame:
    """Messages of files on any path that Spark can read, by its own binary reader.

    The i-th stream of a file has transport i; with ``transport="file"`` a file's streams share a session,
    numbered by the hash of its path.
    """
    return messages_of(spark.read.format("binaryFile").load(path), framing_name, strict, transport)


def stream_captures(spark: SparkSession, path: str, framing_name: str = "auto", strict: bool = False, transport: str = "record", **options: str) -> DataFrame:
    """The same for files as they come. Spark's file stream lists them, keeps the log of those it has seen in
    the query's checkpoint, whatever their names, and reads them in tasks."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return messages_of(spark.readStream.format("binaryFile").schema(schema).options(**options).load(path), framing_name, strict, transport)


def messages_of(files: DataFrame, framing_name: str = "auto", strict: bool = False, transport: str = "record") -> DataFrame:
    """Messages of containers that any reader has brought in as ``path, content``."""

    def streams(batches):
        import pyarrow as pa

        def whole(held) -> pa.RecordBatch:
            columns = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["stream_id", "transport_id", "capture_ts_ms", "data"])

        for batch in batches:
            for name, number, data in (tuple(c[i].as_py() for c in batch.columns) for i in range(batch.num_rows)):
                try:
                    for _ in streams_of(data, framing_name):  # all or nothing, without keeping it
                        pass
                except framing.FramingError:
                    yield whole([(name, None, None, None)])  # becomes an error row
                    continue
                held, size = [], 0
                for i, (ts, raw) in enumerate(streams_of(data, framing_name), 1):
                    held.append((f"{name}#{i}", i if transport == "record" else number, ts, raw))
                    size += len(raw)
                    if size >= BATCH_BYTES:
                        yield whole(held)
                        held, size = [], 0
                if held:
                    yield whole(held)

    rows = files.select("path", F.xxhash64("path").alias("number"), "content")
    return parse_streams(rows.mapInArrow(streams, "stream_id string, transport_id long, capture_ts_ms long, data binary"), strict)


def encode_snapshot(flows: DataFrame) -> DataFrame:
    """One snapshot of binary for each partition: ``snapshot``, for a sink of any kind."""

    def run(batches):
        import pyarrow as pa

        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([framing.snapshot(rows)], pa.binary())], ["snapshot"])

    return flows.select(*[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in framing.SNAPSHOT_COLUMNS]).mapInArrow(run, "snapshot binary")


def decode_snapshots(df: DataFrame, data: str = "snapshot") -> DataFrame:
    """Flows of binary snapshots, for snapshots that any reader has brought in."""

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(FLOWS)
        for b in batches:
            for raw in b.column(0).to_pylist():
                columns = list(zip(*framing.parse_snapshot(raw), strict=True)) or [()] * len(FLOWS)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema.names)

    return df.select(data).mapInArrow(run, FLOWS)
