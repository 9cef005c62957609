"""Database dumps in BSON as a Spark data source, read in ranges of bytes.

A dump is documents one after another, each with its length, so a range can begin anywhere: its reader looks for the next
document's first field, ``_id`` in dumps, and checks that the documents behind it follow each other. It reads the
documents that begin in its range, and checks that it ends where the next range begins. Only the fields of the schema are
decoded, the others are stepped over by their length; equality filters on whole numbers and strings are checked before a
document's other fields are decoded. ``read_dump`` lets Spark push filters down to Python sources in its session.

Defined results: a field that is absent, null, or of another kind than its column is null; dates are timestamps or, in
numeric columns, milliseconds; nested documents and arrays are their JSON text; a file whose first document doesn't begin
with the field is read as one range; empty files give no rows; broken lengths are errors, and so are ranges that don't meet,
which documents without the field can cause.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

#: Bytes of a range, rows of a batch, and documents that must follow each other where a range begins.
RANGE, ROWS, CHAIN = 64 << 20, 4096, 4
#: Sizes of values of fixed size, by kind.
_FIXED = {0x01: 8, 0x06: 0, 0x07: 12, 0x08: 1, 0x09: 8, 0x0A: 0, 0x10: 4, 0x11: 8, 0x12: 8, 0x13: 16, 0x7F: 0, 0xFF: 0}
_STRINGS, _DOCUMENTS = (0x02, 0x0D, 0x0E), (0x03, 0x04, 0x0F)
_KINDS = {*_FIXED, *_STRINGS, *_DOCUMENTS, 0x05, 0x0B, 0x0C}

#: The dump's file and its fields, by the kind of metric.
METRICS = {
    "io": ("FileIOSummaryGw.bson", ("bytesRead", "bytesWritten")),
    "process": ("ProcessSummaryGw.bson", ("processCount", "ioActiveProcessCount")),
    "operation": ("FileIOSummaryGw.bson", ("operationRead", "operationWrite")),
    "access": ("FileIOSummaryGw.bson", tuple(f"access{p}{d}" for d in ("Read", "Write") for p in ("Rand", "Seq", "Str", "Uncl"))),
    "event": ("JobEvent.bson", ("type", "message")),
}


def _int32(raw: bytes, at: int) -> int:
    return struct.unpack_from("<i", raw, at)[0]


def fields(raw: bytes) -> Iterator[tuple[str, int, int, int]]:
    """(name, kind, begin, end) of each field of a document, values undecoded."""
    at, end = 4, len(raw) - 1
    while at < end:
        kind = raw[at]
        stop = raw.index(0, at + 1)
        name, at = raw[at + 1 : stop].decode(), stop + 1
        if kind in _FIXED:
            size = _FIXED[kind]
        elif kind in _STRINGS:
            size = 4 + _int32(raw, at)
        elif kind in _DOCUMENTS:
            size = _int32(raw, at)
        elif kind == 0x05:
            size = 5 + _int32(raw, at)
        elif kind == 0x0B:
            size = raw.index(0, raw.index(0, at) + 1) + 1 - at
        elif kind == 0x0C:
            size = 4 + _int32(raw, at) + 12
        else:
            raise ValueError(f"unknown kind {kind}")
        yield name, kind, at, at + size
        at += size


def value(raw: bytes, kind: int, begin: int, end: int):
    """A decoded value; dates are milliseconds, other binary kinds hexadecimal text."""
    if kind == 0x01:
        return struct.unpack_from("<d", raw, begin)[0]
    if kind in _STRINGS:
        return raw[begin + 4 : end - 1].decode()
    if kind == 0x08:
        return raw[begin] != 0
    if kind == 0x10:
        return _int32(raw, begin)
    if kind in (0x09, 0x11, 0x12):
        return struct.unpack_from("<q", raw, begin)[0]
    if kind == 0x03:
        return {n: value(raw[begin:end], k, a, b) for n, k, a, b in fields(raw[begin:end])}
    if kind == 0x04:
        return [value(raw[begin:end], k, a, b) for _, k, a, b in fields(raw[begin:end])]
    return None if kind in (0x06, 0x0A, 0x7F, 0xFF) else raw[begin:end].hex()


def _fitted(found, kind: int, wanted: T.DataType):
    """A decoded value as its column's kind, or null."""
    if isinstance(wanted, T.StringType):
        return found if found is None or isinstance(found, str) else json.dumps(found)
    if isinstance(wanted, T.TimestampType):
        return found * 1000 if kind == 0x09 else None
    if isinstance(wanted, T.BooleanType):
        return found if isinstance(found, bool) else None
    if isinstance(found, bool) or not isinstance(found, (int, float)):
        return None
    if isinstance(wanted, T.FractionalType):
        return float(found)
    return int(found) if found == int(found) else None


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    """The documents of a file that begin in [begin, end)."""

    path: str
    begin: int
    end: int
    size: int


class _Documents:
    """A dump's documents by their place."""

    def __init__(self, file, size: int, first: str):
        self.file, self.size, self.mark = file, size, first.encode() + b"\0"

    def bytes_at(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def length(self, at: int) -> int:
        """The length of the document at a place, 0 where none can begin."""
        head = self.bytes_at(at, 4)
        size = _int32(head, 0) if len(head) == 4 else 0
        return size if 5 <= size <= self.size - at and self.bytes_at(at + size - 1, 1) == b"\0" else 0

    def begins(self, at: int) -> bool:
        """Do documents follow each other from here?"""
        for _ in range(CHAIN):
            if at == self.size:
                return True
            size = self.length(at)
            head = self.bytes_at(at + 4, 1 + len(self.mark))
            if not size or head[1:] != self.mark or head[0] not in _KINDS:
                return False
            at += size
        return True

    def first_from(self, at: int) -> int:
        """Where the first document at or after a place begins; the file's size if none does."""
        step, begin = 1 << 16, max(at, 0)
        while begin < self.size:
            raw = self.bytes_at(begin, step + 5 + len(self.mark))
            found = raw.find(self.mark, 5)
            while found >= 0 and found - 5 < step:
                if self.begins(begin + found - 5):
                    return begin + found - 5
                found = raw.find(self.mark, found + 1)
            begin += step
        return self.size


class BsonReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.fields = {f.name: f.dataType for f in schema.fields}
        self.path, self.range, self.first = options["path"], int(options.get("rangebytes", RANGE)), options.get("firstfield", "_id")
        self.equal: dict[str, object] = {}
        self.arrow = pa.schema([(n, _ARROW.get(type(k), pa.string())) for n, k in self.fields.items()])

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and type(f.value) in (int, str) and isinstance(self.fields.get(f.attribute[0]), (T.IntegralType, T.StringType)):
                if self.equal.setdefault(f.attribute[0], f.value) == f.value:
                    continue
            yield f

    def partitions(self) -> list[Range]:
        system, path = _opened(self.path)
        info = system.get_file_info(path)
        found = [info] if info.is_file else [f for f in system.get_file_info(pafs.FileSelector(path, recursive=True)) if f.is_file and f.path.endswith(".bson")]
        out = []
        for file in sorted(found, key=lambda f: f.path):
            with system.open_input_file(file.path) as opened:
                split = file.size and _Documents(opened, file.size, self.first).begins(0)
            step = self.range if split else max(file.size, 1)
            out += [Range(file.path, b, min(b + step, file.size), file.size) for b in range(0, file.size, step)]
        return out or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.size:
            return
        system, _ = _opened(self.path)
        with system.open_input_file(part.path) as opened:
            documents = _Documents(opened, part.size, self.first)
            at = documents.first_from(part.begin) if part.begin else 0
            rows: list[list] = []
            while at < part.end:
                size = documents.length(at)
                if not size:
                    raise ValueError(f"{part.path}: no document at {at}")
                if (row := self._row(documents.bytes_at(at, size))) is not None:
                    rows.append(row)
                if len(rows) == ROWS:
                    yield self._batch(rows)
                    rows = []
                at += size
            if part.end < part.size and at != documents.first_from(part.end):
                raise ValueError(f"{part.path}: ranges don't meet at {part.end}; read it with a larger rangeBytes")
            if rows:
                yield self._batch(rows)

    def _row(self, raw: bytes) -> list | None:
        held = {n: (k, a, b) for n, k, a, b in fields(raw) if n in self.fields}
        found = {n: _fitted(value(raw, *held[n]), held[n][0], self.fields[n]) if n in held else None for n in self.equal}
        if any(found[n] is None or found[n] != v for n, v in self.equal.items()):
            return None
        return [found[n] if n in found else _fitted(value(raw, *held[n]), held[n][0], k) if n in held else None for n, k in self.fields.items()]

    def _batch(self, rows: list[list]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), self.arrow.types)], schema=self.arrow)


_ARROW = {
    T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.ShortType: pa.int16(), T.ByteType: pa.int8(), T.DoubleType: pa.float64(), T.FloatType: pa.float32(),
    T.BooleanType: pa.bool_(), T.TimestampType: pa.timestamp("us", tz="UTC"),
}


class BsonSource(DataSource):
    """``spark.read.format("bson_dump").schema(...).load(path)``; options rangeBytes and firstField."""

    @classmethod
    def name(cls) -> str:
        return "bson_dump"

    def schema(self) -> str:
        raise ValueError("name the fields to read by a schema")

    def reader(self, schema: T.StructType) -> BsonReader:
        wrong = [f.name for f in schema.fields if type(f.dataType) not in (*_ARROW, T.StringType)]
        if wrong:
            raise ValueError(f"no such kinds of columns: {wrong}")
        return BsonReader(schema, dict(self.options))


def read_dump(spark: SparkSession, path: str, schema: str, **options: object) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # else Spark refuses a reader that takes filters
    spark.dataSource.register(BsonSource)
    return spark.read.format("bson_dump").schema(schema).options(**options).load(path)


def read_metrics(spark: SparkSession, folder: str, kind: str, jobs: list[int] | None = None) -> DataFrame:
    """(jobid, timestamp in seconds, the kind's columns) of a dump's metrics, repeated rows once; no rows where the
    dump has no such file. ``kind`` is one of METRICS."""
    file, names = METRICS[kind]
    texts = kind == "event"
    columns = ", ".join(f"{n} {'string' if texts else 'bigint'}" for n in names)
    system, path = _opened(f"{folder}/{file}")
    schema = f"jobid bigint, timeFrame timestamp, {columns}"
    found = read_dump(spark, f"{folder}/{file}", schema) if system.get_file_info(path).is_file else spark.createDataFrame([], schema)
    if jobs is not None:
        found = found.where(F.col("jobid") == jobs[0]) if len(jobs) == 1 else found.where(F.col("jobid").isin(*jobs))
    second = (F.unix_micros("timeFrame") / 1_000_000).alias("timestamp")
    return found.select("jobid", second, *(F.col(n).alias(f"event_{n}" if texts else n) for n in names)).distinct()
