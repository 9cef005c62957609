"""Time series and metadata of a service's jobs, fetched page by page inside tasks.

``service_series`` is a data source whose partitions are ranges of time: each task fetches its own range, again a few
times if that fails. A page is a list of rows, the first of them labels. Bounds on the time column are pushed down: they
drop the ranges outside them and narrow the others. ``read_series`` lets Spark push filters down to Python sources in its
session.

Defined results: a range is [begin, end), rows outside it are left out, so that none comes twice; labels that a page
doesn't have are null; a page without rows is empty; a range that still fails is an error, or no rows with onError=empty.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Times that a page is asked for, seconds to wait before the first repeat (doubled each time), and for an answer.
TRIES, WAIT, TIMEOUT = 3, 0.2, 30


def fetch(url: str, token: str = "", tries: int = TRIES, wait: float = WAIT):
    """A page's JSON; failures of the connection and of the server are tried again, others are errors at once."""
    for at in range(tries):
        try:
            asked = urllib.request.Request(url, headers={"Authorization": token} if token else {})
            with urllib.request.urlopen(asked, timeout=TIMEOUT) as answer:
                return json.load(answer)
        except (OSError, ValueError) as error:
            final = isinstance(error, urllib.error.HTTPError) and error.code < 500
            if final or at == tries - 1:
                raise
            time.sleep(wait * 2**at)


@dataclass
class TimeRange(InputPartition):
    begin: int
    end: int


class SeriesReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.names = [f.name for f in schema.fields]
        self.options = options
        self.time = options.get("timecolumn", "timestamp")
        self.begin, self.end = int(options["start"]), int(options["end"])

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if getattr(f, "attribute", None) == (self.time,) and type(getattr(f, "value", None)) is int:
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.begin = max(self.begin, f.value + isinstance(f, GreaterThan))
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.end = min(self.end, f.value + isinstance(f, LessThanOrEqual))
            yield f  # Spark checks the rows as well

    def partitions(self) -> list[TimeRange]:
        step = int(self.options.get("rangeseconds", 3600))
        return [TimeRange(b, min(b + step, self.end)) for b in range(self.begin, self.end, step)] or [TimeRange(0, 0)]

    def read(self, part: TimeRange) -> Iterator[pa.RecordBatch]:
        if part.begin >= part.end:
            return
        o = self.options
        asked = {"type": o["type"], "objectId": o["objectid"], "maxPoint": "", "exportUser": "True", "start": part.begin, "end": part.end}
        try:
            page = fetch(f"{o['path']}details?{urllib.parse.urlencode(asked)}", o.get("token", ""), int(o.get("tries", TRIES)))
        except (OSError, ValueError):
            if o.get("onerror", "fail") == "empty":
                return
            raise
        if not page:
            return
        labels, *rows = page
        if not all(isinstance(name, str) for name in labels) or any(len(r) != len(labels) for r in rows):
            raise ValueError(f"no labelled rows of one length in {part}")
        at = labels.index(self.time)
        rows = [r for r in rows if part.begin <= r[at] < part.end]
        where = [labels.index(n) if n in labels else None for n in self.names]
        columns = [pa.array([None if i is None else r[i] for r in rows], pa.int64()) for i in where]
        yield pa.record_batch(columns, self.names)


class SeriesSource(DataSource):
    """``spark.read.format("service_series")``; path is the service's address, options objectId, type, start, end,
    rangeSeconds, token, tries, timeColumn and onError. All columns are whole numbers."""

    @classmethod
    def name(cls) -> str:
        return "service_series"

    def schema(self) -> str:
        raise ValueError("name the labels to read by a schema")

    def reader(self, schema: T.StructType) -> SeriesReader:
        if any(not isinstance(f.dataType, T.LongType) for f in schema.fields):
            raise ValueError("all columns must be bigint")
        return SeriesReader(schema, dict(self.options))


def read_series(spark: SparkSession, address: str, object_id: str, kind: str, labels: list[str], start: int, end: int, **options: object) -> DataFrame:
    """One job's series between two times, the labels as columns beside ``timestamp``."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # else Spark refuses a reader that takes filters
    spark.dataSource.register(SeriesSource)
    schema = ", ".join(f"`{n}` bigint" for n in dict.fromkeys(["timestamp", *labels]))
    return spark.read.format("service_series").schema(schema).options(objectId=object_id, type=kind, start=start, end=end, **options).load(address)


def read_metadata(ids: DataFrame, address: str, keys: list[str] | None = None, token: str = "") -> DataFrame:
    """(object_id, metadata) for each distinct object_id of ``ids``: a map of texts, null where it can't be fetched.

    Values that aren't texts are JSON. ``keys`` keeps some; keys that aren't there are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.string(), pa.string())
        for batch in batches:
            found = []
            for one in batch.column("object_id").to_pylist():
                try:
                    held = fetch(f"{address}job/objectid?{urllib.parse.urlencode({'objectId': one})}", token)
                    found.append([(k, v if isinstance(v, str) else json.dumps(v)) for k, v in held.items() if keys is None or k in keys])
                except (OSError, ValueError):
                    found.append(None)
            yield pa.record_batch([batch.column("object_id"), pa.array(found, kind)], ["object_id", "metadata"])

    asked = ids.where("object_id is not null").select(F.col("object_id").cast("string").alias("object_id")).distinct()
    return asked.mapInArrow(run, "object_id string, metadata map<string,string>")


def of_key(key: str) -> Column:
    """One value of ``metadata``, null where it isn't there."""
    return F.try_element_at("metadata", F.lit(key))
