"""Readers and writers of job series, workflow folders, cluster descriptions and results."""

from __future__ import annotations

import os
import warnings
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas


#: Bytes in which a file's header must end, and different headers that are read at once.
HEADER, HEADERS = 1 << 16, 1_000


def _headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The job files below a folder by their header; tasks read the headers, only the beginning of each file."""
    from .bson import _opened

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for file in batch.column("path").to_pylist():
                system, name = _opened(file)
                with system.open_input_stream(name) as stream:
                    raw = bytearray()
                    while b"\n" not in raw and len(raw) < HEADER and (more := stream.read(4096)):
                        raw += more
                found.append(bytes(raw).split(b"\n")[0].decode("utf-8-sig").rstrip("\r"))
            yield pa.record_batch([batch.column("path"), pa.array(found, pa.string())], ["path", "header"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(path).where("length > 0").select("path")
    out: dict[str, list[str]] = {}
    for row in files.mapInArrow(run, "path string, header string").collect():  # paths, which Spark's readers list as well
        out.setdefault(row["header"], []).append(row["path"])
    if len(out) > HEADERS:
        raise ValueError(f"{len(out)} different headers")
    return out


def read_job_csv(spark: SparkSession, path: str, columns: tuple[str, ...] = ("bytesRead", "bytesWritten")) -> DataFrame:
    """Job series from CSV files below a folder; the first row of each job and timestamp counts.

    Columns are found by each file's own header, as files differ in their order; one that a file lacks is null. A
    header without a name is the row's number. The job's id and data set come from the file's path. Files with the same
    header are one scan, which splits long files and parses only the columns asked for.
    """
    wanted = ("timestamp", *columns)
    parts = []
    for header, files in sorted(_headers(spark, path).items()):
        names = [n or ("_idx" if i == 0 else f"_{i}") for i, n in enumerate(header.split(","))]
        named = [n if names.index(n) == i else f"_{i}" for i, n in enumerate(names)]
        rows = spark.read.csv(sorted(files), schema=", ".join(f"`{n}` string" for n in named), header=True, enforceSchema=True)
        cells = [(F.col(f"`{c}`") if c in named else F.lit(None)).cast("string").alias(c) for c in wanted]
        parts.append(rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"), *cells))
    if not parts:
        parts = [spark.createDataFrame([], "file string, _block long, _line long, " + ", ".join(f"`{c}` string" for c in wanted))]
    whole = reduce(DataFrame.unionByName, parts)
    typed = whole.select(*[v.alias(k) for k, v in job_of(F.col("file")).items()], "_block", "_line", F.col("timestamp").try_cast("double").alias("timestamp"), *[F.col(c).try_cast("bigint").alias(c) for c in columns])
    nth = F.row_number().over(Window.partitionBy("dataset", "job_id", "timestamp").orderBy("_block", "_line"))
    return typed.withColumn("_nth", nth).where("_nth = 1").drop("_nth", "_block", "_line").select("dataset", "job_id", "timestamp", *columns)


def job_of(file: Column) -> dict[str, Column]:
    return {"job_id": F.regexp_extract(file, r"job_(\d+)\.csv$", 1), "dataset": F.regexp_extract(file, r"([^/]+)/[^/]+$", 1)}


def list_jobs(spark: SparkSession, path: str) -> DataFrame:
    """(job_id, dataset, path) of the job files below a folder, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "job_*.csv").load(path).select("path")
    return files.select(*[v.alias(k) for k, v in job_of(F.col("path")).items()], "path")


def read_positional(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One metric file of every job below a workflow's folder: arrays of arrays whose columns the file's name gives.

    (workflow_id, job_id, idx, timestamp, metrics); folders that aren't numbers are left out, and the first sample of
    each timestamp counts.
    """
    columns = schemas.POSITIONAL[name]
    files = spark.read.text(folder, wholetext=True, pathGlobFilter=f"{name}.json", recursiveFileLookup=True).withColumn("file", F.input_file_name())
    parts = F.regexp_extract("file", r"([^/]+)/([^/]+)/[^/]+$", 1).alias("workflow_id"), F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("job_id")
    rows = files.select(*parts, F.posexplode(F.from_json("value", "array<array<bigint>>")).alias("idx", "row")).where(F.col("job_id").rlike("^[0-9]+$"))
    named = rows.select("workflow_id", "job_id", "idx", *[F.get("row", F.lit(i)).alias(c) for i, c in enumerate(columns)])
    nth = F.row_number().over(Window.partitionBy("workflow_id", "job_id", "timestamp").orderBy("idx"))
    return named.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def read_workflow(spark: SparkSession, folder: str, names: tuple[str, ...] = ("volume", "operationsCount", "accessPatternRead", "accessPatternWrite")) -> DataFrame:
    """Signals of all jobs of a workflow: metric files joined on the timestamp, samples numbered again, gaps 0."""
    from ..operators.joins import merge_metrics

    keys = ["workflow_id", "job_id", "timestamp"]
    merged = merge_metrics([read_positional(spark, folder, n).drop("idx") for n in names], keys)
    metrics = [c for c in merged.columns if c not in keys]
    idx = (F.row_number().over(Window.partitionBy("workflow_id", "job_id").orderBy("timestamp")) - 1).alias("idx")
    return merged.select("workflow_id", "job_id", "timestamp", idx, *[F.coalesce(m, F.lit(0)).alias(m) for m in metrics])


def arrays_from_objects(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """(file, value): files of JSON objects rewritten as JSON arrays in the order of ``fields``."""
    schema = "array<struct<" + ", ".join(f"{f}: bigint" for f in fields) + ">>"
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return rows.select(F.input_file_name().alias("file"), F.to_json(F.transform(F.from_json("value", schema), lambda r: F.array(*[r[f] for f in fields]))).alias("value"))


def read_cluster(spark: SparkSession, text_or_path: str) -> DataFrame:
    """TIERS rows of a cluster description in YAML, a path or the text itself; bandwidths in bytes a second."""
    text = text_or_path
    if "\n" not in text and os.path.exists(text):
        with open(text, encoding="utf-8") as file:
            text = file.read()
    config = yaml.safe_load(text)
    cores = config.get("defaults", {}).get("cores_per_node", 1)
    tiers = [(t, "persistent") for t in config.get("tiers", [])]
    if config.get("ephemeral_tier"):
        tiers.append((config["ephemeral_tier"], "ephemeral"))
    rows = []
    for i, (tier, kind) in enumerate(tiers):
        bw = tier.get("max_bandwidth", {})
        if isinstance(bw, dict):
            values = [float(bw.get(side, {}).get(p, 0)) * cores * 1e6 for side in ("read", "write") for p in ("seq", "rand")]
        else:
            values = [float(bw)] * 4
        rows.append((tier["name"], i, float(tier.get("capacity", 0)), kind, tier.get("persistent_tier"), *values))
    return spark.createDataFrame(rows, schemas.TIERS)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, type, delay) of an edge list: JSON arrays of source, target and attributes."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<array<string>>")).alias("e"))
    data = F.from_json(F.get("e", F.lit(2)), "type string, delay bigint")
    return rows.select(F.get("e", F.lit(0)).alias("src"), F.get("e", F.lit(1)).alias("dst"), data["type"].alias("type"), data["delay"].alias("delay"))


def write_features(features: DataFrame, path: str) -> None:
    """Append phase features to a CSV data set with headers."""
    features.write.mode("append").option("header", True).csv(path)


def representation_json(events: DataFrame) -> DataFrame:
    """(job_id, value): each job's events as one JSON object of parallel arrays."""
    columns = ["event", "read_volume", "read_bw", "write_volume", "write_bw", "read_pattern", "write_pattern", "read_operations", "write_operations"]
    names = ["events", "read_volumes", "read_bw", "write_volumes", "write_bw", "read_pattern", "write_pattern", "read_operations", "write_operations"]
    rows = events.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("rows"))
    arrays = [F.col(f"rows.{c}").alias(n) for c, n in zip(columns, names, strict=True)]
    return rows.select("job_id", F.to_json(F.struct(F.lit(1).alias("node_count"), *arrays)).alias("value"))


def node_link_json(edges: DataFrame, key: str) -> DataFrame:
    """(key, value): each workflow's graph as one JSON object of nodes and links."""
    nodes = F.transform(F.array_sort(F.array_distinct(F.concat(F.collect_set("src"), F.collect_set("dst")))), lambda n: F.struct(n.alias("id")))
    links = F.array_sort(F.collect_list(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "type", "delay")))
    return edges.groupBy(key).agg(F.to_json(F.struct(F.lit(True).alias("directed"), nodes.alias("nodes"), links.alias("links"))).alias("value"))


def random_phases(spark: SparkSession, n: int, volume: float, seed: int = 1) -> DataFrame:
    """Random phases of a total volume; sizes of operations and patterns from the model's categories."""
    from ..operators.model import CATEGORIES

    sizes = (4e3, 16e3, 128e3, 512e3, 2e6, 8e6)
    pick = lambda values, s: F.element_at(F.array(*[F.lit(v) for v in values]), (F.rand(s) * len(values)).cast("int") + 1)
    return spark.range(n).select(
        F.col("id").alias("phase_id"), F.lit(1).alias("nodes"), F.round(F.rand(seed) * volume).alias("read_volume"),
        pick(CATEGORIES, seed + 1).alias("read_io_pattern"), pick(CATEGORIES, seed + 2).alias("write_io_pattern"), pick(sizes, seed + 3).alias("read_io_size"), pick(sizes, seed + 4).alias("write_io_size"),
    ).withColumn("write_volume", F.lit(volume) - F.col("read_volume"))


def sample_jobs(jobs: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """n jobs drawn with replacement, none from none: draws of row numbers joined back to the numbered rows."""
    spark, total = jobs.sparkSession, jobs.count()
    if not total:
        return jobs
    draws = spark.range(n).select(F.floor(F.rand(seed) * total).alias("_nth"))
    part = jobs.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() % (1 << 33))
    before, offsets = 0, F.lit(0)
    for row in sorted(part.groupBy("_part").count().collect(), key=lambda r: r["_part"]):  # one row for each partition
        offsets = F.when(F.col("_part") == row["_part"], F.lit(before)).otherwise(offsets)
        before += row["count"]
    return draws.join(part.withColumn("_nth", F.col("_at") + offsets), "_nth").select(*jobs.columns)


def available(df: DataFrame, labels: list[str]) -> DataFrame:
    """The columns of these that there are, with a warning for others; without any an error."""
    found = [c for c in labels if c in df.columns]
    missing = [c for c in labels if c not in df.columns]
    if not found:
        raise ValueError(f"none of these columns: {missing}")
    if missing:
        warnings.warn(f"no columns {missing}", stacklevel=2)
    return df.select(*found)


def experiment_rows(spark: SparkSession, rows: list[tuple], ios: int) -> DataFrame:
    """A table of placement trials: (parameters, tiers by phase, buffer flags by phase, runtime, buffer's size)."""
    names = [*[f"tier_{i}" for i in range(ios)], *[f"use_bb_{i}" for i in range(ios)]]
    flat = [(str(list(p)), *map(int, t), *map(int, b), float(run), float(size)) for p, t, b, run, size in rows]
    schema = ", ".join(["parameters string", *[f"{n} int" for n in names], "runtime double", "buffer_size double"])
    return spark.createDataFrame(flat, schema)
