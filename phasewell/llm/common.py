"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch; texts can be long, so Spark's default of 10,000 is too many.
ARROW_ROWS = 1000
#: Bytes of text that a Python worker holds as one slice.
SLICE_BYTES = 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the session's Arrow batches, and set its checkpoint folder to the one that the cluster names.

    Queries run after an operator has returned, so the bound on batches stays for the session. Without a named folder a
    local session gets a temporary one; on a cluster that is an error, as executors couldn't read the driver's disk.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="phasewell-checkpoint-"))
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder and cut its lineage there."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of ``batch`` whose texts together take about ``most`` bytes at the most."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    begin, held = 0, 0
    for at, size in enumerate(sizes):
        if held and held + size > most:
            yield batch.slice(begin, at - begin)
            begin, held = at, 0
        held += size
    if begin < batch.num_rows:
        yield batch.slice(begin)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; null ids are in fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)), F.lit(0)).cast("int")


def labelled_sample(labels: DataFrame, label: str, train, most: int) -> DataFrame:
    """At most ``most`` labelled ids (doc_id, label 0/1) of the rows where ``train`` holds.

    A hash of the id selects them, so the same ids are taken however the table is partitioned. An id labelled more
    than once counts with its largest label; null ids and null labels take no part.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & train(F.col("doc_id")))
    picked = rows.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    total = picked.count()
    order = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 40))
    if total > most:  # a little more than wanted, of which the first are taken
        picked = picked.where(order < int(min(1.0, 1.2 * most / total + 1e-3) * (1 << 40)))
    return picked.orderBy(order, "doc_id").limit(most)


def sampled_texts(documents: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, label, text) of the sampled ids, kept in the shared folder: one row each, of the text with the least
    hash where rows repeat an id with different ones."""
    held = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    least = held.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"))
    return cut(least.select("doc_id", "label", "least.text"))


def in_parts(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` sorted over ranges and kept in the shared folder, with each row's range (_part) and its place there (_at).

    Rows that are equal in ``order`` may lie in more ranges than one: a last key tells apart any two rows, so that a hot
    key is split too.
    """
    named = rows.withColumn("_row", F.monotonically_increasing_id())
    ranges = named.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order, F.col("_row"))
    placed = ranges.sortWithinPartitions(*order, "_row").drop("_row")
    return cut(placed.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at")))


def in_order(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with each row's place, from 0, in the whole order. Only the ranges' sizes reach the driver."""
    parts = in_parts(rows, order)
    sizes = dict(parts.groupBy("_part").count().toPandas().itertuples(index=False))
    starts, total = [], 0
    for part in range(max(sizes, default=0) + 1):
        starts.append(total)
        total += int(sizes.get(part, 0))
    start = F.element_at(F.array(*map(F.lit, starts)).cast("array<long>"), F.col("_part") + 1)
    return parts.withColumn(name, start + F.col("_at")).drop("_part", "_at")
