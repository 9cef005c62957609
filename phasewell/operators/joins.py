"""Joins of series, intervals and lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_metrics(frames: list[DataFrame], on: list[str]) -> DataFrame:
    """Full outer join of metric tables on their keys."""
    return reduce(lambda a, b: a.join(b, on, "full_outer"), frames)


def synthesise(jobs: DataFrame, time: str, metrics: list[str], group: list[str] | None = None) -> DataFrame:
    """All jobs' metrics added up by time: a union and one aggregation instead of a join for each job."""
    return jobs.groupBy(*(group or []), time).agg(*[F.sum(F.coalesce(F.col(m), F.lit(0))).alias(m) for m in metrics])


def on_grid(jobs: DataFrame, time: str, metrics: list[str], step: int, group: list[str], position: str | None = None) -> DataFrame:
    """Metrics on a regular grid from the first to the last time of each group; off-grid samples are dropped, gaps are 0.

    ``position`` names a column for the number of the grid's point, if it is wanted.
    """
    span = jobs.groupBy(*group).agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
    grid = span.select(*group, F.posexplode(F.sequence("lo", "hi", F.lit(step).cast("long"))).alias(position or "_position", time))
    sums = synthesise(jobs, time, metrics, group)
    return grid.join(sums, [*group, time], "left").select(*group, time, *[c for c in [position] if c], *[F.coalesce(m, F.lit(0)).alias(m) for m in metrics])


def natural(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, [c for c in left.columns if c in right.columns])


def first_of(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in an order."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def align_events(read: DataFrame, write: DataFrame, keys: list[str]) -> DataFrame:
    """Read and write events in one table: all keys of either side, volumes 0 where a side has none."""
    joined = read.join(write, keys, "full_outer")
    return joined.select(*keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in joined.columns if c not in keys])


def renamed(rows: DataFrame, names: dict[str, str], skip: tuple[str, ...] = ()) -> DataFrame:
    """Columns under their new names; those whose new name is in ``skip`` go."""
    kept = [(c, names.get(c, c)) for c in rows.columns if names.get(c, c) not in skip]
    return rows.select(*[F.col(f"`{old}`").alias(new) for old, new in kept])


def contained(start: Column, end: Column, low: Column, high: Column) -> Column:
    """Does [start, end] lie within [low, high], ends included? Intervals that end before they start don't."""
    return start.between(low, high) & end.between(start, high)


def overlaps(outer: DataFrame, inner: DataFrame, key: str, width: int) -> DataFrame:
    """Each outer interval [s, e) with each inner one that overlaps it, clamped to it.

    Intervals are dealt to buckets of ``width``, so that an equi-join finds the pairs; a pair counts in the bucket of
    its overlap's start.
    """
    def dealt(frame: DataFrame, prefix: str) -> DataFrame:
        renamed = frame.select(*[F.col(c).alias(c if c == key else f"{prefix}{c}") for c in frame.columns])
        first, last = F.floor(F.col(f"{prefix}s") / F.lit(width)), F.floor((F.col(f"{prefix}e") - 1) / F.lit(width))
        return renamed.withColumn("bucket", F.explode(F.sequence(first, last)))

    a, b = dealt(outer, "o_"), dealt(inner, "i_")
    pairs = a.join(b, [key, "bucket"]).where("i_s < o_e and i_e > o_s")
    pairs = pairs.withColumn("s", F.greatest("o_s", "i_s")).withColumn("e", F.least("o_e", "i_e"))
    return pairs.where(F.floor(F.col("s") / F.lit(width)) == F.col("bucket")).drop("bucket")


def running_total(spans: DataFrame, keys: list[str], start: str, end: str, value: Column) -> DataFrame:
    """At each time when an interval [start, end) begins or ends, the sum of the values of those that hold it.

    Deltas and a running sum in place of a range join. Without keys the order is global: give one where time is long.
    """
    up = spans.select(*keys, F.col(start).alias("at"), value.alias("delta"))
    down = spans.select(*keys, F.col(end).alias("at"), (-value).alias("delta"))
    deltas = up.unionByName(down).groupBy(*keys, "at").agg(F.sum("delta").alias("delta"))
    order = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return deltas.select(*keys, "at", F.sum("delta").over(order).alias("total"))


def last_positive(points: DataFrame, spans: DataFrame, key: str, value: str, width: int) -> DataFrame:
    """For each point the value of the latest interval that holds it with a positive value; equal intervals count with
    their largest value, points in none are 0."""
    best = spans.where(F.col(value) > 0).groupBy(key, "s", "e").agg(F.max(value).alias(value))
    at = points.withColumn("bucket", F.floor(F.col("at") / F.lit(width)))
    dealt = best.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("s") / F.lit(width)), F.floor(F.col("e") / F.lit(width)))))
    held = at.join(dealt, [key, "bucket"]).where("at >= s and at < e")
    latest = held.groupBy(key, "at").agg(F.max(F.struct("s", "e", value)).alias("v")).select(key, "at", F.col(f"v.{value}").alias(value))
    return points.join(latest, [key, "at"], "left").select(key, "at", F.coalesce(value, F.lit(0)).alias(value))


def with_missing(jobs: DataFrame, wanted: DataFrame, key: str, default: dict[str, Column]) -> DataFrame:
    """``jobs`` and a default row for each wanted key that it lacks."""
    missing = wanted.select(key).distinct().join(jobs.select(key), key, "left_anti")
    return jobs.select(key, *default).unionByName(missing.select(key, *[v.alias(k) for k, v in default.items()]))


def page(rows: DataFrame, where: Column, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A filtered page and the counts before and after filtering."""
    total = rows.agg(F.count(F.lit(1)).alias("total"), F.sum(where.cast("long")).alias("filtered"))
    return rows.where(where).orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row


def minima_maxima(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, least, most) for each metric."""
    ends = rows.agg(*[f(m).alias(f"{n}_{m}") for m in metrics for n, f in (("least", F.min), ("most", F.max))])
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"least_{m}").cast("double").alias("least"), F.col(f"most_{m}").cast("double").alias("most")) for m in metrics])
    return ends.select(F.inline(each))
