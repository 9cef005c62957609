"""Ordered-signal operators: intervals, events, volumes and phases of a job's time series.

A signals table has a job_id, a sample number ``idx`` from 0 without gaps, and metric columns. All windows are
partitioned by job, so jobs spread over the cluster and one job's samples, a bounded number, meet in one task.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import ACCESS

JOB = "job_id"


def ordered(*extra: str) -> Window:
    return Window.partitionBy(JOB, *extra).orderBy("idx")


def level(value: Column, thresholds: list[float]) -> Column:
    """0 under the first threshold, 1 from it on, and so forth."""
    return reduce(lambda a, b: a + b, [F.when(value >= t, 1).otherwise(0) for t in thresholds]).cast("int")


def low_label(labelled: DataFrame, value: str, label: str) -> DataFrame:
    """(job_id, low) of the label whose values have the least mean; ties to the smaller label."""
    means = labelled.groupBy(JOB, label).agg(F.avg(value).alias("mean"))
    nth = F.row_number().over(Window.partitionBy(JOB).orderBy("mean", label))
    return means.withColumn("nth", nth).where("nth = 1").select(JOB, F.col(label).alias("low"))


def low_share(labelled: DataFrame, value: str, label: str) -> DataFrame:
    """(job_id, share): the low cluster's part of the whole sum, null for a sum of 0."""
    rows = labelled.join(low_label(labelled, value, label), JOB)
    return rows.groupBy(JOB).agg(F.try_divide(F.sum(F.when(F.col(label) == F.col("low"), F.col(value)).otherwise(0)).cast("double"), F.sum(value).cast("double")).alias("share"))


def relabelled(labelled: DataFrame, value: str, label: str) -> DataFrame:
    """The low cluster's label and 0 change places."""
    rows = labelled.join(low_label(labelled, value, label), JOB)
    own = F.col(label)
    return rows.withColumn(label, F.when(own == F.col("low"), 0).when(own == 0, F.col("low")).otherwise(own)).drop("low")


def differences(signals: DataFrame, value: str) -> DataFrame:
    """First differences; the first sample's is 0."""
    own = F.col(value)
    return signals.withColumn("difference", F.coalesce(own - F.lag(own).over(ordered()), F.lit(0)))


def cumulative(signals: DataFrame, value: str) -> DataFrame:
    return signals.withColumn("cumulated", F.sum(value).over(ordered().rowsBetween(Window.unboundedPreceding, 0)))


def breakpoints(labelled: DataFrame, label: str) -> DataFrame:
    """(job_id, idx) where a label begins that differs from the one before."""
    before = F.lag(label).over(ordered())
    return labelled.withColumn("before", before).where(F.col("before").isNotNull() & (F.col("before") != F.col(label))).select(JOB, "idx")


def intervals(labelled: DataFrame, label: str, merged: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Half-open runs [s, e) of samples above the low label 0; each level is a run of its own unless merged.

    Sums of the columns in ``carry`` come along.
    """
    rows = labelled.where(F.col(label) > 0).withColumn("level", F.lit(1) if merged else F.col(label))
    island = F.col("idx") - F.row_number().over(Window.partitionBy(JOB, "level").orderBy("idx"))
    sums = [F.sum(c).alias(c) for c in carry]
    return rows.withColumn("island", island).groupBy(JOB, "level", "island").agg(F.min("idx").alias("s"), (F.max("idx") + 1).alias("e"), *sums).drop("island")


def dirac(phases: DataFrame, shift: int = 1) -> DataFrame:
    """Events of phases as points: the start less the lengths before, each less ``shift``."""
    before = Window.partitionBy(JOB).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.sum(F.col("e") - F.col("s") - F.lit(shift)).over(before), F.lit(0))
    return phases.withColumn("event", (F.col("s") - gone).cast("long"))


def lengths(signals: DataFrame) -> DataFrame:
    return signals.groupBy(JOB).agg((F.max("idx") + 1).alias("n"))


def with_sentinels(phases: DataFrame, signals: DataFrame) -> DataFrame:
    """A leading phase up to the first one, and a closing point after the last, where samples lie outside."""
    ends = phases.groupBy(JOB).agg(F.min("s").alias("first"), F.max("e").alias("last")).join(lengths(signals), JOB)
    extra = [c for c in phases.columns if c not in (JOB, "s", "e", "level")]
    empty = [F.lit(0).cast(phases.schema[c].dataType).alias(c) for c in extra]
    leading = ends.where("first > 0").select(JOB, F.lit(0).alias("level"), F.lit(0).alias("s"), F.col("first").alias("e"), *empty)
    closing = ends.where("last < n").select(JOB, F.lit(-1).alias("level"), (F.col("n") - 1).alias("s"), F.col("n").alias("e"), *empty)
    columns = [JOB, "level", "s", "e", *extra]
    return phases.select(*columns).unionByName(leading.select(*columns)).unionByName(closing.select(*columns))


def volume_trapezoid(signals: DataFrame, value: str, dx: float = 1.0) -> DataFrame:
    """(job_id, volume) by the trapezoidal rule."""
    own = F.col(value).cast("double")
    area = (own + F.lead(own).over(ordered())) / 2 * F.lit(dx)
    return signals.withColumn("area", area).groupBy(JOB).agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("volume"))


def volume_simpson(signals: DataFrame, value: str, dx: float = 1.0) -> DataFrame:
    """(job_id, volume) by composite Simpson; with an even number of samples the last step is a trapezoid."""
    w = Window.partitionBy(JOB)
    own, n = F.col(value).cast("double"), F.count(F.lit(1)).over(w)
    rows = signals.withColumn("n", n)
    odd = F.col("n") - 1 + (F.col("n") % 2)  # samples under Simpson's rule
    at = F.col("idx")
    inner = F.when(at < odd, F.when((at == 0) | (at == odd - 1), 1.0).when(at % 2 == 1, 4.0).otherwise(2.0)).otherwise(0.0) * own * F.lit(dx / 3)
    inner = F.when(odd > 1, inner).otherwise(0.0)
    rest = F.when((F.col("n") % 2 == 0) & (at >= F.col("n") - 2), own * F.lit(dx / 2)).otherwise(0.0)
    return rows.groupBy(JOB).agg(F.sum(inner + rest).alias("volume"))


def dominant(totals: dict[str, Column]) -> Column:
    """The access pattern with the largest total; ties and none go to the first of Uncl, Rand, Seq, Str."""
    most = F.greatest(*[totals[p] for p in ACCESS])
    out = F.lit(ACCESS[-1])
    for p in reversed(ACCESS):
        out = F.when(totals[p] >= most, F.lit(p)).otherwise(out)
    return out


def reconstruct(labelled: DataFrame, value: str, label: str) -> DataFrame:
    """Each sample with the mean of its constant-label segment, the least-squares step function."""
    step = F.when(F.col(label) != F.lag(label).over(ordered()), 1).otherwise(0)
    rows = labelled.withColumn("step", step).withColumn("segment", F.sum("step").over(ordered().rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("fitted", F.avg(value).over(Window.partitionBy(JOB, "segment"))).drop("step")


def phase_of_sample(signals: DataFrame, norm: str) -> DataFrame:
    """Samples of the leading phase and the phases of label ``norm``, tagged with a phase number; others are left out.

    A phase is a run above the low label; the samples before the first run are phase 0 where there are any.
    """
    run = F.col(norm) > 0
    started = F.max(F.when(run, 1).otherwise(0)).over(ordered().rowsBetween(Window.unboundedPreceding, 0))
    begins = F.when(run & ~F.coalesce(F.lag(run).over(ordered()), F.lit(False)), 1).otherwise(0)
    rows = signals.withColumn("_started", started).withColumn("_begins", begins)
    number = F.sum("_begins").over(ordered().rowsBetween(Window.unboundedPreceding, 0))
    any_run = F.max(F.when(run, 1).otherwise(0)).over(Window.partitionBy(JOB))
    rows = rows.withColumn("phase", number).withColumn("_any", any_run)
    return rows.where((F.col("_any") == 1) & ((F.col("_started") == 0) | run)).drop("_started", "_begins", "_any")


def representation(signals: DataFrame, read_label: str, write_label: str, norm_label: str) -> DataFrame:
    """Jobs as events: for each phase of the joint signal what its read and write sub-phases moved.

    ``norm_label`` is merged: every sample above the low label belongs to a run. Needs operation and access columns.
    Jobs without a run give two empty events, at 0 and at their last sample.
    """
    tagged = phase_of_sample(signals, norm_label)
    sums = {}
    for side, label in (("Read", read_label), ("Write", write_label)):
        for c in (f"bytes{'Read' if side == 'Read' else 'Written'}", f"operation{side}", *(f"access{p}{side}" for p in ACCESS)):
            sums[c] = F.sum(F.when(F.col(label) > 0, F.col(c)).otherwise(0))
        sums[f"extent{side}"] = F.sum(F.when(F.col(label) > 0, 1).otherwise(0))
    phases = tagged.groupBy(JOB, "phase").agg(F.min("idx").alias("s"), (F.max("idx") + 1).alias("e"), *[v.alias(k) for k, v in sums.items()])
    bw = lambda volume, extent: F.when(F.col(extent) > 0, F.col(volume) / F.col(extent)).otherwise(0.0)
    phases = phases.select(
        JOB, "s", "e",
        F.col("bytesRead").cast("double").alias("read_volume"), bw("bytesRead", "extentRead").alias("read_bw"),
        F.col("bytesWritten").cast("double").alias("write_volume"), bw("bytesWritten", "extentWrite").alias("write_bw"),
        dominant({p: F.col(f"access{p}Read") for p in ACCESS}).alias("read_pattern"), dominant({p: F.col(f"access{p}Write") for p in ACCESS}).alias("write_pattern"),
        F.col("operationRead").cast("long").alias("read_operations"), F.col("operationWrite").cast("long").alias("write_operations"),
    )
    zero = [
        *[F.lit(0.0).alias(c) for c in ("read_volume", "read_bw", "write_volume", "write_bw")],
        *[F.lit("Uncl").alias(c) for c in ("read_pattern", "write_pattern")],
        *[F.lit(0).cast("long").alias(c) for c in ("read_operations", "write_operations")],
    ]
    n = lengths(signals)
    closing = phases.groupBy(JOB).agg(F.max("e").alias("last")).join(n, JOB).where("last < n").select(JOB, (F.col("n") - 1).alias("s"), F.col("n").alias("e"), *zero)
    events = dirac(phases.unionByName(closing))
    idle = n.join(phases.select(JOB).distinct(), JOB, "left_anti")
    points = idle.select(JOB, "n", F.explode(F.array(F.lit(0), F.col("n") - 1)).alias("s")).select(JOB, F.col("s").cast("int").alias("s"), F.col("n").alias("e"), *zero)
    points = points.withColumn("event", F.col("s").cast("long"))
    return events.unionByName(points).drop("e")


def one_sided(signals: DataFrame, value: str, label: str, merged: bool = False) -> DataFrame:
    """(job_id, event, volume, bw) of one signal by itself: its phases as points, with a leading and a closing one.

    Each level of the label is a phase of its own unless ``merged``. Jobs without a phase have two empty events, at 0 and
    at their last sample (one, if that is the same).
    """
    runs = intervals(signals, label, merged, (value,))
    rows = dirac(runs).select(JOB, "event", F.col(value).cast("double").alias("volume"), (F.col(value) / (F.col("e") - F.col("s"))).alias("bw"))
    whole = runs.groupBy(JOB).agg(F.min("s").alias("first"), F.max("e").alias("last"), F.sum(F.col("e") - F.col("s") - 1).alias("gone"))
    ends = lengths(signals).join(whole, JOB, "left")
    leading, closing = F.when(F.coalesce(F.col("first"), F.lit(1)) > 0, 0), F.when(F.coalesce(F.col("last") < F.col("n"), F.lit(True)), F.col("n") - 1 - F.coalesce("gone", F.lit(0)))
    empty = F.array_compact(F.array_distinct(F.array(leading.cast("long"), closing.cast("long"))))
    points = ends.select(JOB, F.explode(empty).alias("event"), F.lit(0.0).alias("volume"), F.lit(0.0).alias("bw"))
    return rows.unionByName(points)


def separate_representation(signals: DataFrame, read_label: str, write_label: str, merged: bool = False) -> DataFrame:
    """(job_id, event, read_volume, read_bw, write_volume, write_bw): both signals decomposed by themselves, their events
    side by side, 0 where one has none."""
    from .joins import align_events

    named = lambda rows, side: rows.withColumnsRenamed({"volume": f"{side}_volume", "bw": f"{side}_bw"})
    read, write = one_sided(signals, "bytesRead", read_label, merged), one_sided(signals, "bytesWritten", write_label, merged)
    return align_events(named(read, "read"), named(write, "write"), [JOB, "event"])


def sampled_more_than(signals: DataFrame, least: int = 1) -> DataFrame:
    """The samples of the jobs that have more than ``least`` of them."""
    many = signals.groupBy(JOB).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).select(JOB)
    return signals.join(many, JOB, "left_semi")


def sampling_step(signals: DataFrame, time: str) -> DataFrame:
    """(job_id, step): the time between a job's first two samples, null with fewer."""
    at = lambda i: F.max(F.when(F.col("idx") == i, F.col(time)))
    return signals.where("idx < 2").groupBy(JOB).agg((at(1) - at(0)).alias("step"))


def normalised_time(signals: DataFrame, time: str, step: float = 5.0) -> DataFrame:
    """Steps since the job's first sample."""
    first = F.first(time).over(ordered())
    return signals.withColumn("steps", (F.col(time) - first) / F.lit(step))


def row_sum(rows: DataFrame, pattern: str, name: str) -> DataFrame:
    """The sum of the columns whose names match, null as 0, as one more column."""
    matching = [F.coalesce(F.col(c), F.lit(0)) for c in rows.columns if re.search(pattern, c)]
    return rows.withColumn(name, reduce(lambda a, b: a + b, matching, F.lit(0)))


def phase_features(events: DataFrame, step_s: float = 5.0, nodes: int = 1) -> DataFrame:
    """One row for each event: sizes of operations, model names of patterns, bandwidth over the sampling step."""
    size = lambda volume, ops: F.coalesce(F.try_divide(F.col(volume), F.col(ops).cast("double")), F.lit(0.0))
    return events.select(
        JOB, "event", F.lit(nodes).alias("nodes"), "read_volume", "write_volume",
        F.lower("read_pattern").alias("read_io_pattern"), F.lower("write_pattern").alias("write_io_pattern"),
        size("read_volume", "read_operations").alias("read_io_size"), size("write_volume", "write_operations").alias("write_io_size"),
        ((F.col("read_bw") + F.col("write_bw")) / F.lit(step_s)).alias("ioi_bw"),
    )
