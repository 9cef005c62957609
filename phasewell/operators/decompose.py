"""Adaptive decomposition of a job's signals into I/O phases.

Exact one-dimensional k-means by dynamic programming over the distinct values replaces a seeded search: for k = 2, 3, ...
until the low cluster holds at most a share of the sum. Equal costs go to the larger lower clusters. The best start of
the last cluster never moves down as values are added, so each k takes m log m costs by divide and conquer, and only the
histogram of a signal's values, counted by Spark before it moves, reaches the task that finds the clusters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import ACCESS, REPRESENTATION
from ..session import cut, spread
from . import changes, signals as sig
from .changes import change_points  # noqa: F401  (part of this module's interface)

#: Costs closer than this, relative to the spread, are equal.
_EPS = 1e-12
#: Costs that are looked at together at the end of a search.
LEAVES = 1 << 14


def _last_minima(least: int, m: int, costs: Callable[[np.ndarray, np.ndarray], np.ndarray], near: float) -> tuple[np.ndarray, np.ndarray]:
    """For each end ``least`` to m, the last start from ``least`` - 1 to end - 1 whose cost is the minimum, and that cost.

    All middles of one depth are searched at once, between the starts found for the ends around them, until what is left
    of all ranges is few costs, which are looked at together.
    """
    value, at = np.full(m + 1, np.inf), np.zeros(m + 1, np.int32)
    low, high = np.array([least]), np.array([m])
    begin, end = np.array([least - 1]), np.array([m - 1])
    while len(low):
        every = ((high - low + 1) * (end - begin + 1)).sum() <= LEAVES + 4 * m  # few enough costs to look at all of them
        if every:
            count = high - low + 1
            ends = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - low, count)
            first, last = np.repeat(begin, count), np.minimum(np.repeat(end, count), ends - 1)
        else:
            ends = (low + high) // 2
            first, last = begin, np.minimum(end, ends - 1)
        size = last - first + 1
        bound = np.cumsum(size) - size
        starts = np.arange(size.sum()) - np.repeat(bound - first, size)
        found = costs(starts, np.repeat(ends, size))
        best = np.minimum.reduceat(found, bound)
        chosen = np.maximum.reduceat(np.where(found <= np.repeat(best + near, size), starts, -1), bound)
        at[ends], value[ends] = chosen, found[bound + chosen - first]
        if every:
            break
        down, up = low < ends, ends < high
        low, high, begin, end = (
            np.concatenate([low[down], ends[up] + 1]), np.concatenate([ends[down] - 1, high[up]]),
            np.concatenate([begin[down], chosen[up]]), np.concatenate([chosen[down], end[up]]),
        )
    return value, at


def _last_minima_of(table: np.ndarray, least: int, best: np.ndarray, near: float) -> tuple[np.ndarray, np.ndarray]:
    """``_last_minima`` of ``best`` at the start plus a table by end and start, the costs of few values."""
    m = len(table)
    value, at = np.full(m + 1, np.inf), np.zeros(m + 1, np.int32)
    found = table[least - 1 :, least - 1 :] + best[least - 1 : m]
    close = found <= found.min(1, keepdims=True) + near
    chosen = close.shape[1] - 1 - close[:, ::-1].argmax(1)
    at[least:], value[least:] = chosen + least - 1, found[np.arange(len(found)), chosen]
    return value, at


def cluster_starts(distinct: np.ndarray, count: np.ndarray, threshold: float = 0.01) -> np.ndarray:
    """The least values of all clusters but the lowest, for the first k whose low cluster holds at most ``threshold`` of
    the sum, given a signal's distinct values in order and how often each occurs."""
    x, m = np.asarray(distinct, float), len(distinct)
    total = (count * x).sum()
    if count.sum() < 2 or total <= 0:
        return x[:0]
    w, s1, s2 = (np.concatenate([[0.0], np.cumsum(v)]) for v in (count.astype(float), count * x, count * x * x))
    near = _EPS * max(s2[-1] - s1[-1] * s1[-1] / w[-1], 1e-300)

    def own(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Squared error of one cluster of the distinct values i to j - 1."""
        sums = s1[j] - s1[i]
        return np.maximum(s2[j] - s2[i] - sums * sums / (w[j] - w[i]), 0)

    ends = np.arange(1, m + 1)
    best = np.concatenate([[0.0], own(np.zeros(m, int), ends)])
    table = None
    if m * m <= LEAVES:  # each k looks at the same costs of few values
        i = np.arange(m)
        table = np.where(i < ends[:, None], own(np.minimum(i, ends[:, None] - 1), ends[:, None]), np.inf)
    cuts: list[np.ndarray] = []
    for k in range(2, m + 1):
        if table is None:
            best, at = _last_minima(k, m, lambda i, j: best[i] + own(i, j), near)  # noqa: B023
        else:
            best, at = _last_minima_of(table, k, best, near)
        cuts.append(at)
        edges, j = [], m
        for at in reversed(cuts):
            j = int(at[j])
            edges.append(j)
        if s1[j] / total <= threshold:
            return x[edges[::-1]]
    return x[1:]


def optimal_labels(values: np.ndarray, threshold: float = 0.01) -> np.ndarray:
    """Cluster numbers from 0, the lowest, of a whole signal; see ``cluster_starts``."""
    values = np.asarray(values, float)
    return np.searchsorted(cluster_starts(*np.unique(values, return_counts=True), threshold), values, "right")


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Half-open intervals of equal non-zero values."""
    edges = np.flatnonzero(np.diff(flags)) + 1
    bounds = [0, *edges.tolist(), len(flags)]
    return [(a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b > a and flags[a] > 0]


def represent(job: dict[str, np.ndarray], threshold: float = 0.01, merged: bool = True) -> list[dict]:
    """The events of one job from its arrays: bytes, and operations and access patterns where they are present."""
    read, write = np.asarray(job["bytesRead"], float), np.asarray(job["bytesWritten"], float)
    n = len(read)
    norm = np.sqrt(read * read + write * write)
    zero = dict(read_volume=0.0, read_bw=0.0, write_volume=0.0, write_bw=0.0, read_pattern="Uncl", write_pattern="Uncl", read_operations=0, write_operations=0)
    if not n:
        return []
    single = n == 1
    labels = {"norm": optimal_labels(norm, threshold), "Read": optimal_labels(read, threshold), "Write": optimal_labels(write, threshold)}
    if single:
        labels = {"norm": (norm > 0).astype(int), "Read": (read > 0).astype(int), "Write": (write > 0).astype(int)}
    phases = runs((labels["norm"] > 0).astype(int) if merged else labels["norm"])
    if not phases:
        if norm.sum() > 0:
            phases = [(0, n)]
        else:
            return [{"phase": i, "event": e, **zero} for i, e in enumerate((0, n - 1))]
    if phases[0][0] > 0:
        phases.insert(0, (0, phases[0][0]))
    out, gone = [], 0
    for s, e in phases:
        row = {"phase": len(out), "event": s - gone}
        gone += e - s - 1
        for side, signal in (("Read", read), ("Write", write)):
            on = labels[side][s:e] > 0
            volume, extent = signal[s:e][on].sum(), int(on.sum())
            totals = [np.asarray(job[f"access{p}{side}"])[s:e][on].sum() if f"access{p}{side}" in job else 0 for p in ACCESS]
            count = np.asarray(job[f"operation{side}"])[s:e][on].sum() if f"operation{side}" in job else 0
            low = side.lower()
            row |= {f"{low}_volume": float(volume), f"{low}_bw": float(volume / extent) if extent else 0.0, f"{low}_pattern": ACCESS[int(np.argmax(totals))], f"{low}_operations": int(count)}
        out.append(row)
    if phases[-1][1] < n:
        out.append({"phase": len(out), "event": n - 1 - gone, **zero})
    return out


def clusters(signals: DataFrame, columns: list[str], threshold: float = 0.01) -> DataFrame:
    """(job_id, one array of ``cluster_starts`` for each column). A job's histograms are counted before they move, and the
    starts, a few numbers for each job, are found once, however often they are joined."""
    values = F.explode(F.array(*(F.struct(F.lit(c).alias("signal"), F.col(c).cast("double").alias("value")) for c in columns)))
    counted = signals.select("job_id", values.alias("_v")).groupBy("job_id", "_v.signal", "_v.value").agg(F.count(F.lit(1)).alias("n"))
    held = counted.groupBy("job_id", "signal").agg(F.array_sort(F.collect_list(F.struct("value", "n"))).alias("held"))
    lists = spread(held, "job_id", "signal").select("job_id", "signal", F.col("held.value").alias("x"), F.col("held.n").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("x"), batch.column("n"))
            starts = [cluster_starts(x.values.to_numpy(), n.values.to_numpy(), threshold) for x, n in rows]
            yield pa.record_batch([batch.column("job_id"), batch.column("signal"), pa.array(starts, pa.list_(pa.float64()))], ["job_id", "signal", "starts"])

    found = lists.withColumn("job_id", F.col("job_id").cast("long")).mapInArrow(run, "job_id long, signal string, starts array<double>")
    return cut(found.groupBy("job_id").agg(*(F.first(F.when(F.col("signal") == c, F.col("starts")), ignorenulls=True).alias(f"starts_{c}") for c in columns)))


def adaptive_labels(signals: DataFrame, threshold: float = 0.01) -> DataFrame:
    """``signals`` with the joint signal ``norm`` and the cluster numbers ``label``, ``label_read``, ``label_write``.

    A signal of one sample is I/O where it isn't 0; a joint signal that never changes and isn't 0 is one run.
    """
    read, write = F.col("bytesRead").cast("double"), F.col("bytesWritten").cast("double")
    rows = signals.withColumn("norm", F.sqrt(read * read + write * write))
    named = {"norm": "label", "bytesRead": "label_read", "bytesWritten": "label_write"}
    met = rows.join(clusters(rows, list(named), threshold), "job_id")
    whole = Window.partitionBy("job_id")
    met = met.withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn("_sum", F.sum("norm").over(whole))
    for value, label in named.items():
        number = F.size(F.filter(f"starts_{value}", lambda start: start <= F.col(value).cast("double")))  # noqa: B023
        if value == "norm":
            number = F.when((F.size("starts_norm") == 0) & (F.col("_sum") > 0), 1).otherwise(number)
        met = met.withColumn(label, F.when(F.col("_n") == 1, (F.col(value) > 0).cast("int")).otherwise(number))
    return met.drop("_n", "_sum", *(f"starts_{c}" for c in named))


def adaptive_representation(signals: DataFrame, threshold: float = 0.01, merged: bool = True) -> DataFrame:
    """REPRESENTATION rows of every job in ``signals``; clusters above the lowest are one run if ``merged``."""
    names = [f.split()[0] for f in REPRESENTATION.split(", ")]
    metrics = [c for c in signals.columns if c.startswith(("bytes", "operation", "access"))]
    if merged:
        needed = [f"operation{side}" for side in ("Read", "Write")] + [f"access{p}{side}" for side in ("Read", "Write") for p in ACCESS]
        whole = signals.select("job_id", "idx", *metrics, *(F.lit(0).alias(c) for c in needed if c not in metrics))
        events = sig.representation(adaptive_labels(whole, threshold), "label_read", "label_write", "label")
        number = F.row_number().over(Window.partitionBy("job_id").orderBy("event", "s")) - 1
        return events.withColumn("phase", number.cast("int")).withColumn("job_id", F.col("job_id").cast("long")).select(*names)

    def run(job: pd.DataFrame) -> pd.DataFrame:
        job = job.sort_values("idx")
        rows = pd.DataFrame(represent({c: job[c].to_numpy() for c in metrics}, threshold, merged))
        rows.insert(0, "job_id", job["job_id"].iloc[0])
        return rows[names]

    return signals.select("job_id", "idx", *metrics).groupBy("job_id").applyInPandas(run, REPRESENTATION)


def binary_segmentation(values: np.ndarray, penalty: float) -> list[int]:
    """Change points by binary segmentation with squared error: split while a split gains more than the penalty."""
    return changes.binary(changes.Squared(values), len(values), penalty)


def pelt(values: np.ndarray, penalty: float) -> list[int]:
    """Change points with the least squared error plus penalty for each, by pruned dynamic programming."""
    return changes.optimal(changes.Squared(values), len(values), penalty)


def alternating_phases(points: DataFrame) -> DataFrame:
    """Breakpoints in pairs: each odd one opens a phase that the next closes; an open last one has no end."""
    w = Window.partitionBy("job_id").orderBy("idx")
    rows = points.withColumn("nth", F.row_number().over(w)).withColumn("e", F.lead("idx").over(w))
    return rows.where("nth % 2 = 1").select("job_id", F.col("idx").alias("s"), "e")


def silhouette_clusters(values: DataFrame, column: str, most: int = 50, gain: float = 1.02, seed: int = 1):
    """(k, predictions): k-means with the fewest clusters that more ones don't beat by the gain in silhouette."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=[column], outputCol="features").transform(values).cache()
    best, chosen = -1.0, None
    for k in range(2, most + 1):
        out = KMeans(k=k, seed=seed).fit(data).transform(data)
        score = ClusteringEvaluator(metricName="silhouette").evaluate(out)
        if chosen is not None and score <= best * gain:
            break
        best, chosen = score, (k, out)
    data.unpersist()
    return chosen
