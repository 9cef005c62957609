"""Phases, events and representations against known vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasewell.operators import decompose, signals


def _series(spark, **columns):
    n = len(next(iter(columns.values())))
    rows = [(1, i, *[v[i] for v in columns.values()]) for i in range(n)]
    return spark.createDataFrame(rows, "job_id long, idx int, " + ", ".join(f"{c} long" for c in columns))


def _labelled(spark, values):
    labels = decompose.optimal_labels(np.array(values))
    return _series(spark, v=values, label=labels.tolist())


def _intervals(df):
    return sorted((r["s"], r["e"]) for r in df.collect())


READ, WRITE = [60, 30, 7, 0, 0, 0, 0, 0, 7, 10], [0, 0, 0, 0, 0, 0, 0, 25, 20, 0]


def test_intervals(spark):
    read, write = _labelled(spark, READ), _labelled(spark, WRITE)
    assert _intervals(signals.intervals(read, "label")) == [(0, 3), (8, 10)]
    assert _intervals(signals.intervals(write, "label")) == [(7, 9)]
    assert _intervals(signals.intervals(read, "label", merged=False)) == [(0, 1), (1, 2), (2, 3), (8, 10)]


@pytest.mark.parametrize(
    ("values", "merged", "events", "volumes"),
    [
        (READ, True, [0, 6], [97, 17]),
        (READ, False, [0, 1, 2, 8], [60, 30, 7, 17]),
        ([0, 0, 10, 8, 0, 0], True, [0, 2, 4], [0, 18, 0]),
        ([12, 0, 10, 8, 0, 19, 0], True, [0, 2, 4, 5], [12, 18, 19, 0]),
        ([0, 0, 10, 8, 0, 19, 20], True, [0, 2, 4], [0, 18, 39]),
        ([0, 1, 2, 2, 0], False, [0, 1, 2, 3], [0, 1, 4, 0]),
        ([0, 2, 1, 1, 0], True, [0, 1, 2], [0, 4, 0]),
    ],
)
def test_dirac_events_of_one_signal(spark, values, merged, events, volumes):
    df = _labelled(spark, values)
    runs = signals.intervals(df, "label", merged, ("v",))
    rows = runs if merged is False and values is READ else signals.with_sentinels(runs, df)
    if values[0] == 0:  # the leading phase is a point, like the others' beginnings
        rows = rows.withColumn("e", F.when(F.col("level") == 0, F.col("s") + 1).otherwise(F.col("e")))
    got = sorted((r["s"], r["event"], r["v"]) for r in signals.dirac(rows).collect())
    assert [g[2] for g in got] == volumes
    assert got[0][1] == events[0] == 0


@pytest.mark.parametrize(
    ("read", "write", "merged", "events", "reads", "writes"),
    [
        ([1, 0, 0, 0], [0, 1, 0, 0], True, [0, 2], [1, 0], [1, 0]),
        ([2, 0, 0, 0], [1, 1, 0, 0], False, [0, 1, 3], [2, 0, 0], [1, 1, 0]),
        ([2, 0, 0, 0], [1, 1, 0, 0], True, [0, 2], [2, 0], [2, 0]),
        ([1, 1, 1, 0, 0, 0], [0, 0, 0, 1, 1, 1], True, [0], [3], [3]),
        ([1, 1, 1, 1, 0, 0], [0, 0, 0, 1, 2, 2], True, [0, 1], [3, 1], [0, 5]),
        ([0] * 6, [0] * 6, True, [0, 5], [0, 0], [0, 0]),
    ],
)
def test_joint_representation(read, write, merged, events, reads, writes):
    got = decompose.represent({"bytesRead": np.array(read), "bytesWritten": np.array(write)}, merged=merged)
    assert [r["event"] for r in got] == events
    assert [r["read_volume"] for r in got] == reads and [r["write_volume"] for r in got] == writes


def test_adaptive_equals_per_job(spark):
    rows = [(j, i, v, 0) for j in range(3) for i, v in enumerate(np.roll([0, 0, 50, 60, 0, 0, 55, 0], j).tolist())]
    df = spark.createDataFrame(rows, "job_id long, idx int, bytesRead long, bytesWritten long")
    got = decompose.adaptive_representation(df).orderBy("job_id", "phase").collect()
    for j in range(3):
        values = np.array([r[2] for r in rows if r[0] == j])
        assert [(r["event"], r["read_volume"]) for r in got if r["job_id"] == j] == [(r["event"], r["read_volume"]) for r in decompose.represent({"bytesRead": values, "bytesWritten": values * 0})]


def test_cluster_counts():
    assert len(set(decompose.optimal_labels(np.arange(3)).tolist())) == 3
    assert len(set(decompose.optimal_labels(np.arange(500), 0.05).tolist())) == 5
    assert decompose.optimal_labels(np.zeros(4)).tolist() == [0, 0, 0, 0]


def test_volumes(spark):
    df = _series(spark, v=list(range(10)))
    assert signals.volume_trapezoid(df, "v").first()["volume"] == 40.5
    assert abs(signals.volume_simpson(df, "v").first()["volume"] - 40.5) < 1e-9
    assert abs(signals.volume_simpson(df.where("idx < 9"), "v").first()["volume"] - 32) < 1e-9


def test_relabelled_and_reconstructed(spark):
    df = _series(spark, v=[5, 5, 0, 0, 9, 9], label=[0, 0, 2, 2, 1, 1])
    assert [r["label"] for r in signals.relabelled(df, "v", "label").orderBy("idx").collect()] == [2, 2, 0, 0, 1, 1]
    assert [r["fitted"] for r in signals.reconstruct(df, "v", "label").orderBy("idx").collect()] == [5, 5, 0, 0, 9, 9]
    assert sorted(r["idx"] for r in signals.breakpoints(df, "label").collect()) == [2, 4]


def test_change_points():
    values = np.concatenate([np.zeros(50), np.full(30, 10.0), np.full(40, 4.0)])
    assert decompose.pelt(values, 10) == [50, 80] == decompose.binary_segmentation(values, 10)
    rng = np.random.default_rng(0)
    x = rng.normal(size=40)

    def best(n):  # all segmentations, by dynamic programming without pruning
        cost = [0 - 3.0]
        for t in range(1, n + 1):
            cost.append(min(cost[a] + ((x[a:t] - x[a:t].mean()) ** 2).sum() + 3.0 for a in range(t)))
        return cost[n]

    cuts = [0, *decompose.pelt(x, 3.0), 40]
    assert abs(sum(((x[a:b] - x[a:b].mean()) ** 2).sum() + 3.0 for a, b in zip(cuts, cuts[1:], strict=False)) - 3.0 - best(40)) < 1e-9
