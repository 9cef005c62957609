"""Gradients against differences, and support vectors and networks against the linear model on a curved target."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasewell.operators import descent, model


@pytest.mark.parametrize("loss,size", [(descent._Layers((3, 4, 2, 1)), 3 * 4 + 4 + 4 * 2 + 2 + 2 + 1), (descent._Tube(descent.RandomFeatures.drawn(3, 6, 0.5, 1), 0.05), 7)])
def test_gradients_are_those_of_differences(loss, size):
    rng = np.random.default_rng(3)
    w, x, y = rng.normal(size=size), rng.normal(size=(9, 3)), rng.normal(size=9)
    _, gradient = loss(w, x, y)
    for i in range(size):
        step = np.eye(size)[i] * 1e-6
        assert gradient[i] == pytest.approx((loss(w + step, x, y)[0] - loss(w - step, x, y)[0]) / 2e-6, abs=1e-4)


def test_random_features_approach_the_kernel():
    x = np.random.default_rng(1).normal(size=(20, 2))
    z = descent.RandomFeatures.drawn(2, 20_000, 0.7, 2)(x)[:, :-1]
    kernel = np.exp(-0.7 * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - kernel).max() < 0.05


@pytest.fixture(scope="module")
def curved(spark):
    rng = np.random.default_rng(8)
    x = rng.uniform(-2, 2, (1500, 2))
    y = 100 + 50 * (np.sin(2 * x[:, 0]) + x[:, 1] ** 2) + rng.normal(0, 2, 1500)
    rows = [(i, *map(float, r), 1.0, float(v)) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, cat__a double, cat__b double, remainder__c double, y double").repartition(6).cache()


@pytest.mark.parametrize("kind", ["svr", "multilayer"])
def test_curved_target_beats_the_linear_model_on_the_same_folds(curved, kind):
    linear = model.cross_validated(curved, "y", "id", "linear", folds=2)
    assert model.cross_validated(curved, "y", "id", kind, folds=2) > max(0.9, linear + 0.3)


def test_fit_falls_and_repeats(curved):
    one = descent.multilayer(curved, ["cat__a", "cat__b"], "y", hidden=(8,), rounds=15)
    two = descent.multilayer(curved.repartition(2), ["cat__a", "cat__b"], "y", hidden=(8,), rounds=15)
    assert one.losses[-1] < 0.7 * one.losses[0] and one.losses == pytest.approx(two.losses)
    got = one.transform(curved.limit(3).withColumn("cat__a", F.when(F.col("id") >= 0, F.lit(None).cast("double")))).collect()
    assert [r["predicted_y"] for r in got] == [None] * 3
    empty = descent.support_vectors(curved.limit(0), ["cat__a"], "y", rounds=2)
    assert empty.transform(curved.limit(2)).count() == 2


def test_equal_rows_are_held_once_with_all_their_labels():
    import pyarrow as pa

    x = np.repeat(np.random.default_rng(4).integers(0, 2, (40, 2)).astype(float), 60, 0)
    y = np.arange(len(x), dtype=float)
    batches = [pa.record_batch([x[a : a + 700, 0], x[a : a + 700, 1], y[a : a + 700]], ["x0", "x1", "y"]) for a in range(0, len(x), 700)]
    (got,) = descent._gathered(["x0", "x1"])(iter(batches))
    assert got.num_rows < 10 and max(map(len, got.column("ys").to_pylist())) <= descent.LABELS
    rows = {(a, b, v) for a, b, ys in zip(*(got.column(c).to_pylist() for c in ("x0", "x1", "ys"))) for v in ys}
    assert rows == {(*map(float, p), v) for p, v in zip(x, y.tolist())}
    held = np.stack([got.column(c).to_numpy() for c in ("x0", "x1")], 1)
    of, labels = np.repeat(np.arange(len(held)), got.column("ys").value_lengths().to_numpy()), got.column("ys").flatten().to_numpy() / 1_000
    for loss, size in ((descent._Layers((2, 4, 1)), 17), (descent._Tube(descent.RandomFeatures.drawn(2, 6, 0.5, 1), 0.05), 7)):
        w = np.random.default_rng(5).normal(size=size)
        once, every = loss(w, held, labels, of), loss(w, x, y / 1_000)
        assert once[0] == pytest.approx(every[0]) and once[1] == pytest.approx(every[1])


def test_blocks_have_distinct_rows_with_counted_labels():
    """Rows of two tasks' copies are packed once each; their losses are those of all rows, label by label."""
    import pyarrow as pa

    rng = np.random.default_rng(9)
    x = np.repeat(np.append(rng.integers(0, 2, (20, 2)).astype(float), rng.normal(size=(30, 2)), 0), 5, 0)
    y = rng.integers(0, 40, len(x)) / 10
    batches = [pa.record_batch([x[a : a + 90, 0], x[a : a + 90, 1], y[a : a + 90]], ["x0", "x1", "y"]) for a in range(0, len(x), 90)]
    batches.append(pa.record_batch([pa.array([None, 1.0]), pa.array([0.5, 0.5]), pa.array([1.0, None])], ["x0", "x1", "y"]))
    tasks = [*descent._combined(["x0", "x1"])(iter(batches)), *descent._combined(["x0", "x1"])(iter(batches[:-1]))]
    (block,) = descent._packed(["x0", "x1"])(iter(tasks))
    held, lengths, labels, n = (np.frombuffer(block.column(c)[0].as_buffer(), t) for c, t in (("x", float), ("lengths", np.int64), ("y", float), ("n", np.int64)))
    held = held.reshape(-1, 2)
    counted = {(*map(float, np.append(p, v)),): 2 * int(((x == p).all(1) & (y == v)).sum()) for p, v in zip(x, y)}
    of = np.repeat(np.arange(len(held)), lengths)
    assert {(*map(float, np.append(held[i], v)),): int(c) for i, v, c in zip(of, labels, n)} == counted and len(n) == len(counted)
    assert len(held) == len(np.unique(x, axis=0)) == block.column("rows")[0].as_py()
    end = np.cumsum(lengths)
    grouped = descent.Labels(labels, n, end - lengths, end)
    tube, layers = descent._Tube(descent.RandomFeatures.drawn(2, 6, 0.5, 1), 0.1), descent._Layers((2, 4, 1))
    w, v = rng.normal(size=7), rng.normal(size=17)
    off, z = tube.predict(w, x) - y, tube.mapped(x)
    loss, gradient = tube.grouped(w, held, grouped)
    assert loss == pytest.approx(2 * np.maximum(np.abs(off) - 0.1, 0).sum())
    assert gradient == pytest.approx(2 * z.T @ (np.sign(off) * (np.abs(off) > 0.1)))
    assert layers.grouped(v, held, grouped)[0] == pytest.approx(((layers.predict(v, x) - y) ** 2).sum())
    moments = sum(map(descent.Moments.read, block.column("moments")[0].as_py()), descent.Moments.of(np.zeros((0, 3))))
    scaling = descent.Scaling.of(moments)
    assert scaling.rows == 2 * len(x) + 2 and moments.known.tolist() == [2 * len(x) + 1, 2 * len(x) + 2, 2 * len(x) + 1]
    assert scaling.mean[0] == pytest.approx(np.append(np.tile(x[:, 0], 2), 1).mean()) and scaling.deviation[1] == pytest.approx(np.append(np.tile(x[:, 1], 2), [0.5, 0.5]).std())


def test_constant_columns_have_deviation_1():
    parts = [descent.Moments.of(np.full((k, 2), [0.1, np.nan])) for k in (3, 0, 7)]
    scaling = descent.Scaling.of(sum(parts[1:], parts[0]))
    assert scaling.mean.tolist() == [0.1, 0.0] and scaling.deviation.tolist() == [1.0, 1.0] and scaling.rows == 10


def test_a_fit_reads_its_rows_once_and_its_rounds_run_few_tasks(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(4_000).selectExpr("cast(id % 7 as double) AS a", "cast(id % 5 as double) AS b", "cast(id % 7 * 3 + id % 11 as double) AS y")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    spark.sparkContext.setJobGroup("fit", "fit")
    try:
        fitted = descent.support_vectors(rows.mapInArrow(count, rows.schema), ["a", "b"], "y", rounds=8)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert seen.value == 4_000 and len(fitted.losses) == 8
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("fit") for s in tracker.getJobInfo(j).stageIds}
    assert sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i) < 8 * 30
