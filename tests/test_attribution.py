"""Shapley values against all subsets, and schedules against all orders and choices."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from phasewell.operators import attribution, optimise


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, (200, 4)).astype(float)
    y = 3 * x[:, 0] + x[:, 1] * (x[:, 2] > 2) - 0.5 * x[:, 3] ** 2
    rows = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y double")
    return VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(df).cache()


def _by_subsets(leaves, x):
    """Each feature's mean gain over all orders, where an unknown feature meets an interval by its share."""
    n = len(x)

    def value(known):
        total = 0.0
        for leaf in leaves:
            p = leaf.value
            for f, low, high, share in zip(leaf.features, leaf.low, leaf.high, leaf.share):
                p *= (low < x[f] <= high) if f in known else share
            total += p
        return total

    out = np.zeros(n)
    for i in range(n):
        others = [j for j in range(n) if j != i]
        for k in range(n):
            for s in itertools.combinations(others, k):
                out[i] += math.factorial(k) * math.factorial(n - 1 - k) / math.factorial(n) * (value({*s, i}) - value(set(s)))
    return out, value(set()), value(set(range(n)))


@pytest.mark.parametrize("made", [
    lambda: DecisionTreeRegressor(labelCol="y", seed=1, maxDepth=4), lambda: RandomForestRegressor(labelCol="y", seed=1, numTrees=3, maxDepth=3),
    lambda: GBTRegressor(labelCol="y", seed=1, maxIter=3, maxDepth=2), lambda: DecisionTreeRegressor(labelCol="y", maxDepth=0),
])
def test_trees_by_all_subsets(points, made):
    model = made().fit(points)
    leaves = attribution.leaves_of(model, points)
    got = attribution.tree_attribution(model, model.transform(points), ["id", "prediction"]).collect()
    assert len(got) == 200
    for r in got:
        assert r["base"] + sum(r["contributions"]) == pytest.approx(r["prediction"], abs=1e-6)
    x = {r["id"]: r["features"].toArray() for r in points.collect()}
    for r in got[:12]:
        own, base, whole = _by_subsets(leaves, x[r["id"]])
        assert r["contributions"] == pytest.approx(own.tolist(), abs=1e-6) and r["base"] == pytest.approx(base) and whole == pytest.approx(r["prediction"])


def test_linear_and_sampled(points):
    names = ["a", "b", "c", "d"]
    from pyspark.ml import Pipeline

    pipeline = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), LinearRegression(labelCol="y")]).fit(points.drop("features"))
    coefficients = pipeline.stages[-1].coefficients.toArray()
    exact = attribution.linear_attribution(points, names, coefficients.tolist(), ["id"]).orderBy("id").collect()
    means = {n: points.agg(F.avg(n)).first()[0] for n in names}
    assert exact[5]["by_b"] == pytest.approx(coefficients[1] * (points.where("id = 5").first()["b"] - means["b"]))
    few = points.where("id < 6").drop("features")
    got = attribution.sampled_attribution(pipeline, few, names, "id", points, "prediction", orders=64).collect()
    assert len(got) == 24
    near = {(r["id"], r["feature"]): r["contribution"] for r in got}
    for r in exact[:6]:  # a linear model's estimate only varies with the background rows met
        for n, k in zip(names, coefficients):
            assert near[r["id"], n] == pytest.approx(r[f"by_{n}"], abs=abs(k) * 1.2)
    again = {(r["id"], r["feature"]): r["contribution"] for r in attribution.sampled_attribution(pipeline, few.repartition(3), names, "id", points, "prediction", orders=64).collect()}
    assert again == pytest.approx(near)
    assert attribution.sampled_attribution(pipeline, few.limit(0), names, "id", points, "prediction").count() == 0


def test_schedule_of_least_ends_by_enumeration(spark):
    """All orders of jobs and all choices of tiers of small chains; the sum of all phases' ends is the least."""
    rng = np.random.default_rng(6)
    rows = []
    for chain in range(6):
        for job in range(4):
            for i in range(int(rng.integers(1, 4))):
                rows.append((chain, job, i, int(rng.integers(0, 900)), int(rng.integers(1, 5)), int(rng.integers(1, 5)) if rng.random() < 0.7 else None))
    df = spark.createDataFrame(rows, "chain long, job long, i int, volume long, hdd_bw int, ssd_bw int")
    got = optimise.schedule_least_ends(df, ["hdd_bw", "ssd_bw"]).collect()
    for chain in range(6):
        own = [r for r in rows if r[0] == chain]
        jobs = {j: [r for r in own if r[1] == j] for j in {r[1] for r in own}}
        best = math.inf
        for order in itertools.permutations(jobs):
            for picks in itertools.product((4, 5), repeat=len(own)):
                if any(r[p] is None for r, p in zip(own, picks)):
                    continue
                speed, now, total = {(r[1], r[2]): r[p] for r, p in zip(own, picks)}, 0, 0
                for j in order:
                    for r in jobs[j]:
                        now += r[3] * 1_000_000 // speed[r[1], r[2]]
                        total += now
                best = min(best, total)
        held = [r for r in got if r["chain"] == chain]
        assert len(held) == len(own) and sum(r["t_end"] for r in held) == best
        assert all(r["t_end"] - r["t_start"] == next(o[3] for o in own if (o[1], o[2]) == (r["job"], r["i"])) * 1_000_000 // next(o[5 if r["tier"] == "ssd" else 4] for o in own if (o[1], o[2]) == (r["job"], r["i"])) for r in held)
    fixed = optimise.schedule_least_ends(df, ["hdd_bw", "ssd_bw"], sequence="given").where("chain = 0").orderBy("t_end", "job", "i").collect()
    assert [r["job"] for r in fixed] == sorted(r["job"] for r in fixed)
    none = spark.createDataFrame([(1, 1, 0, 5, None)], "chain long, job long, i int, volume long, hdd_bw int")
    assert optimise.schedule_least_ends(none, ["hdd_bw"]).first()["tier"] is None


def test_patterns_of_many_features_and_few_rows():
    """Numbers of patterns looked up in a whole table and among those that occur give the same values, row by row."""
    rng = np.random.default_rng(6)
    leaf = attribution.Leaf(2.0, np.array([3, 0, 2]), np.array([-np.inf, 0.2, 0.1]), np.array([0.5, 0.9, np.inf]), np.array([0.4, 0.5, 0.6]))
    x = rng.random((50, 4))
    met = (x[:, leaf.features] > leaf.low) & (x[:, leaf.features] <= leaf.high)
    expected = attribution._shapley_of(leaf, met.astype(float))
    for got in (attribution.contributions(x, [leaf]), np.concatenate([attribution.contributions(x[i : i + 1], [leaf]) for i in range(50)])):
        assert (got[:, leaf.features] == expected).all() and (got[:, 1] == 0).all()


def test_values_of_a_row_do_not_depend_on_its_place():
    rng = np.random.default_rng(6)
    for _ in range(50):
        d = int(rng.integers(2, 7))
        leaf = attribution.Leaf(2.0, np.arange(d), np.full(d, -np.inf), rng.random(d), rng.random(d))
        met = (rng.random((50, d)) < 0.5).astype(float)
        alone = np.concatenate([attribution._shapley_of(leaf, met[i : i + 1]) for i in range(50)])
        assert (attribution._shapley_of(leaf, met) == alone).all()
