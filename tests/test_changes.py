"""Change points under every cost and search against plain quadratic versions, and the elbow of the cost curve."""

import itertools
import math

import numpy as np
import pytest

from phasewell.operators import changes


def _plain(cost: str):
    """A segment's cost by its definition."""
    if cost == "l1":
        return lambda x: sum(abs(v - sorted(x)[len(x) // 2]) for v in x)
    if cost == "l2":
        return lambda x: sum((v - sum(x) / len(x)) ** 2 for v in x)
    return lambda x: len(x) * math.log(sum((v - sum(x) / len(x)) ** 2 for v in x) / len(x) + 1e-6)


def _series():
    rng = np.random.default_rng(4)
    out = [rng.integers(0, 6, n) for n in (1, 2, 3, 5, 9, 17, 40)]
    return out + [np.repeat([0, 7, 1, 1, 9], [6, 3, 8, 1, 9]), np.zeros(12, int), np.arange(20), rng.normal(size=31).round(2)]


def _total(own, x, points):
    return sum(own(x[a:b]) for a, b in itertools.pairwise([0, *points, len(x)]))


@pytest.mark.parametrize("cost", ["l1", "l2", "normal"])
def test_costs(cost):
    own = _plain(cost)
    for x in _series():
        fast, n = changes.COSTS[cost](x), len(x)
        a, b = (np.array(v) for v in zip(*[(i, j) for i in range(n) for j in range(i + 1, n + 1)]))
        assert fast(a, b) == pytest.approx([own(x[i:j].tolist()) for i, j in zip(a, b)], abs=1e-6)


def test_medians_of_whole_numbers_are_exact():
    x = np.array([2**55, 1, 2**55 + 1, 3])
    assert changes.Absolute(x)(np.array([0]), np.array([4]))[0] == 2**56 - 3


@pytest.mark.parametrize("cost", ["l1", "l2", "normal"])
@pytest.mark.parametrize("least,step", [(1, 1), (2, 1), (3, 2), (2, 5)])
def test_optimal_is_the_quadratic_recursion(cost, least, step):
    own = _plain(cost)
    for x in _series():
        n = len(x)
        ends = [*range(step, n, step), n]
        for penalty in (0.5, 3.0, 20.0):
            best = {0: -penalty}
            for t in ends:
                found = [best[s] + own(x[s:t].tolist()) + penalty for s in best if t - s >= least]
                if found:
                    best[t] = min(found)
            points = changes.optimal(changes.COSTS[cost](x), n, penalty, least, step)
            assert all(p % step == 0 for p in points) and all(b - a >= least for a, b in itertools.pairwise([0, *points, n]) if points)
            if n in best:
                assert _total(own, x.tolist(), points) + penalty * len(points) == pytest.approx(best[n], abs=1e-6)


def test_least_absolute_deviation_by_enumeration():
    own = _plain("l1")
    for x in _series()[:5]:
        n = len(x)
        best = min(_total(own, x.tolist(), c) + 2 * k for k in range(n) for c in itertools.combinations(range(1, n), k))
        points = changes.optimal(changes.Absolute(x), n, 2)
        assert _total(own, x.tolist(), points) + 2 * len(points) == best


@pytest.mark.parametrize("least,step", [(1, 1), (2, 1), (3, 2)])
def test_bottom_up_joins_the_cheapest_neighbours(least, step):
    own = _plain("l2")
    for x in _series():
        width, n = -(-least // step) * step, len(x)
        held = [*range(0, max(n - least, 0) + 1, width), n]
        while len(held) > 2:
            losses = [own(x[a:c].tolist()) - own(x[a:b].tolist()) - own(x[b:c].tolist()) for a, b, c in zip(held, held[1:], held[2:])]
            i = min(range(len(losses)), key=lambda k: (round(losses[k], 9), k))
            if losses[i] >= 4:
                break
            del held[i + 1]
        assert changes.bottom_up(changes.Squared(x), n, 4, least, step) == held[1:-1]


def test_binary_and_window_find_steps():
    x = np.repeat([0, 50, 10, 90], [30, 20, 26, 40])
    for cost in changes.COSTS.values():
        for search in (changes.binary, changes.window, changes.bottom_up, changes.optimal):
            assert search(cost(x), len(x), 30.0, least=2) == [30, 50, 76]
        assert changes.window(cost(x[:1]), 1, 1.0) == [] == changes.binary(cost(x[:1]), 1, 1.0)
    assert changes.window(changes.Squared(x), len(x), 1e9) == []
    one = changes.window(changes.Squared(x), len(x), 30_000.0)
    assert one == [76]  # the highest peak, the next one gains less


@pytest.mark.parametrize("kernel", ["linear", "rbf"])
def test_kernel_costs_and_counts_by_enumeration(kernel):
    rng = np.random.default_rng(7)
    for x in [rng.integers(0, 5, 9).astype(float), np.repeat([1.0, 5.0, 2.0], 3), rng.normal(size=10)]:
        n = len(x)
        distances = sorted((a - b) ** 2 for a, b in itertools.combinations(x, 2))
        middle = (distances[(len(distances) - 1) // 2] + distances[len(distances) // 2]) / 2
        assert changes.median_gamma(x) == pytest.approx(1 / middle if middle else 1.0)
        k = changes.linear if kernel == "linear" else lambda a, b: changes.gaussian(a, b, 1 / middle if middle else 1.0)
        gram = k(x, x)
        own = lambda a, b: np.trace(gram[a:b, a:b]) - gram[a:b, a:b].sum() / (b - a)  # noqa: B023, E731
        fast = changes.Kernel(x, k)
        for a, b in itertools.combinations(range(n + 1), 2):
            assert fast(np.array([a]), np.array([b]))[0] == pytest.approx(own(a, b), abs=1e-7)
        costs, points = changes.by_count(fast, n, 3)
        for count in (1, 2, 3):
            every = {c: sum(own(a, b) for a, b in itertools.pairwise([0, *c, n])) for c in itertools.combinations(range(1, n), count)}
            assert costs[count - 1] == pytest.approx(min(every.values()), abs=1e-7) == every[tuple(points[count - 1])]


def test_elbow():
    assert changes.elbow(np.array([100.0, 40.0, 8.0, 6.0, 5.0, 4.0, 3.0])) == 3
    assert changes.elbow(np.array([5.0, 5.0])) is None and changes.elbow(np.array([1.0])) is None
    assert changes.elbow(np.arange(10, 0, -1).astype(float)) is None  # a straight line has none
    assert changes.at_elbow(np.repeat([0, 9, 2, 30], 20)) == [20, 40, 60] == changes.at_elbow(np.repeat([0, 9, 2, 30], 20), "rbf")
    assert changes.at_elbow(np.array([1.0])) == changes.at_elbow(np.zeros(0)) == []


def test_jobs(spark):
    import pandas as pd

    x = np.repeat([0, 50, 5], [8, 6, 10])
    rows = pd.DataFrame({"job_id": [1] * len(x) + [2], "idx": [*range(len(x)), 0], "v": [*x.tolist(), 5]})
    df = spark.createDataFrame(rows)
    for method in changes.SEARCHES:
        for cost in changes.COSTS:
            assert [tuple(r) for r in changes.change_points(df, "v", 20.0, method, cost, least=2).orderBy("idx").collect()] == [(1, 8), (1, 14)]
    assert [r["idx"] for r in changes.elbow_points(df, "v", "rbf").orderBy("idx").collect()] == [8, 14]
    with pytest.raises(ValueError):
        changes.change_points(df, "v", 1.0, cost="l3")
    with pytest.raises(ValueError):
        changes.elbow_points(df, "v", "sine")


@pytest.mark.parametrize("step", [1, 3])
def test_series_looked_at_together(step):
    """As each by itself, with ties, equal, short and empty series among them."""
    rng = np.random.default_rng(5)
    series = [rng.integers(0, 6, n) * rng.choice([0, 100], n) for n in (40, 1, 7, 0, 90, 40, 2)] + [np.full(12, 3)]
    for penalty in (0.0, 3.0, 100.0):
        alone = [changes.optimal(changes.Absolute(x), len(x), penalty, 1, step) for x in series]
        for most in (1, 100, changes.TOGETHER):
            parts = list(changes._parts(series, most))
            assert [len(x) for part in parts for x in part] == [len(x) for x in series]
            found = [f for p in parts for f in changes.optimal_of_all(changes.Absolute(np.concatenate(p)), np.array([len(x) for x in p]), penalty, step)]
            assert [list(f) for f in found] == alone
    assert [list(f) for f in changes._found(series, "l1", "pelt", 3.0, 1, step)] == [changes.optimal(changes.Absolute(x), len(x), 3.0, 1, step) for x in series]
