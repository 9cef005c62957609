"""Hidden states against enumeration of all paths, and fits over several jobs."""

import itertools
import math

import numpy as np
import pytest

from phasewell.operators import hidden

RATES, CHANGE = np.array([0.5, 3.0, 9.0]), 0.2


def _joint(x, path, rates=RATES):
    out = -math.log(len(rates))
    for t, s in enumerate(path):
        if t:
            out += math.log(1 - CHANGE if s == path[t - 1] else CHANGE / (len(rates) - 1))
        out += x[t] * math.log(rates[s]) - rates[s] - math.lgamma(x[t] + 1)
    return out


def test_paths_and_posteriors_by_enumeration():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 6):
        x = rng.poisson(rng.choice(RATES, n)).astype(float)
        every = {p: _joint(x, p) for p in itertools.product(range(3), repeat=n)}
        padded, size = np.vstack([np.append(x, [7.0, 7.0]), np.zeros(n + 2)]), np.array([n, n + 2])  # a longer series beside it
        path = hidden.most_likely(padded, size, RATES, CHANGE)[0, :n]
        assert _joint(x, path) == pytest.approx(max(every.values()))
        of_state, whole = hidden.posteriors(padded, size, RATES, CHANGE)
        total = math.log(sum(map(math.exp, every.values())))
        assert whole[0] == pytest.approx(total)
        for t in range(n):
            for s in range(3):
                assert of_state[0, t, s] == pytest.approx(sum(math.exp(v - total) for p, v in every.items() if p[t] == s), abs=1e-9)


@pytest.fixture(scope="module")
def jobs(spark):
    rng = np.random.default_rng(5)
    rows = []
    for job in range(8):
        levels = np.repeat(rng.choice([1.0, 12.0], 6), rng.integers(5, 15, 6))
        rows += [(job, i, int(v)) for i, v in enumerate(rng.poisson(levels))]
    return spark.createDataFrame([*rows, (99, 0, None)], "job_id long, idx int, v int").repartition(5)


def test_fit_finds_the_rates_and_never_loses(spark, jobs, monkeypatch):
    got = hidden.fit(jobs, "v", 2)
    assert got.rates == pytest.approx([1.0, 12.0], rel=0.25)
    assert all(b >= a - 1e-9 for a, b in zip(got.likelihoods, got.likelihoods[1:])) and len(got.likelihoods) > 2
    monkeypatch.setattr(hidden, "CELLS", 1)
    assert hidden.fit(jobs.coalesce(1), "v", 2).rates == pytest.approx(got.rates)
    one, two, three = (f.likelihoods[-1] for _, f in hidden.by_states(jobs, "v", 3, rounds=8))
    assert two > one + 50 and three >= two - 20
    assert hidden.fit(jobs.limit(0), "v", 2).rates == [0.0, 0.0]


def test_decoding_jobs(jobs):
    rows = {(r["job_id"], r["idx"]): r["v"] or 0 for r in jobs.collect()}
    got = {(r["job_id"], r["idx"]): r for r in hidden.paths(jobs, "v", [1.0, 12.0]).collect()}
    assert got.keys() == rows.keys() and all(r["rate"] == [1.0, 12.0][r["state"]] for r in got.values())
    assert np.mean([(got[k]["state"] == 1) == (v > 5) for k, v in rows.items()]) > 0.95
    mean = {(r["job_id"], r["idx"]): r["rate"] for r in hidden.expected_rates(jobs, "v", [1.0, 12.0]).collect()}
    assert mean.keys() == rows.keys() and all(1 - 1e-9 <= v <= 12 + 1e-9 for v in mean.values())
