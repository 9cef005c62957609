"""Hidden states of counted series: Poisson rates behind each sample, fitted over all jobs at once.

A state lasts with probability 1 - ``change`` and gives way to each other one alike; all states begin alike. Rates are
fitted by expectation maximisation: in each round tasks run forward and backward sums in log space over their own jobs,
and one aggregate adds up, for each state, how many samples it explains and their counts; the likelihood never falls.
The most likely path comes from Viterbi's recursion. A job's series is one row of an array; jobs of one task are padded
to a common length and run side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Samples of all jobs that run side by side, unless one job has more.
CELLS = 1 << 20


@dataclass
class Fitted:
    """Rates in ascending order, and the log likelihood before each round and at the end."""

    rates: list[float]
    likelihoods: list[float]


def series_of(signals: DataFrame, value: str) -> DataFrame:
    """(job_id, xs): each job's samples in order; null counts as 0."""
    rows = signals.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("idx", F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("x")))).alias("rows"))
    return spread(rows.select("job_id", F.col("rows.x").alias("xs")), "job_id")


def log_weights(x: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """The log probability of each count under each rate, states last."""
    rates = np.maximum(rates, 1e-12)
    return x[..., None] * np.log(rates) - rates - np.vectorize(lgamma)(x + 1)[..., None]


def log_steps(states: int, change: float) -> np.ndarray:
    if states == 1:
        return np.zeros((1, 1))
    out = np.full((states, states), change / (states - 1))
    np.fill_diagonal(out, 1 - change)
    return np.log(out)


def _added(logs: np.ndarray, axis: int) -> np.ndarray:
    top = logs.max(axis, keepdims=True)
    return (top + np.log(np.exp(logs - top).sum(axis, keepdims=True))).squeeze(axis)


def posteriors(x: np.ndarray, size: np.ndarray, rates: np.ndarray, change: float) -> tuple[np.ndarray, np.ndarray]:
    """Each sample's probabilities of the states, and each series' log likelihood; rows of ``x`` end after ``size``."""
    n, steps = x.shape[1], log_steps(len(rates), change)
    weights = log_weights(x, rates)
    weights[np.arange(n) >= size[:, None]] = 0.0  # the padding says nothing
    ahead, behind = np.empty_like(weights), np.zeros_like(weights)
    ahead[:, 0] = weights[:, 0] - np.log(len(rates))
    for t in range(1, n):
        ahead[:, t] = weights[:, t] + _added(ahead[:, t - 1, :, None] + steps, 1)
    for t in range(n - 2, -1, -1):
        behind[:, t] = _added(steps + (weights[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
    whole = _added(ahead[:, -1], 1)
    return np.exp(ahead + behind - whole[:, None, None]), whole


def most_likely(x: np.ndarray, size: np.ndarray, rates: np.ndarray, change: float) -> np.ndarray:
    """Each series' most likely states, the lower one on ties; the padding repeats the last one."""
    n, steps = x.shape[1], log_steps(len(rates), change)
    weights = log_weights(x, rates)
    best, came = weights[:, 0] - np.log(len(rates)), np.zeros(weights.shape, np.int32)
    for t in range(1, n):
        through = best[:, :, None] + steps
        on = (t < size)[:, None]
        came[:, t] = np.where(on, through.argmax(1), np.arange(len(rates)))
        best = np.where(on, through.max(1) + weights[:, t], best)
    path = np.empty(x.shape, np.int32)
    path[:, -1] = best.argmax(1)
    for t in range(n - 1, 0, -1):
        path[:, t - 1] = came[np.arange(len(x)), t, path[:, t]]
    return path


def _padded(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, padded series, sizes) of the batch's series side by side, CELLS at a time."""
    lists = batch.column("xs")
    size = np.diff(lists.offsets.to_numpy())
    values, starts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()[:-1]
    order = np.argsort(size, kind="stable")
    order = order[size[order] > 0]
    begin = 0
    while begin < len(order):
        end = begin + 1
        while end < len(order) and (end + 1 - begin) * size[order[end]] <= CELLS:
            end += 1
        rows = order[begin:end]
        x = np.zeros((len(rows), size[rows[-1]]))
        for k, r in enumerate(rows):
            x[k, : size[r]] = values[starts[r] : starts[r] + size[r]]
        yield rows, x, size[rows]
        begin = end


def _round(series: DataFrame, rates: np.ndarray, change: float) -> tuple[np.ndarray, np.ndarray, float]:
    """For each state the samples it explains and their counts, and the log likelihood, summed over all jobs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples, counts, likelihood = np.zeros(len(rates)), np.zeros(len(rates)), 0.0
        for batch in batches:
            for _, x, size in _padded(batch):
                of_state, whole = posteriors(x, size, rates, change)
                of_state = of_state * (np.arange(x.shape[1]) < size[:, None])[..., None]
                samples, counts, likelihood = samples + of_state.sum((0, 1)), counts + (of_state * x[..., None]).sum((0, 1)), likelihood + whole.sum()
        states = np.arange(len(rates))
        yield pa.record_batch([pa.array(states), pa.array(samples), pa.array(counts), pa.array(np.where(states == 0, likelihood, 0.0))], ["state", "samples", "counts", "likelihood"])

    parts = series.select("xs").mapInArrow(run, "state long, samples double, counts double, likelihood double")
    found = parts.groupBy("state").agg(F.sum("samples"), F.sum("counts"), F.sum("likelihood")).orderBy("state").collect()
    samples, counts, likelihood = (np.array([r[i] for r in found], float) for i in (1, 2, 3))
    return samples, counts, float(likelihood.sum())


def fit(signals: DataFrame, value: str, states: int, change: float = 0.05, rounds: int = 20, tolerance: float = 1e-6) -> Fitted:
    """Rates of ``states`` states over all jobs, from the counts' spread on; it ends where a round gains less than
    ``tolerance`` of the likelihood. Without samples all rates are 0."""
    series = series_of(signals, value).cache()
    mean = signals.agg(F.avg(F.coalesce(F.col(value).cast("double"), F.lit(0.0)))).first()[0]
    if mean is None:
        return Fitted([0.0] * states, [])
    rates = np.maximum(mean, 1e-6) * 2.0 ** np.linspace(-2, 2, states) if states > 1 else np.array([mean])
    likelihoods: list[float] = []
    for _ in range(rounds + 1):
        samples, counts, likelihood = _round(series, rates, change)
        likelihoods.append(likelihood)
        if len(likelihoods) > rounds or (len(likelihoods) > 1 and likelihood - likelihoods[-2] <= tolerance * abs(likelihood)):
            break
        rates = np.where(samples > 1e-12, counts / np.maximum(samples, 1e-12), rates)
    series.unpersist()
    return Fitted(sorted(rates.tolist()), likelihoods)


def by_states(signals: DataFrame, value: str, most: int, change: float = 0.05, **options) -> list[tuple[int, Fitted]]:
    """Models of 1 to ``most`` states, for a look at how the likelihood grows."""
    return [(k, fit(signals, value, k, change, **options)) for k in range(1, most + 1)]


def _decoded(signals: DataFrame, value: str, schema: str, of: Callable) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x, size in _padded(batch):
                held = np.arange(x.shape[1]) < size[:, None]
                jobs = batch.column("job_id").take(pa.array(rows))
                row, idx = np.nonzero(held)
                yield pa.record_batch([jobs.take(pa.array(row)), pa.array(idx.astype(np.int32)), *of(x, size, held)], [c.split()[0] for c in schema.split(", ")])

    return series_of(signals, value).withColumn("job_id", F.col("job_id").cast("long")).mapInArrow(run, schema)


def paths(signals: DataFrame, value: str, rates: list[float], change: float = 0.05) -> DataFrame:
    """(job_id, idx, state, rate) of each sample on its job's most likely path; states are numbered by the rates given."""
    known = np.array(rates, float)

    def of(x: np.ndarray, size: np.ndarray, held: np.ndarray) -> list[pa.Array]:
        state = most_likely(x, size, known, change)[held]
        return [pa.array(state), pa.array(known[state])]

    return _decoded(signals, value, "job_id long, idx int, state int, rate double", of)


def expected_rates(signals: DataFrame, value: str, rates: list[float], change: float = 0.05) -> DataFrame:
    """(job_id, idx, rate): each sample's rate, averaged over the states by their probabilities."""
    known = np.array(rates, float)
    of = lambda x, size, held: [pa.array((posteriors(x, size, known, change)[0] @ known)[held])]
    return _decoded(signals, value, "job_id long, idx int, rate double", of)
