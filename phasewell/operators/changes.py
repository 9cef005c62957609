"""Change points of series under several costs and searches, and the number of them by the elbow of the cost curve.

A cost gives the error of any segments [a, b) of a series at once, as arrays: absolute deviation from the median through
a wavelet matrix of the values' ranks with prefix sums on each level, squared error through prefix sums, the normal
likelihood through the variance, a kernel's scatter through prefix sums of a low-rank feature map. Searches know costs
only by that call. Positions are multiples of ``step``, segments have ``least`` samples or more.

One job's series is one row of an array, and rows are dealt to as many tasks as a shuffle has.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

Cost = Callable[[np.ndarray, np.ndarray], np.ndarray]
_POINTS = "job_id long, idx long"
#: Samples of series that are looked at together.
TOGETHER = 1 << 16


def _prefix(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, x.dtype), np.cumsum(x)])


class Absolute:
    """Absolute deviation from the median; exact for integers."""

    def __init__(self, values: np.ndarray):
        x = np.asarray(values)
        x = x.astype(np.int64) if x.dtype.kind in "iub" else x.astype(float)
        distinct, rank = np.unique(x, return_inverse=True)
        self.total, self.levels = _prefix(x), []
        for bit in reversed(range(max(len(distinct) - 1, 0).bit_length())):
            low = rank >> bit & 1 == 0
            self.levels.append((_prefix(low.astype(np.int64)), _prefix(np.where(low, x, 0)), int(low.sum())))
            order = np.argsort(~low, kind="stable")
            x, rank = x[order], rank[order]
        self.leaves = np.append(x, x[:1] * 0)

    def smallest(self, a: np.ndarray, b: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sum of the k smallest values of each segment, and the largest of them, or the smallest of all for k = 0."""
        found = np.zeros(len(a), self.leaves.dtype)
        k = np.maximum(k, 1)
        for lows, sums, split in self.levels:
            begin, end = lows[a], lows[b]
            over = k > end - begin
            found[over] += (sums[b] - sums[a])[over]
            k = k - over * (end - begin)
            a, b = np.where(over, split + a - begin, begin), np.where(over, split + b - end, end)
        last = self.leaves[a]  # what is left of a segment is equal
        return found + k * last, last

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = np.broadcast_arrays(a, b)
        half = (b - a + 1) // 2
        low, middle = self.smallest(a, b, half)
        return self.total[b] - self.total[a] - 2 * low + np.where((b - a) % 2, middle, 0)


class Squared:
    """Squared deviation from the mean."""

    def __init__(self, values: np.ndarray):
        x = np.asarray(values, float)
        self.first, self.second = _prefix(x), _prefix(x * x)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        sums = self.first[b] - self.first[a]
        return self.second[b] - self.second[a] - sums * sums / (b - a)


class Normal:
    """Length times the logarithm of the variance, which is raised by ``least`` so that constant segments have one."""

    def __init__(self, values: np.ndarray, least: float = 1e-6):
        x = np.asarray(values, float)
        self.squared, self.least = Squared(x - x.mean() if len(x) else x), least

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (b - a) * np.log(np.maximum(self.squared(a, b), 0) / (b - a) + self.least)


def gaussian(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    return np.exp(-gamma * (x[:, None] - y[None, :]) ** 2)


def linear(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x[:, None] * y[None, :]


def median_gamma(values: np.ndarray) -> float:
    """One over the median squared distance of all pairs of samples, 1 where that is 0, through counts of values."""
    x, n = np.unique(np.asarray(values, float), return_counts=True)
    i, j = np.triu_indices(len(x))
    distance, pairs = (x[i] - x[j]) ** 2, np.where(i == j, n[i] * (n[i] - 1) // 2, n[i] * n[j])
    if not pairs.sum():
        return 1.0
    order = np.argsort(distance, kind="stable")
    upto = np.cumsum(pairs[order])
    low, high = (distance[order][np.searchsorted(upto, k, "right")] for k in ((upto[-1] - 1) // 2, upto[-1] // 2))
    return 1 / ((low + high) / 2) if low + high > 0 else 1.0


class Kernel:
    """Scatter around the mean in a kernel's space, by features from a pivoted Cholesky of the distinct values' Gram
    matrix: columns are added until no value's residual is above ``tolerance`` of the largest norm."""

    def __init__(self, values: np.ndarray, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], tolerance: float = 1e-10):
        distinct, inverse = np.unique(np.asarray(values, float), return_inverse=True)
        norms = np.array([kernel(distinct[i : i + 1], distinct[i : i + 1])[0, 0] for i in range(len(distinct))])
        left, columns = norms.copy(), []
        while len(columns) < len(distinct) and left.max() > tolerance * max(norms.max(), 1e-300):
            pivot = int(left.argmax())
            column = kernel(distinct, distinct[pivot : pivot + 1])[:, 0]
            for c in columns:
                column = column - c * c[pivot]
            columns.append(column / np.sqrt(left[pivot]))
            left = np.maximum(left - columns[-1] ** 2, 0)
        features = np.array(columns).T[inverse] if columns else np.zeros((len(inverse), 1))
        self.norms = _prefix(norms[inverse])
        self.sums = np.vstack([np.zeros((1, features.shape[1])), np.cumsum(features, 0)])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = np.broadcast_arrays(a, b)
        return self.norms[b] - self.norms[a] - ((self.sums[b] - self.sums[a]) ** 2).sum(-1) / (b - a)


COSTS: dict[str, Callable[[np.ndarray], Cost]] = {"l1": Absolute, "l2": Squared, "normal": Normal}


def _positions(n: int, step: int) -> np.ndarray:
    return np.append(np.arange(step, n, step), n)


def optimal(cost: Cost, n: int, penalty: float, least: int = 1, step: int = 1) -> list[int]:
    """The change points with the least total cost plus ``penalty`` for each, earlier ones on ties.

    A start that is worse by more than the penalty than one at t is given up from t + least on, where both may stand.
    """
    best, last = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    until = np.full(n + 1, n + 1)
    best[0], alive, waiting = -penalty, np.zeros(1, int), []
    for t in _positions(n, step).tolist():
        while waiting and waiting[0] + least <= t:
            alive = np.append(alive, waiting.pop(0))
        if least > 1:
            alive = alive[until[alive] > t]
        if t >= least and len(alive):
            costs = best[alive] + cost(alive, t)
            i = int(costs.argmin())
            best[t], last[t] = costs[i] + penalty, alive[i]
            worse = costs > best[t]
            if least == 1:
                alive = alive[~worse]
            else:
                until[alive[worse]] = np.minimum(until[alive[worse]], t + least)
            waiting.append(t)
    out, t = [], n
    while last[t] > 0:
        t = int(last[t])
        out.append(t)
    return out[::-1]


def _heads(owner: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    return np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))


def optimal_of_all(cost: Cost, sizes: np.ndarray, penalty: float, step: int = 1) -> list[np.ndarray]:
    """``optimal`` with ``least`` 1 of several series that lie one after another in ``cost``, all at once.

    Ends go from left to right in all series together, so that each step is one call for the starts of all that still go
    on. Sums run over other series too, so costs are the same where they are exact.
    """
    begin, order = np.cumsum(sizes) - sizes, np.argsort(-sizes, kind="stable")
    size, first = sizes[order], begin[order]  # the longest first: those that go on are the first ones
    longest = int(size[0]) if len(size) else 0
    best, last = np.full((longest + 1, len(size)), np.inf), np.zeros((longest + 1, len(size)), np.int64)
    best[0] = -penalty
    owner, start = np.arange(len(size)), np.zeros(len(size), np.int64)  # by owner, each one's starts from left to right
    before = 0
    while before < longest:
        t = min(before + step, longest)
        on = int(np.searchsorted(-size, -before, "left"))  # longer than the position before
        keep = owner < on
        owner, start = owner[keep], start[keep]
        at = np.minimum(t, size[:on])  # the last position is a series' end, whatever the step is
        costs = best[start, owner] + cost(first[owner] + start, (first[:on] + at)[owner])
        heads = _heads(owner)
        least = np.minimum.reduceat(costs, heads)
        found = np.flatnonzero(costs == least[owner])
        found = found[_heads(owner[found])]  # earlier ones on ties
        best[at, np.arange(on)], last[at, np.arange(on)] = least + penalty, start[found]
        keep = costs <= (least + penalty)[owner]
        ends = np.cumsum(np.bincount(owner[keep], minlength=on))
        owner, start = np.insert(owner[keep], ends, np.arange(on)), np.insert(start[keep], ends, at)
        before = t
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(size)
    for i, n in enumerate(size.tolist()):
        points, t = [], n
        while last[t, i] > 0:
            t = int(last[t, i])
            points.append(t)
        out[order[i]] = np.array(points[::-1], np.int64)
    return out


def binary(cost: Cost, n: int, penalty: float, least: int = 1, step: int = 1) -> list[int]:
    """Split in two where that gains most, and both parts again, while a split gains more than the penalty."""
    out, left = [], [(0, n)]
    while left:
        a, b = left.pop()
        at = np.arange(-(-(a + least) // step) * step, b - least + 1, step)
        if not len(at):
            continue
        gains = cost(np.array([a]), np.array([b]))[0] - cost(np.full(len(at), a), at) - cost(at, np.full(len(at), b))
        i = int(gains.argmax())
        if gains[i] > penalty:
            out.append(int(at[i]))
            left += [(a, int(at[i])), (int(at[i]), b)]
    return sorted(out)


def bottom_up(cost: Cost, n: int, penalty: float, least: int = 1, step: int = 1) -> list[int]:
    """Join the two neighbours that lose least, earlier ones on ties, from segments of the least size on, while that
    loses less than the penalty."""
    width = -(-least // step) * step
    starts = np.arange(0, max(n - least, 0) + 1, width)
    ends = np.append(starts[1:], n)
    own = cost(starts, ends).tolist() if n else []
    after = list(range(1, len(starts))) + [-1]
    before = list(range(-1, len(starts) - 1))
    begin, end, alive = starts.tolist(), ends.tolist(), [True] * len(starts)
    joined = cost(starts[:-1], ends[1:]).tolist() if len(starts) > 1 else []
    heap = [(joined[i] - own[i] - own[i + 1], begin[i], i, i + 1, end[i], end[i + 1], joined[i]) for i in range(len(joined))]
    heapq.heapify(heap)
    while heap:
        loss, _, i, j, e, f, both = heapq.heappop(heap)
        if not (alive[i] and alive[j] and end[i] == e and end[j] == f and after[i] == j):
            continue  # one of the two has changed
        if loss >= penalty:
            break
        own[i], end[i], alive[j], after[i] = both, f, False, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        near = [(x, y) for x, y in ((before[i], i), (i, after[i])) if x >= 0 and y >= 0]
        if near:
            whole = cost(np.array([begin[x] for x, _ in near]), np.array([end[y] for _, y in near])).tolist()
            for (x, y), c in zip(near, whole):
                heapq.heappush(heap, (c - own[x] - own[y], begin[x], x, y, end[x], end[y], c))
    return [b for b, a in zip(begin, alive) if a and b > 0]


def window(cost: Cost, n: int, penalty: float, least: int = 1, step: int = 1, width: int = 10) -> list[int]:
    """Where two windows of half a ``width`` differ most: peaks of the discrepancy among those half a width around,
    from the highest down, while one more gains more than the penalty."""
    half = max(width // 2, least)
    at = np.arange(-(-half // step) * step, n - half + 1, step)
    if not len(at):
        return []
    score = cost(at - half, at + half) - cost(at - half, at) - cost(at, at + half)
    reach = max(half // step, 1)
    padded = np.concatenate([np.full(reach, -np.inf), score, np.full(reach, -np.inf)])
    around = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1)
    others = np.maximum(around[:, :reach].max(1), around[:, reach + 1 :].max(1))
    peaks = np.flatnonzero(score > others)
    found: list[int] = []
    for i in peaks[np.argsort(-score[peaks], kind="stable")].tolist():
        place = int(np.searchsorted(found, at[i]))
        a, b = ([0, *found][place], [*found, n][place])
        parts = cost(np.array([a, a, at[i]]), np.array([b, at[i], b]))
        if parts[0] - parts[1] - parts[2] <= penalty:
            break
        found.insert(place, int(at[i]))
    return found


SEARCHES = {"pelt": optimal, "binseg": binary, "bottom_up": bottom_up, "window": window}


def by_count(cost: Cost, n: int, most: int) -> tuple[np.ndarray, list[list[int]]]:
    """The least total cost with 1, 2, ... ``most`` change points, and these points, earlier ones on ties.

    Ends go from left to right, so the costs of the segments that end at t are computed once for all counts.
    """
    best, last = np.full((most + 1, n + 1), np.inf), np.zeros((most + 1, n + 1), np.int32)
    for t in range(1, n + 1):
        starts = np.arange(t)
        costs = cost(starts, np.full(t, t))
        best[0, t] = costs[0]
        upto = min(most, t - 1)
        if upto:
            totals = best[:upto, :t] + costs
            at = totals.argmin(1)
            best[1 : upto + 1, t] = totals[np.arange(upto), at]
            last[1 : upto + 1, t] = at
    points = []
    for k in range(1, most + 1):
        out, t = [], n
        for left in range(k, 0, -1):
            t = int(last[left, t])
            out.append(t)
        points.append(out[::-1])
    return best[1:, n], points


def elbow(costs: np.ndarray, sensitivity: float = 1.0) -> int | None:
    """The count, from 1, at the knee of a falling convex curve: both axes are scaled to 0 to 1, and of the distance
    between the turned curve and the diagonal the first maximum is taken that is followed by a fall of ``sensitivity``
    steps before the next one."""
    n = len(costs)
    if n < 2 or costs.max() == costs.min():
        return None
    x = np.arange(n) / (n - 1)
    distance = 1 - (costs - costs.min()) / (costs.max() - costs.min()) - x
    before, after = np.append(distance[0], distance[:-1]), np.append(distance[1:], distance[-1])
    peak, low = (distance >= before) & (distance >= after), (distance <= before) & (distance <= after)
    at = bar = None
    for i in range(n - 1):
        if peak[i]:
            at, bar = i, distance[i] - sensitivity / (n - 1)
        if low[i] and at is not None:
            bar = 0.0
        if at is not None and distance[i + 1] < bar:
            return at + 1
    return None


def _by_job(signals: DataFrame, value: str, find: Callable[[list[np.ndarray]], list]) -> DataFrame:
    """(job_id, idx) of what ``find`` finds in each of several jobs' samples, nulls as 0; a job is one row of an array."""
    samples = F.array_sort(F.collect_list(F.struct("idx", F.coalesce(F.col(value), F.lit(0)).alias("x"))))
    rows = signals.groupBy(F.col("job_id").cast("long").alias("job_id")).agg(samples.alias("samples"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find([xs.values.to_numpy(zero_copy_only=False) for xs in batch.column("xs")])
            jobs = np.repeat(batch.column("job_id").to_numpy(zero_copy_only=False), [len(f) for f in found])
            yield pa.record_batch([pa.array(jobs, pa.int64()), pa.array([i for f in found for i in f], pa.int64())], ["job_id", "idx"])

    return spread(rows.select("job_id", F.col("samples.x").alias("xs")), "job_id").mapInArrow(run, _POINTS)


def _found(series: list[np.ndarray], cost: str, method: str, penalty: float, least: int, step: int) -> list:
    whole = all(x.dtype.kind in "iub" for x in series)
    if method == "pelt" and cost == "l1" and least == 1 and whole:  # exact, so that series can be looked at together
        return [points for part in _parts(series) for points in optimal_of_all(Absolute(np.concatenate(part)), np.array([len(x) for x in part]), penalty, step)]
    return [SEARCHES[method](COSTS[cost](x), len(x), penalty=penalty, least=least, step=step) for x in series]


def _parts(series: list[np.ndarray], most: int = TOGETHER) -> Iterator[list[np.ndarray]]:
    """Consecutive series whose number times the longest one's length is ``most`` at the most, or single ones."""
    part, longest = [], 0
    for x in series:
        if part and max(longest, len(x)) * (len(part) + 1) > most:
            yield part
            part, longest = [], 0
        part.append(x)
        longest = max(longest, len(x))
    if part:
        yield part


def _each(series: list[np.ndarray], find: Callable[[np.ndarray], list[int]]) -> list[list[int]]:
    return [find(x) for x in series]


def change_points(signals: DataFrame, value: str, penalty: float, method: str = "pelt", cost: str = "l2", least: int = 1, step: int = 1) -> DataFrame:
    """(job_id, idx) of the change points of every job's signal, by one of SEARCHES under one of COSTS."""
    if method not in SEARCHES or cost not in COSTS:
        raise ValueError(f"no {method} or no {cost}")
    return _by_job(signals, value, partial(_found, cost=cost, method=method, penalty=penalty, least=least, step=step))


def at_elbow(values: np.ndarray, kernel: str = "linear") -> list[int]:
    """As many change points as the elbow of the cost curve has, up to the root of the length; all if it has none."""
    x = np.asarray(values, float)
    most = min(int(np.sqrt(len(x))), len(x) - 1)
    if most < 1:
        return []
    cost = Kernel(x, linear if kernel == "linear" else partial(gaussian, gamma=median_gamma(x)))
    costs, points = by_count(cost, len(x), most)
    return points[(elbow(costs) or most) - 1]


def elbow_points(signals: DataFrame, value: str, kernel: str = "linear") -> DataFrame:
    """(job_id, idx) of every job's change points under a kernel, as many as the elbow of its cost curve has."""
    if kernel not in ("linear", "rbf"):
        raise ValueError(f"no kernel {kernel}")
    return _by_job(signals, value, partial(_each, find=partial(at_elbow, kernel=kernel)))
