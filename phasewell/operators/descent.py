"""Regressors that Spark's library lacks, fitted by descent over partitions: support vectors through random features, and
multilayer networks.

Rows are read once: each task puts its rows of equal features together, a shuffle brings those of all tasks together, and
what a task then has is packed into blocks of distinct rows, each with its sorted distinct labels and their counts. The
same pass finds the means and deviations by which features and labels are standardised. In each round every task adds
up the loss and its gradient over its own blocks; a round maps each distinct row's features once and finds the labels
that matter by bisection. Only parameters and each task's gradient, never rows, pass through the driver. Fits depend on
the rows and the seed, and on their partitions by rounding alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Rows among which equal features are looked for, labels held with one row at the most, and labels packed at once.
BLOCK, LABELS, PACKED = 100_000, 1_000, 1_000_000
#: Tasks that rows of equal features are dealt to at the most, where they are many.
SALTS = 16
#: Distinct rows of a task in each round at the most, while tasks are fewer than a shuffle has, and rows whose features are mapped at once.
TASK, CHUNK = 20_000, 4_096


class Loss(Protocol):
    """(parameters, distinct rows, their labels) -> (summed loss, summed gradient)"""

    def grouped(self, w: np.ndarray, x: np.ndarray, held: Labels) -> tuple[float, np.ndarray]: ...


def _matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], 1).astype(float) if names else np.zeros((batch.num_rows, 0))


def _together(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows with equal ones side by side, and where in it another row begins. Rows are ordered by a hash;
    where different rows share one, equal rows may begin anew."""
    bits = (x + 0.0).view(np.uint64)
    factors = np.random.default_rng(7).integers(1 << 63, size=x.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    mixed = np.zeros(len(x), np.uint64)
    for column, factor in zip(bits.T, factors):
        mixed = (mixed ^ (mixed >> np.uint64(31))) + (column ^ (column >> np.uint64(32))) * factor
    order = np.argsort(mixed, kind="stable")
    near = x[order]
    return order, np.append(True, (near[1:] != near[:-1]).any(1))[: len(x)]


def _gathered(names: list[str]):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held, size = [], 0
        for batch in batches:
            held.append((_matrix(batch, names), batch.column("y").to_numpy()))
            size += batch.num_rows
            if size >= BLOCK:
                yield tuple(map(np.concatenate, zip(*held)))
                held, size = [], 0
        if size:
            yield tuple(map(np.concatenate, zip(*held)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each distinct row of a block with its labels, at most LABELS of them in one row."""
        for x, y in blocks(batches):
            order, new = _together(x)
            begin = np.flatnonzero(new)
            place = np.arange(len(x)) - np.repeat(begin, np.diff(np.append(begin, len(x))))
            begin = np.flatnonzero(place % LABELS == 0)
            labels = pa.ListArray.from_arrays(pa.array(np.append(begin, len(x)).astype(np.int32)), pa.array(y[order]))
            first = x[order[begin]]
            yield pa.record_batch([*(pa.array(np.ascontiguousarray(first[:, i])) for i in range(len(names))), labels], [*names, "ys"])

    return run


@dataclass
class Moments:
    """Rows, and by column the values that aren't null, their means and summed squares of distances from them."""

    rows: int
    known: np.ndarray
    mean: np.ndarray
    squares: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        seen = ~np.isnan(x)
        known = seen.sum(0)
        base = np.nan_to_num(x[seen.argmax(0), np.arange(x.shape[1])]) if len(x) else np.zeros(x.shape[1])
        off = np.where(seen, x - base, 0.0)  # a constant column's are exactly 0
        shift = off.sum(0) / np.maximum(known, 1)
        return cls(len(x), known, base + shift, (np.where(seen, off - shift, 0.0) ** 2).sum(0))

    def __add__(self, other: Moments) -> Moments:
        known = self.known + other.known
        share, off = other.known / np.maximum(known, 1), other.mean - self.mean
        mean = np.where(self.known > 0, self.mean + off * share, other.mean)
        return Moments(self.rows + other.rows, known, mean, self.squares + other.squares + off**2 * self.known * share)

    def flat(self) -> np.ndarray:
        return np.concatenate([[self.rows], self.known, self.mean, self.squares]).astype(float)

    @classmethod
    def read(cls, flat: list[float]) -> Moments:
        return cls(int(flat[0]), *np.array(flat[1:]).reshape(3, -1))


def _combined(names: list[str]):
    gathered = _gathered(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows without nulls as ``_gathered`` has them, and one row without labels that has the moments of all."""
        moments = Moments.of(np.zeros((0, len(names) + 1)))

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal moments
            for batch in batches:
                x = _matrix(batch, [*names, "y"])
                moments += Moments.of(x)
                known = ~np.isnan(x).any(1)
                yield batch if known.all() else batch.filter(pa.array(known))

        kind = pa.list_(pa.float64())
        for out in gathered(seen()):
            yield pa.record_batch([*out.columns, pa.array([[]] * out.num_rows, kind)], [*names, "ys", "moments"])
        yield pa.record_batch([*(pa.array([0.0]) for _ in names), pa.array([[]], kind), pa.array([moments.flat()], kind)], [*names, "ys", "moments"])

    return run


def _packed(names: list[str]):
    def pack(x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        order, new = _together(x)
        group = np.empty(len(x), np.int64)
        group[order] = np.cumsum(new) - 1
        of = np.repeat(group, lengths)
        sort = np.lexsort((y, of))
        of, y = of[sort], y[sort]
        begin = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (y[1:] != y[:-1])))
        return {"x": x[order[new]], "lengths": np.bincount(of[begin], minlength=new.sum()), "y": y[begin], "n": np.diff(np.append(begin, len(y)))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of distinct rows, the numbers of their distinct labels, these labels in order and the rows with each, all as
        bytes; with the first the moments of the tasks."""
        held, moments, size = [], [], 0

        def out() -> pa.RecordBatch:
            parts = pack(*map(np.concatenate, zip(*held))) if held else {c: np.zeros(0) for c in ("x", "lengths", "y", "n")}
            columns = [pa.array([parts[c].tobytes()], pa.binary()) for c in parts]
            return pa.record_batch([*columns, pa.array([len(parts["lengths"])]), pa.array([moments], pa.list_(pa.list_(pa.float64())))], [*parts, "rows", "moments"])

        for batch in batches:
            lengths = batch.column("ys").value_lengths().to_numpy().astype(np.int64)
            known = lengths > 0
            moments += batch.filter(pa.array(~known)).column("moments").to_pylist()
            if known.any():
                held.append((_matrix(batch, names)[known], lengths[known], batch.column("ys").flatten().to_numpy()))
                size += int(lengths.sum()) + known.sum() * len(names)
            if size >= PACKED:
                yield out()
                held, moments, size = [], [], 0
        if held or moments:
            yield out()

    return run


@dataclass
class Labels:
    """The labels of rows: ``begin`` and ``end`` of each row's own in ``y``, in which they are sorted; ``n`` has the times
    each occurs."""

    y: np.ndarray
    n: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    @classmethod
    def each(cls, y: np.ndarray, of: np.ndarray, rows: int) -> Labels:
        """Labels one by one, each of the row that ``of`` has."""
        sort = np.lexsort((y, of))
        end = np.cumsum(np.bincount(of, minlength=rows))
        return cls(y[sort], np.ones(len(y)), np.append(0, end)[:-1], end)

    def __post_init__(self) -> None:
        self.count, self.total = (np.append(0.0, np.cumsum(v)) for v in (self.n, self.n * self.y))

    def of(self, rows: slice) -> Labels:
        part = object.__new__(Labels)
        part.__dict__.update(self.__dict__, begin=self.begin[rows], end=self.end[rows])
        return part

    def before(self, value: np.ndarray, equal: bool) -> np.ndarray:
        """Where in each row's labels those end that are less than its value, or ``equal`` to it."""
        low, high = self.begin.copy(), self.end.copy()
        while (open_ := low < high).any():
            middle = np.where(open_, (low + high) // 2, 0)
            less = self.y[middle] <= value if equal else self.y[middle] < value
            low, high = np.where(open_ & less, middle + 1, low), np.where(open_ & ~less, middle, high)
        return low

    def sums(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and sum of the labels in each range."""
        return self.count[end] - self.count[begin], self.total[end] - self.total[begin]


@dataclass
class Scaling:
    """Means and deviations of the features and, last, of the label; constant columns have deviation 1."""

    mean: np.ndarray
    deviation: np.ndarray
    rows: int

    @classmethod
    def of(cls, moments: Moments) -> Scaling:
        deviation = np.sqrt(moments.squares / np.maximum(moments.known, 1))
        return cls(moments.mean, np.where(deviation > 0, deviation, 1.0), moments.rows)


@dataclass
class Held:
    """The distinct rows of a table in blocks that tasks keep, and the scaling of all its rows; to be used in a ``with``."""

    kept: DataFrame
    blocks: DataFrame
    scaling: Scaling

    @classmethod
    def of(cls, rows: DataFrame, features: list[str], label: str) -> Held:
        names = [f"x{i}" for i in range(len(features))]
        plain = rows.select(*[F.col(c).cast("double").alias(n) for c, n in zip([*features, label], [*names, "y"])])
        met = plain.mapInArrow(_combined(names), ", ".join([*(f"{n} double" for n in names), "ys array<double>", "moments array<double>"]))
        salt = F.when(F.size("ys") < LABELS, F.lit(0)).otherwise(F.pmod(F.xxhash64(F.get("ys", F.lit(0))), F.lit(SALTS)).cast("int"))
        kept = spread(met, *names, salt).mapInArrow(_packed(names), "x binary, lengths binary, y binary, n binary, rows long, moments array<array<double>>").cache()
        found = kept.select("rows", "moments").collect()  # a few numbers for each task
        moments = sum(map(Moments.read, sorted(m for r in found for m in r["moments"])), Moments.of(np.zeros((0, len(names) + 1))))
        cores = rows.sparkSession.sparkContext.defaultParallelism
        waves = -(-sum(r["rows"] for r in found) // (TASK * cores))
        return cls(kept, kept.drop("rows", "moments").coalesce(cores * max(waves, 1)), Scaling.of(moments))

    def __enter__(self) -> Held:
        return self

    def __exit__(self, *_) -> None:
        self.kept.unpersist()

    def summed(self, loss: Loss, point: np.ndarray) -> np.ndarray:
        """The loss over all rows and, after it, its gradient."""
        scaling = self.scaling

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(point) + 1)
            for batch in batches:
                for x, lengths, y, n in zip(*batch.columns):
                    lengths, y, n = (np.frombuffer(v.as_buffer(), t) for v, t in ((lengths, np.int64), (y, float), (n, np.int64)))
                    x = (np.frombuffer(x.as_buffer()).reshape(len(lengths), -1) - scaling.mean[:-1]) / scaling.deviation[:-1]
                    end = np.cumsum(lengths)
                    labels = Labels((y - scaling.mean[-1]) / scaling.deviation[-1], n, end - lengths, end)
                    for i in range(0, len(x), CHUNK):
                        rows = slice(i, i + CHUNK)
                        total += np.append(*loss.grouped(point, x[rows], labels.of(rows)))
            yield pa.record_batch([pa.array([total], pa.list_(pa.float64()))], ["g"])

        parts = [r["g"] for r in self.blocks.mapInArrow(run, "g array<double>").collect()]
        return np.sum(parts, 0) if parts else np.zeros(len(point) + 1)


def descend(held: Held, loss: Loss, begin: np.ndarray, rounds: int, rate: float, weight: float) -> tuple[np.ndarray, list[float]]:
    """Parameters after ``rounds`` rounds of Adam's steps on the mean loss plus ``weight`` times half their square, the
    ones with the least loss seen, and the losses."""
    now, first, second = begin.copy(), np.zeros_like(begin), np.zeros_like(begin)
    best, losses = (np.inf, begin), []
    for k in range(1, rounds + 1):
        total, *gradient = held.summed(loss, now) / max(held.scaling.rows, 1)
        gradient = np.array(gradient) + weight * now
        losses.append(float(total) + weight * float(now @ now) / 2)
        if losses[-1] < best[0]:
            best = losses[-1], now
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        step = rate * (1 - 0.9 * (k - 1) / rounds)  # smaller towards the end
        now = now - step * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    return best[1], losses


@dataclass
class Model:
    """A fitted regressor: ``transform`` adds its prediction to rows that have the features; null features give null."""

    features: list[str]
    predicted: str
    scaling: Scaling
    parameters: np.ndarray
    apply: Callable[[np.ndarray, np.ndarray], np.ndarray]
    losses: list[float] = field(default_factory=list)

    def transform(self, rows: DataFrame) -> DataFrame:
        scaling, parameters, apply = self.scaling, self.parameters, self.apply

        def values(x: np.ndarray) -> np.ndarray:
            order, new = _together(x)  # equal rows of a batch are worked out once
            back = np.empty(len(x), np.int64)
            back[order] = np.cumsum(new) - 1
            found = apply(parameters, (x[order[new]] - scaling.mean[:-1]) / scaling.deviation[:-1])
            return (found * scaling.deviation[-1] + scaling.mean[-1])[back]

        if not self.features:
            return rows.withColumn(self.predicted, F.lit(float(values(np.zeros((1, 0)))[0])))

        def run(*columns: pa.Array) -> pa.Array:
            found = values(np.stack([c.to_numpy(zero_copy_only=False) for c in columns], 1).astype(float))
            return pa.array(found, mask=np.isnan(found))

        return rows.withColumn(self.predicted, F.arrow_udf(run, "double")(*self.features))


@dataclass
class RandomFeatures:
    """Cosines of random projections: their products approach a Gaussian kernel of width 1 / sqrt(2 gamma)."""

    directions: np.ndarray
    shifts: np.ndarray

    @classmethod
    def drawn(cls, inputs: int, count: int, gamma: float, seed: int) -> RandomFeatures:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(size=(inputs, count)) * np.sqrt(2 * gamma), rng.uniform(0, 2 * np.pi, count))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        mapped = np.cos(x @ self.directions + self.shifts) * np.sqrt(2 / len(self.shifts))
        return np.concatenate([mapped, np.ones((len(x), 1))], 1)


@dataclass
class _Tube:
    """Deviations beyond ``width`` cost their excess."""

    mapped: RandomFeatures
    width: float

    def predict(self, w: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.mapped(x) @ w

    def __call__(self, w: np.ndarray, x: np.ndarray, y: np.ndarray, of: np.ndarray | None = None) -> tuple[float, np.ndarray]:
        return self.grouped(w, x, Labels.each(y, np.arange(len(x)) if of is None else of, len(x)))

    def grouped(self, w: np.ndarray, x: np.ndarray, held: Labels) -> tuple[float, np.ndarray]:
        z = self.mapped(x)
        found = z @ w
        low, high = found - self.width, found + self.width
        under, under_sum = held.sums(held.begin, held.before(low, False))
        over, over_sum = held.sums(held.before(high, True), held.end)
        return float((under * low - under_sum + over_sum - over * high).sum()), z.T @ (under - over)


@dataclass
class _Layers:
    """A network of rectified layers, squared error; ``sizes`` from the inputs to the one output."""

    sizes: tuple[int, ...]

    def begin(self, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        return np.concatenate([np.append(rng.normal(size=a * b) * np.sqrt(2 / max(a, 1)), np.zeros(b)) for a, b in zip(self.sizes, self.sizes[1:])])

    def _split(self, w: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in zip(self.sizes, self.sizes[1:]):
            out.append((w[at : at + a * b].reshape(a, b), w[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def _forward(self, w: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        seen, layers = [x], self._split(w)
        for k, (weights, shift) in enumerate(layers):
            z = seen[-1] @ weights + shift
            seen.append(z if k == len(layers) - 1 else np.maximum(z, 0))
        return seen

    def predict(self, w: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self._forward(w, x)[-1][:, 0]

    def __call__(self, w: np.ndarray, x: np.ndarray, y: np.ndarray, of: np.ndarray | None = None) -> tuple[float, np.ndarray]:
        return self.grouped(w, x, Labels.each(y, np.arange(len(x)) if of is None else of, len(x)))

    def grouped(self, w: np.ndarray, x: np.ndarray, held: Labels) -> tuple[float, np.ndarray]:
        seen = self._forward(w, x)
        n, total = held.sums(held.begin, held.end)
        mean = total / np.maximum(n, 1)
        off = seen[-1][:, 0] - mean
        own = slice(held.begin[0], held.end[-1]) if len(x) else slice(0)
        apart = held.n[own] * (held.y[own] - np.repeat(mean, held.end - held.begin)) ** 2
        back, parts = (n * off)[:, None], []
        for (weights, _), below in zip(reversed(self._split(w)), reversed(seen[:-1])):
            parts.append(np.append((below.T @ back).ravel(), back.sum(0)))
            back = (back @ weights.T) * (below > 0)
        return float((n * off**2).sum() + apart.sum()) / 2, np.concatenate(parts[::-1])


def support_vectors(rows: DataFrame, features: list[str], label: str, gamma: float | None = None, width: float = 0.1, cost: float = 100.0, count: int = 200, rounds: int = 60, rate: float = 0.1, seed: int = 1) -> Model:
    """Support-vector regression with a Gaussian kernel of standardised features, ``gamma`` one over their number unless
    it is given, through ``count`` random features."""
    loss = _Tube(RandomFeatures.drawn(len(features), count, gamma or 1 / max(len(features), 1), seed), width)
    with Held.of(rows, features, label) as held:
        w, losses = descend(held, loss, np.zeros(count + 1), rounds, rate, 1 / (cost * max(held.scaling.rows, 1)))
    return Model(features, f"predicted_{label}", held.scaling, w, loss.predict, losses)


def multilayer(rows: DataFrame, features: list[str], label: str, hidden: tuple[int, ...] = (32, 16), rounds: int = 100, rate: float = 0.03, weight: float = 1e-4, seed: int = 1) -> Model:
    """A network with ``hidden`` rectified layers under squared error."""
    loss = _Layers((len(features), *hidden, 1))
    with Held.of(rows, features, label) as held:
        w, losses = descend(held, loss, loss.begin(seed), rounds, rate, weight)
    return Model(features, f"predicted_{label}", held.scaling, w, loss.predict, losses)
