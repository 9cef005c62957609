"""What each feature contributes to a model's predictions: exact Shapley values of linear models and of trees, and sampled
ones of any model.

A tree's leaves are a bounded table: for each feature on a leaf's path an interval, and the share of the background rows
that pass the splits on it. A row's values follow from which of a leaf's intervals it meets, so each distinct pattern of
a batch is worked out once. The shares come from one aggregate over the background's leaf numbers.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPLIT = re.compile(r"(If|Else) \(feature (\d+) (<=|>) (\S+)\)")


@dataclass
class Leaf:
    """A leaf's value, weighted by its tree, and for each feature on its path the interval (low, high] and the share."""

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def linear_attribution(rows: DataFrame, features: list[str], coefficients: list[float], keep: list[str]) -> DataFrame:
    """``keep`` and by_<feature>: each coefficient times the feature's distance from its mean."""
    means = rows.agg(*[F.avg(c).alias(c) for c in features]).first()
    by = [(F.lit(float(k)) * (F.col(c) - F.lit(means[c]))).alias(f"by_{c}") for c, k in zip(features, coefficients, strict=True)]
    return rows.select(*keep, *by)


def _paths(text: str) -> list[tuple[float, list[tuple[int, bool, float]]]]:
    """A printed tree's leaves, first to last: value, and the splits on the way as (feature, is it at most, threshold)."""
    found, path = [], []
    for line in text.splitlines():
        depth = (len(line) - len(line.lstrip(" "))) - 2
        if match := _SPLIT.match(line.strip()):
            del path[depth:]
            path.append((int(match[2]), match[3] == "<=", float(match[4])))
        elif line.strip().startswith("Predict:"):
            found.append((float(line.split(":")[1]), path[:depth]))
        elif "(feature" in line:
            raise ValueError("only splits of numbers")
    return found


def _leaves(text: str, count: dict[int, int], weight: float) -> list[Leaf]:
    paths = _paths(text)
    met: dict[tuple, int] = {}
    for number, (_, path) in enumerate(paths):
        for depth in range(len(path) + 1):
            met[tuple(path[:depth])] = met.get(tuple(path[:depth]), 0) + count.get(number, 0)
    out = []
    for value, path in paths:
        held: dict[int, list[float]] = {}
        for depth, (feature, most, threshold) in enumerate(path):
            low, high, share = held.get(feature, [-np.inf, np.inf, 1.0])
            above = met[tuple(path[:depth])]
            passed = met[tuple(path[: depth + 1])] / above if above else 0.0
            held[feature] = [low, min(high, threshold), share * passed] if most else [max(low, threshold), high, share * passed]
        columns = np.array(list(held.values())).reshape(-1, 3).T
        out.append(Leaf(value * weight, np.array(list(held), int), *columns))
    return out


def leaves_of(model, background: DataFrame) -> list[Leaf]:
    """The leaves of all trees of a fitted tree, forest or boosted model; shares are those of ``background``'s rows."""
    from pyspark.ml.functions import vector_to_array

    trees = list(model.trees) if hasattr(model, "trees") else [model]
    weights = list(model.treeWeights) if hasattr(model, "treeWeights") else [1.0]
    if "Forest" in type(model).__name__:
        weights = [w / sum(weights) for w in weights]
    numbers = model.copy().setLeafCol("_leaf").transform(background.select("features")).select("_leaf")
    each = vector_to_array("_leaf") if hasattr(model, "trees") else F.array(F.col("_leaf").cast("double"))
    counted = numbers.select(F.posexplode(each).alias("tree", "leaf")).groupBy("tree", "leaf").count().collect()
    counts: list[dict[int, int]] = [{} for _ in trees]
    for row in counted:  # no more rows than leaves
        counts[row["tree"]][int(row["leaf"])] = row["count"]
    return [leaf for tree, count, weight in zip(trees, counts, weights) for leaf in _leaves(tree.toDebugString, count, weight)]


def _shapley_of(leaf: Leaf, met: np.ndarray) -> np.ndarray:
    """Values of a leaf's features for each row of ``met``, which tells the intervals that a row meets."""
    d = len(leaf.features)
    out = np.zeros(met.shape)
    order = [math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)]
    for i in range(d):
        ways = np.zeros((len(met), d))  # by the number of known features among the others
        ways[:, 0] = 1.0
        for j in range(d):
            if j != i:
                ways[:, 1:] = ways[:, 1:] * leaf.share[j] + ways[:, :-1] * met[:, j : j + 1]
                ways[:, 0] *= leaf.share[j]
        mean = sum(ways[:, k] * order[k] for k in range(d))  # not a product of matrices, which rounds a row by its place
        out[:, i] = leaf.value * (met[:, i] - leaf.share[i]) * mean
    return out


def contributions(x: np.ndarray, leaves: list[Leaf]) -> np.ndarray:
    """Each row's Shapley values, one column for each feature. The intervals that a row meets are the bits of a number."""
    columns, out = np.ascontiguousarray(x.T), np.zeros(x.shape[::-1])
    for leaf in leaves:
        if len(leaf.features):
            met = np.zeros(len(x), np.int64)
            for bit, (feature, low, high) in enumerate(zip(leaf.features, leaf.low, leaf.high)):
                met |= ((columns[feature] > low) & (columns[feature] <= high)).astype(np.int64) << bit
            few = len(leaf.features) <= 10 and 1 << len(leaf.features) <= len(x)
            patterns, back = (np.arange(1 << len(leaf.features)), met) if few else np.unique(met, return_inverse=True)
            values = _shapley_of(leaf, (patterns[:, None] >> np.arange(len(leaf.features)) & 1).astype(float))
            for i, feature in enumerate(leaf.features):
                out[feature] += values[back, i]
    return np.ascontiguousarray(out.T)


def tree_attribution(model, rows: DataFrame, keep: list[str], background: DataFrame | None = None) -> DataFrame:
    """``keep``, base and contributions (an array by feature) for each row with a vector ``features``: base and
    contributions sum to the model's prediction. ``background`` defaults to the rows themselves."""
    from pyspark.ml.functions import vector_to_array

    leaves = leaves_of(model, rows if background is None else background)
    base = float(sum(leaf.value * leaf.share.prod() for leaf in leaves))
    held = rows.select(*keep, vector_to_array("features").alias("_x"))
    schema = held.select(*keep, F.lit(0.0).alias("base"), F.col("_x").alias("contributions")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("_x").flatten().to_numpy().reshape(batch.num_rows, -1)
                found = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(contributions(x, leaves).ravel()))
                yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(np.full(len(x), base)), found], schema=pa.schema([*(batch.schema.field(c) for c in keep), ("base", pa.float64()), ("contributions", found.type)]))

    return held.mapInArrow(run, schema)


def sampled_attribution(model, rows: DataFrame, features: list[str], key: str, background: DataFrame, predicted: str, orders: int = 8, seed: int = 1, most: int = 256) -> DataFrame:
    """(key, feature, contribution) by ``orders`` random orders of the features for each row, for any fitted pipeline.

    In each order a background row's values give way one after another to the row's own; what the prediction changes by
    at a feature is its contribution, and the mean over the orders estimates the Shapley value. Contributions of a row
    sum exactly to its prediction less the mean of the background rows it met. At most ``most`` background rows, those
    with the least hash, are used and broadcast.
    """
    near = background.select(*features).withColumn("_hash", F.xxhash64(*features)).orderBy("_hash").limit(most)
    held = near.agg(F.collect_list(F.struct(*features)).alias("others"))
    size = len(features)
    draw = lambda *of: F.xxhash64(F.lit(seed), F.col(key), "_order", *of)
    met = rows.select(key, *features).withColumn("_order", F.explode(F.sequence(F.lit(0), F.lit(orders - 1)))).crossJoin(F.broadcast(held))
    other = F.element_at("others", (F.pmod(draw(), F.size("others")) + 1).cast("int"))
    ranked = F.array_sort(F.array(*(F.struct(draw(F.lit(i)).alias("h"), F.lit(i).alias("i")) for i in range(size))))
    met = met.withColumn("_other", other).withColumn("_ranked", F.transform(ranked, lambda r: r["i"])).drop("others")
    steps = met.withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(size))))
    mixed = [
        F.when(F.array_position("_ranked", F.lit(i)) <= F.col("_step"), F.col(c)).otherwise(F.col(f"_other.{c}")).alias(c) for i, c in enumerate(features)
    ]
    points = steps.select(key, "_order", "_step", F.get("_ranked", F.col("_step") - 1).alias("_feature"), *mixed)
    at = F.array_sort(F.collect_list(F.struct("_step", "_feature", predicted)))
    chains = model.transform(points).groupBy(key, "_order").agg(at.alias("chain"))
    gained = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.struct(F.get("chain", i)["_feature"].alias("i"), (F.get("chain", i)[predicted] - F.get("chain", i - 1)[predicted]).alias("by")))
    names: Column = F.array(*map(F.lit, features))
    return chains.select(key, F.explode(gained).alias("g")).groupBy(key, F.get(names, F.col("g.i")).alias("feature")).agg(F.avg("g.by").alias("contribution"))
