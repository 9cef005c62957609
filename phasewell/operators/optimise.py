"""Placements and schedules by enumeration, budgets and dominance."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Ranges of values whose running minima are taken in tasks of their own.
RANGES = 1_000


def within_budget(rows: DataFrame, keys: list[str], order: list, size: Column, budget: Column) -> DataFrame:
    """Marks the rows whose running size stays within a budget."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("cumulated", F.sum(size).over(w)).withColumn("placed", F.col("cumulated") <= budget)


def pareto(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Rows that no other row dominates: none is as good in both and better in one (smaller is better).

    A row is dominated if a smaller ``a`` has a ``b`` as small, or an equal ``a`` a smaller one. Running minima over
    distinct values of ``a``, within ranges of them and over the ranges, say so without a self-join.
    """
    least = rows.groupBy(a).agg(F.min(b).alias("_least"))
    ends = least.agg(F.min(a).cast("double").alias("_lo"), F.max(a).cast("double").alias("_hi"))
    place = F.coalesce(F.floor(F.try_divide(F.col(a) - F.col("_lo"), F.col("_hi") - F.col("_lo")) * RANGES), F.lit(0))
    placed = least.crossJoin(F.broadcast(ends)).withColumn("_range", place).drop("_lo", "_hi")  # one row
    ranges = placed.groupBy("_range").agg(F.min("_least").alias("_own"))  # RANGES + 1 rows at the most
    above = F.min("_own").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.join(F.broadcast(ranges.select("_range", above.alias("_above"))), "_range")
    within = F.min("_least").over(Window.partitionBy("_range").orderBy(a).rowsBetween(Window.unboundedPreceding, -1))
    front = placed.withColumn("_before", F.least("_above", within)).drop("_above", "_range").where(F.col("_before").isNull() | (F.col("_least") < F.col("_before")))
    return rows.join(front, a).where(F.col(b) == F.col("_least")).drop("_least", "_before")


def assignments(nodes: DataFrame, tiers: DataFrame, names: list[str]) -> DataFrame:
    """Every assignment of the named nodes to tiers, one row each: choice (tier by node), cost, and whether it fits.

    Nodes are (node, demand), tiers (tier, latency, capacity, bandwidth); both are a problem's few literals.
    """
    nodes, tiers, out = nodes.coalesce(1), tiers.coalesce(1), None  # else partitions multiply
    for name in names:
        own = nodes.where(F.col("node") == name).crossJoin(tiers).select(
            F.struct("tier", "demand", "capacity", (F.col("latency") + F.col("demand") / F.col("bandwidth")).alias("cost")).alias(f"c{name}")
        )
        out = own if out is None else out.crossJoin(own)
    picks = F.array(*[f"c{n}" for n in names])
    total = F.aggregate(picks, F.lit(0.0), lambda s, p: s + p["cost"])
    fits = F.forall(picks, lambda p: F.aggregate(F.filter(picks, lambda q: q["tier"] == p["tier"]), F.lit(0.0), lambda s, q: s + q["demand"]) <= p["capacity"])
    return out.select(*[F.col(f"c{n}.tier").alias(f"n{n}") for n in names], total.alias("cost"), fits.alias("fits"))


def schedule_chain(phases: DataFrame, tiers: DataFrame) -> DataFrame:
    """(job, i, tier, t_start, t_end): jobs one after another, each phase on the tier with the most bandwidth."""
    best = tiers.orderBy(F.desc("bandwidth"), "tier").limit(1)
    rows = phases.crossJoin(F.broadcast(best)).withColumn("length", F.col("volume") / F.col("bandwidth") + F.col("compute"))
    order = Window.partitionBy("chain").orderBy("job", "i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("t_end", F.sum("length").over(order))
    return rows.select("chain", "job", "i", "tier", (F.col("t_end") - F.col("length")).alias("t_start"), "t_end")


def schedule_least_ends(phases: DataFrame, bandwidths: list[str], sequence: str = "best") -> DataFrame:
    """(chain, job, i, tier, t_start, t_end) in microseconds with the least sum of all phases' ends.

    Phases of a job follow each other, jobs of a chain do too. A phase goes to the tier that ends it first: any other
    choice delays it and all behind it. Of two neighbouring jobs the one with less time for each of its phases comes
    first, else exchanging them would lower the sum; equal ones go by number. ``sequence`` "given" keeps the jobs'
    numbers as their order. A phase without any tier's bandwidth has no tier and takes no time; unmeasured tiers, whose
    bandwidth is null or 0, are never chosen.
    """
    if sequence not in ("best", "given"):
        raise ValueError(f"no sequence {sequence}")
    lasts = F.array_compact(F.array(*(
        F.when(F.col(b) > 0, F.struct(F.floor(F.col("volume") * 1_000_000 / F.col(b)).cast("long").alias("length"), F.lit(b.removesuffix("_bw")).alias("tier")))
        for b in bandwidths
    )))
    first = F.array_min(lasts)
    rows = phases.select("chain", "job", "i", first["tier"].alias("tier"), F.coalesce(first["length"], F.lit(0)).alias("length"))
    jobs = rows.groupBy("chain", "job").agg(F.sum("length").alias("whole"), F.count(F.lit(1)).alias("n"))
    order = [F.col("whole") / F.col("n"), F.col("job")] if sequence == "best" else [F.col("job")]
    begin = F.sum("whole").over(Window.partitionBy("chain").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("whole")
    placed = rows.join(jobs.select("chain", "job", begin.alias("begin")), ["chain", "job"])
    inside = F.sum("length").over(Window.partitionBy("chain", "job").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    ended = placed.withColumn("t_end", F.col("begin") + inside)
    return ended.select("chain", "job", "i", "tier", (F.col("t_end") - F.col("length")).alias("t_start"), "t_end")


def lower_hull(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """The lower convex hull of each key's points, from left to right."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        hull: list[tuple[float, float]] = []
        for p in sorted(set(zip(group[x], group[y], strict=True))):
            while len(hull) > 1 and (hull[-1][0] - hull[-2][0]) * (p[1] - hull[-2][1]) - (hull[-1][1] - hull[-2][1]) * (p[0] - hull[-2][0]) <= 0:
                hull.pop()
            hull.append(p)
        return pd.DataFrame({key: [group[key].iloc[0]] * len(hull), x: [p[0] for p in hull], y: [p[1] for p in hull]})

    kind = dict(points.dtypes)
    return points.select(key, x, y).groupBy(key).applyInPandas(run, f"{key} {kind[key]}, {x} {kind[x]}, {y} {kind[y]}")


def padded(values: Column, n: Column) -> Column:
    """An array of length n: its last element repeated, or its beginning."""
    return F.when(F.size(values) >= n, F.slice(values, F.lit(1), n)).otherwise(F.concat(values, F.array_repeat(F.element_at(values, -1), n - F.size(values))))


def cheapest_transport(demand: dict, capacity: dict, distance: dict) -> tuple[float, dict] | None:
    """The least cost, and volumes by (customer, site), of serving all demand within the sites' capacities; None if it
    doesn't fit. Demand is routed along cheapest residual paths."""
    left, room, flow, cost = dict(demand), dict(capacity), {}, 0.0
    if sum(demand.values()) > sum(capacity.values()) + 1e-9:
        return None
    while any(v > 1e-12 for v in left.values()):
        dist = {("c", c): (0.0 if v > 1e-12 else float("inf")) for c, v in left.items()} | {("s", s): float("inf") for s in room}
        back: dict = {}
        for _ in range(len(dist)):
            changed = False
            for c in left:
                for s in room:
                    if dist["c", c] + distance[s][c] < dist["s", s] - 1e-12:
                        dist["s", s], back["s", s], changed = dist["c", c] + distance[s][c], ("c", c), True
                    if flow.get((c, s), 0) > 1e-12 and dist["s", s] - distance[s][c] < dist["c", c] - 1e-12:
                        dist["c", c], back["c", c], changed = dist["s", s] - distance[s][c], ("s", s), True
            if not changed:
                break
        end = min((s for s in room if room[s] > 1e-12), key=lambda s: dist["s", s], default=None)
        if end is None or dist["s", end] == float("inf"):
            return None
        path, at = [], ("s", end)
        while at in back:
            path.append((back[at], at))
            at = back[at]
        amount = min([left[at[1]], room[end], *[flow[b[1], a[1]] for a, b in path if a[0] == "s"]])
        for a, b in path:
            key = (a[1], b[1]) if a[0] == "c" else (b[1], a[1])
            flow[key] = flow.get(key, 0.0) + (amount if a[0] == "c" else -amount)
            cost += amount * distance[key[1]][key[0]] * (1 if a[0] == "c" else -1)
        left[at[1]] -= amount
        room[end] -= amount
    return cost, {k: v for k, v in flow.items() if v > 1e-12}


def facility_location(spark, demand: dict, capacity: dict, activation: dict, distance: dict) -> DataFrame:
    """(sites, cost) of every set of sites that can serve all demand: one row each, solved in parallel."""
    sites = sorted(capacity)
    subsets = spark.range(1, 1 << len(sites))

    def run(frames):
        for frame in frames:
            rows = []
            for bits in frame["id"]:
                used = [s for i, s in enumerate(sites) if bits >> i & 1]
                if (best := cheapest_transport(demand, {s: capacity[s] for s in used}, distance)) is not None:
                    rows.append((used, best[0] + sum(activation[s] for s in used)))
            yield pd.DataFrame(rows, columns=["sites", "cost"])

    return subsets.mapInPandas(run, "sites array<string>, cost double")
