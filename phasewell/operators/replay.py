"""Replay of applications against storage tiers.

Without contention the replay is arithmetic on columns. With it, one trial is an event loop: activities on a tier share
its bandwidth equally, and rates change when one begins or ends. An app holds its cores from its start to its end, first
in first out. A tier has slots; where more activities want them, those that wait go first whenever one begins or ends.
What fills a tier stops at its capacity, and a buffer above its high mark evicts clean data after each step. What waits
for cores or room that nothing frees is never finished. Trials are independent rows and spread with ``mapInPandas``.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import LOG


def uncontended(phases: DataFrame, read_bw: Column, write_bw: Column) -> DataFrame:
    """(app, i, type, t_start, t_end): each phase's read, then its write, then computing until the next event."""
    order = Window.partitionBy("app").orderBy("i")
    rows = phases.withColumn("gap", F.coalesce(F.lead("compute").over(order) - F.col("compute"), F.lit(0.0)))
    rows = rows.withColumn("read_s", F.col("read") / read_bw).withColumn("write_s", F.col("write") / write_bw)
    rows = rows.withColumn("whole", F.col("read_s") + F.col("write_s") + F.col("gap"))
    begin = F.coalesce(F.sum("whole").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) + F.first("compute").over(order)
    rows = rows.withColumn("t", begin)
    part = lambda kind, start, length: F.struct(F.lit(kind).alias("type"), start.alias("t_start"), (start + length).alias("t_end"), length.alias("length"))
    t, r, w = F.col("t"), F.col("read_s"), F.col("write_s")
    each = F.array(part("read", t, r), part("write", t + r, w), part("compute", t + r + w, F.col("gap")))
    return rows.select("app", "i", F.inline(each)).where("length > 0").drop("length")


def makespan(log: DataFrame, keys: list[str]) -> DataFrame:
    """From the first start to the last end of reads, writes and computing; 0 where there are none."""
    counted = F.col("type").isin("read", "write", "compute")
    span = F.max(F.when(counted, F.col("t_end"))) - F.min(F.when(counted, F.col("t_start")))
    return log.groupBy(*keys).agg(F.coalesce(span, F.lit(0.0)).alias("makespan"))


def workflow_makespan(log: DataFrame, key: str = "workflow_id") -> DataFrame:
    """The longest of a workflow's jobs' makespans."""
    return makespan(log, [key, "app"]).groupBy(key).agg(F.max("makespan").alias("makespan"))


def peak_buffer(log: DataFrame, keys: list[str]) -> DataFrame:
    """The highest level of tiers that aren't the cluster's own, the buffers."""
    outside = F.array_except(F.map_keys("tier_level"), "tiers")
    level = F.when(F.size(outside) > 0, F.array_max(F.transform(outside, lambda t: F.col("tier_level")[t])))
    return log.groupBy(*keys).agg(F.coalesce(F.max(level), F.lit(0.0)).alias("peak"))


def evicted(level: Column, dirty: Column, capacity: Column, high: float = 0.9, low: float = 0.7) -> Column:
    """What a buffer evicts: down to the low mark when above the high one, no more than is clean."""
    over = level > capacity * high
    return F.when(over, F.greatest(F.least(level - capacity * low, level - dirty), F.lit(0.0))).otherwise(0.0)


#: Activities that a tier serves at a time, and a buffer's marks: above the high one it evicts down to the low one.
SLOTS, HIGH, LOW = 10, 0.9, 0.7


@dataclass(eq=False)
class _Activity:
    """Something that moves a volume at the smallest of its tiers' shares."""

    app: str
    kind: str
    left: float
    uses: list[tuple[str, str]]  # tier, read or write
    then: object
    fills: str | None = None
    override: float | None = None
    source: str | None = None
    began: float = 0.0
    volume: float = 0.0
    erase: bool = False
    held: frozenset[str] = frozenset()  # tiers of which it has a slot

    @property
    def running(self) -> bool:
        return all(t in self.held for t, _ in self.uses)


@dataclass
class _Trial:
    tiers: dict[str, dict]
    own: list[str]
    cores: float = math.inf
    queue: list[tuple[int, object]] = field(default_factory=list)
    dirty: dict[str, float] = field(default_factory=dict)
    now: float = 0.0
    active: list[_Activity] = field(default_factory=list)
    timers: list[tuple[float, int, object]] = field(default_factory=list)
    level: dict[str, float] = field(default_factory=dict)
    log: list[dict] = field(default_factory=list)
    made: int = 0

    def at(self, time: float, then) -> None:
        self.made += 1
        self.timers.append((time, self.made, then))

    def begin(self, activity: _Activity) -> None:
        activity.began, activity.volume = self.now, activity.left
        if activity.left <= 0:
            activity.then()
            return
        if activity.kind == "read" and activity.fills:
            self.level[activity.fills] = max(self.level.get(activity.fills, 0.0), activity.left)
        self.active.append(activity)

    def request(self, cores: int, then) -> None:
        self.queue.append((cores, then))
        self.grant()

    def release(self, cores: int) -> None:
        self.cores += cores
        self.grant()

    def grant(self) -> None:
        """Cores for the apps at the head of the queue."""
        while self.queue and self.queue[0][0] <= self.cores:
            cores, then = self.queue.pop(0)
            self.cores -= cores
            then()

    def share(self) -> None:
        """Deal out the tiers' slots: those that wait first, then those that ran."""
        self.active.sort(key=lambda a: a.running)
        taken: dict[str, int] = {}
        for a in self.active:
            held = set()
            for t, _ in a.uses:
                if taken.get(t, 0) < self.tiers[t].get("slots", SLOTS):
                    taken[t] = taken.get(t, 0) + 1
                    held.add(t)
            a.held = frozenset(held)

    def count(self, tier: str) -> int:
        return sum(tier in a.held for a in self.active)

    def room(self, tier: str) -> float:
        capacity = self.tiers[tier].get("capacity", math.inf)
        room = capacity - self.level.get(tier, 0.0)
        return room if room > 1e-9 * capacity or math.isinf(room) else 0.0

    def rate(self, a: _Activity) -> float:
        if not a.running or a.kind != "read" and a.fills and not self.room(a.fills):
            return 0.0
        if a.override:
            return a.override
        return min(self.tiers[t][op] / self.count(t) for t, op in a.uses)

    def step(self, rates: list[float]) -> float:
        """Until an activity ends or a timer is due, a tier is full, or a full buffer has enough clean data to evict."""
        step = min((a.left / r for a, r in zip(self.active, rates, strict=True) if r), default=math.inf)
        if self.timers:
            step = min(step, max(0.0, self.timers[0][0] - self.now))
        for tier, x in self.tiers.items():
            filling = sum(r for a, r in zip(self.active, rates, strict=True) if a.fills == tier and a.kind != "read")
            if filling:
                step = min(step, self.room(tier) / filling)
            cleaning = sum(r for a, r in zip(self.active, rates, strict=True) if a.source == tier)
            spare = self.dirty.get(tier, 0.0) - LOW * x.get("capacity", math.inf)
            if cleaning and spare > 1e-9 and not self.room(tier):
                step = min(step, spare / cleaning)
        return step

    def apply(self, a: _Activity, moved: float) -> None:
        """Levels and dirty data after a part of an activity."""
        level = lambda t: self.level.get(t, 0.0)
        a.left -= moved
        if a.kind == "read":
            return
        if a.kind == "movement":
            self.level[a.source] = max(level(a.source), moved)
            if self.tiers[a.source].get("persistent"):
                self.dirty[a.source] = max(0.0, self.dirty.get(a.source, 0.0) - moved)
        self.level[a.fills] = level(a.fills) + moved
        if a.kind == "write" and self.tiers[a.fills].get("persistent"):
            self.dirty[a.fills] = self.dirty.get(a.fills, 0.0) + moved
        if a.erase:
            self.level[a.source] -= moved

    def evict(self, a: _Activity) -> None:
        buffer = a.source if a.kind == "movement" else a.uses[0][0]
        if not self.tiers[buffer].get("persistent"):
            return
        capacity, level = self.tiers[buffer].get("capacity", math.inf), self.level.get(buffer, 0.0)
        volume = min(level - LOW * capacity, level - self.dirty.get(buffer, 0.0)) if level > HIGH * capacity else 0.0
        if volume > 1e-9 * level:
            before = dict(self.level)
            self.level[buffer] = level - volume
            self.note(a, self.now, volume, math.inf, before, "eviction")

    def note(self, a: _Activity, start: float, moved: float, rate: float, before: dict, kind: str | None = None) -> None:
        self.log.append({
            "app": a.app, "type": kind or a.kind, "cpu_usage": 0 if a.kind == "movement" else 1, "t_start": start, "t_end": self.now, "bandwidth_concurrency": max(self.count(t) for t, _ in a.uses),
            "bandwidth": rate / 1e6, "phase_duration": self.now - start, "volume": moved, "tiers": self.own,
            "data_placement": {"placement": a.uses[-1][0], "source": a.source}, "init_level": before, "tier_level": dict(self.level),
        })

    def compute(self, app: str, start: float, end: float) -> None:
        self.log.append({
            "app": app, "type": "compute", "cpu_usage": 1, "t_start": start, "t_end": end, "bandwidth_concurrency": 0, "bandwidth": 0.0, "phase_duration": end - start, "volume": 0.0,
            "tiers": self.own, "data_placement": None, "init_level": dict(self.level), "tier_level": dict(self.level),
        })

    def run(self) -> None:
        changed = True
        while self.active or self.timers:
            self.timers.sort(key=lambda x: x[:2])
            if changed:
                self.share()
            rates = [self.rate(a) for a in self.active]
            step = self.step(rates)
            if math.isinf(step):
                break  # all wait for room
            start, before = self.now, dict(self.level)
            self.now += step
            ran = [(a, r) for a, r in zip(self.active, rates, strict=True) if r]
            done = [a for a, r in ran if a.left / r <= step * (1 + 1e-12)]
            if step > 0:
                for a, r in ran:
                    self.apply(a, min(a.left, r * step))
                for a, r in ran:
                    self.note(a, start, r * step, r, before)
                for a, _ in ran:
                    self.evict(a)
            self.active = [a for a in self.active if a not in done]
            due = [t for t in self.timers if t[0] <= self.now + 1e-12]
            self.timers = [t for t in self.timers if t not in due]
            held = len(self.active)
            for a in done:
                a.then()
            for _, _, then in due:
                then()
            changed = bool(done) or len(self.active) > held


def simulate(apps: list[dict], tiers: dict[str, dict], cores: int | None = None) -> list[dict]:
    """The log of one trial.

    An app has a name, a start, lists compute, read and write of equal length, and placements: for each phase's I/O the
    tier, whether a buffer is used, and optional bandwidths; optionally its cores, one number or one for each phase, of
    which it holds the largest, and ``erase``, whether destaging takes data out of the buffer. A tier has read and write
    bandwidths in bytes a second, optionally a capacity and slots; a buffer also names its persistent tier. Reads through a
    buffer are prefetched, then read from it; writes go to it while they are destaged. A pure write waits for the first of
    the two; a phase that reads and writes first prefetches, then waits for the read, the write and the destaging.
    """
    buffers = {t for t, x in tiers.items() if x.get("persistent")}
    trial = _Trial(tiers, [t for t in tiers if t not in buffers], math.inf if cores is None else cores)
    buffer = next(iter(buffers), None)

    def wanted(app: dict) -> int:
        held = app.get("cores", 1)
        return max(held, default=0) if isinstance(held, list) else held

    def play(app: dict, i: int) -> None:
        if i == len(app["compute"]):
            trial.release(wanted(app))
            return
        tier, use = app["placement"][i], app["use_bb"][i] and buffer is not None
        read, write = app["read"][i], app["write"][i]
        override = lambda side: (app.get(f"{side}_bw") or [None] * (i + 1))[i] or (app.get("bw") or [None] * (i + 1))[i]
        mixed = use and read > 0 and write > 0
        waits = 3 if mixed else (read > 0) + (write > 0)

        def after_io() -> None:
            gap = app["compute"][i + 1] - app["compute"][i] if i + 1 < len(app["compute"]) else 0
            if gap > 0:
                trial.compute(app["name"], trial.now, trial.now + gap)
            trial.at(trial.now + gap, lambda: play(app, i + 1))

        def part_done() -> None:
            nonlocal waits
            waits -= 1
            if waits == 0:
                after_io()

        def through(then) -> None:
            """Write to the buffer while it is destaged."""
            below = tiers[buffer]["persistent"]
            trial.begin(_Activity(app["name"], "write", write, [(buffer, "write")], then, buffer, override("write")))
            trial.begin(_Activity(app["name"], "movement", write, [(buffer, "read"), (below, "write")], then, below, source=buffer, erase=bool(app.get("erase"))))

        if not waits:
            after_io()
            return
        if read > 0:
            def direct(where=tier, fills=None):
                trial.begin(_Activity(app["name"], "read", read, [(where, "read")], part_done, fills or where, override("read")))

            def fetched():
                direct(buffer, buffer)
                if mixed:
                    through(part_done)

            if use:
                trial.begin(_Activity(app["name"], "movement", read, [(tier, "read"), (buffer, "write")], fetched, buffer, source=tier))
            else:
                direct()
        if write > 0:
            if mixed:
                pass  # once the read is fetched
            elif use:
                ended = [False]

                def first() -> None:
                    if not ended[0]:
                        ended[0] = True
                        part_done()

                through(first)
            else:
                trial.begin(_Activity(app["name"], "write", write, [(tier, "write")], part_done, tier, override("write")))

    for app in apps:
        first = lambda a=app: trial.at(trial.now + (a["compute"][0] if a["compute"] else 0.0), lambda: play(a, 0))
        trial.at(app.get("start", 0.0), lambda a=app, then=first: trial.request(wanted(a), then))
    trial.run()
    return trial.log


def contended(trials: DataFrame, tiers: dict[str, dict], cores: int | None = None) -> DataFrame:
    """LOG rows of each trial: rows of trial_id, ``apps``, the applications as JSON, and optionally ``tiers``, a trial's own."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.strip().split()[0] for f in LOG.replace("STRUCT<placement: STRING, source: STRING>", "S").replace("MAP<STRING, DOUBLE>", "M").split(",")]
        for frame in frames:
            for row in frame.itertuples():
                own = getattr(row, "tiers", None)
                log = pd.DataFrame(simulate(json.loads(row.apps), json.loads(own) if own else tiers, cores))
                if len(log):
                    log.insert(0, "trial_id", row.trial_id)
                    yield log[names]

    return trials.mapInPandas(run, LOG)


def cpu_curve(log: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, at, total): cores in use at each time when a row of the log begins or ends."""
    from .joins import running_total

    return running_total(log, keys, "t_start", "t_end", F.col("cpu_usage"))


def tier_percent(log: DataFrame, keys: list[str], capacity: dict[str, float]) -> DataFrame:
    """(keys, tier, at, percent): how full each tier with a capacity is at the beginning and the end of each row."""
    ends = F.array(F.struct(F.col("t_start").alias("at"), F.col("init_level").alias("level")), F.struct(F.col("t_end").alias("at"), F.col("tier_level").alias("level")))
    rows = log.select(*keys, F.inline(ends)).select(*keys, "at", F.explode("level").alias("tier", "held"))
    known = F.create_map(*[F.lit(x) for pair in capacity.items() for x in pair])
    share = F.try_divide(F.col("held") * 100, F.try_element_at(known, F.col("tier")))
    return rows.withColumn("percent", share).where("percent is not null").groupBy(*keys, "tier", "at").agg(F.max("percent").alias("percent"))


def placements(spark, apps: list[dict], tiers: list[str], buffered: bool = True) -> DataFrame:
    """(trial_id, apps): a trial for each way to place the apps' phases on tiers, with and without the buffer."""
    ways = [(t, b) for t in tiers for b in ((False, True) if buffered else (False,))]
    slots = [(a, i) for a, app in enumerate(apps) for i in range(len(app["compute"])) if app["read"][i] > 0 or app["write"][i] > 0]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for trial in frame["id"].tolist():
                placed, left = json.loads(json.dumps(apps)), trial
                for app in placed:
                    app["placement"], app["use_bb"] = [tiers[0]] * len(app["compute"]), [False] * len(app["compute"])
                for a, i in slots:
                    placed[a]["placement"][i], placed[a]["use_bb"][i] = ways[left % len(ways)]
                    left //= len(ways)
                out.append((trial, json.dumps(placed)))
            yield pd.DataFrame(out, columns=["trial_id", "apps"])

    return spark.range(len(ways) ** len(slots)).mapInPandas(run, "trial_id long, apps string")


def objective(log: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, makespan, peak): what a placement is judged by."""
    return makespan(log, keys).join(peak_buffer(log, keys), keys)


def signals_of_log(log: DataFrame, step: float = 1.0) -> DataFrame:
    """(app, at, read, write): bandwidth of each app's reads and writes at each tick that an interval holds."""
    rows = log.where(F.col("type").isin("read", "write") & (F.col("t_end") > F.col("t_start")))
    ticks = rows.withColumn("at", F.explode(F.sequence(F.ceil(F.col("t_start") / step), F.greatest(F.ceil(F.col("t_start") / step), F.ceil(F.col("t_end") / step) - 1))))
    value = lambda kind: F.sum(F.when(F.col("type") == kind, F.col("bandwidth")).otherwise(0.0)).alias(kind)
    return ticks.groupBy("app", "at").agg(value("read"), value("write"))


def _rates(log: DataFrame) -> DataFrame:
    """Reads, writes and computing of a log with their bandwidth on either side."""
    rate = lambda kind: F.when(F.col("type") == kind, F.col("bandwidth")).otherwise(0.0).alias(f"{kind}_bw")
    return log.where(F.col("type").isin("read", "write", "compute")).select("app", "type", "t_start", "t_end", rate("read"), rate("write"))


def signal_of_ends(log: DataFrame) -> DataFrame:
    """(app, at, read_bw, write_bw): each phase as a point at its end, and a zero point at 0."""
    rows = _rates(log)
    zero = rows.select("app").distinct().select("app", F.lit(0.0).alias("at"), F.lit(0.0).alias("read_bw"), F.lit(0.0).alias("write_bw"))
    return zero.unionByName(rows.select("app", F.col("t_end").alias("at"), "read_bw", "write_bw"))


def signal_of_ticks(log: DataFrame) -> DataFrame:
    """(app, at, read_bw, write_bw) at whole seconds; an I/O phase after computing after another comes a tick earlier for
    each such sequence so far, and takes the place of the computing's last tick."""
    order = Window.partitionBy("app").orderBy("t_start", "t_end", "type")
    io = F.col("type") != "compute"
    rows = _rates(log).withColumn("io", io)
    joined = F.col("io") & ~F.lag("io", 1, True).over(order) & F.lag("io", 2, False).over(order)
    rows = rows.withColumn("joined", joined.cast("int"))
    rows = rows.withColumn("excess", F.sum("joined").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("replaced", F.coalesce(F.lead("joined").over(order), F.lit(0)))
    first = (F.col("t_start") - F.col("excess")).cast("long")
    last = (F.col("t_end") - F.col("excess")).cast("long") - 1 - F.when(F.col("io"), 0).otherwise(F.col("replaced"))
    return rows.withColumn("first", first).withColumn("last", last).where("last >= first").select("app", F.explode(F.sequence("first", "last")).alias("at"), "read_bw", "write_bw")


def signal_of_points(log: DataFrame, points: int | None = None) -> DataFrame:
    """(app, at, read_bw, write_bw) at evenly spaced points from each app's first start to its last end: the latest
    phase that holds a point with a positive bandwidth."""
    from .joins import last_positive

    rows = _rates(log).withColumnsRenamed({"app": "k", "t_start": "s", "t_end": "e"})
    span = rows.groupBy("k").agg(F.min("s").alias("lo"), F.max("e").alias("hi"))
    n = F.lit(points) if points else F.floor(F.col("hi") - F.col("lo")) + 1
    grid = span.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    grid = grid.select("k", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / F.greatest(F.col("n") - 1, F.lit(1))).alias("at"))
    read, write = (last_positive(grid, rows.select("k", "s", "e", c), "k", c, 64) for c in ("read_bw", "write_bw"))
    return read.join(write, ["k", "at"]).withColumnRenamed("k", "app")
