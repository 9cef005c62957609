"""Dependencies between the jobs of a workflow, read off their start and end times.

Jobs are (workflow_id, job_id, start_ms, end_ms); edges are (workflow_id, src, dst, type, delay).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

FLOW = "workflow_id"
PRIORITY = {"delay": 1, "parallel": 2, "sequential": 3}
#: Jobs of a workflow in one block where all pairs are asked for.
BLOCK = 1_000


def spans(samples: DataFrame, time: str = "ts", order: str = "idx") -> DataFrame:
    """Start and end of each job: its first and last sample by position."""
    keys = [FLOW, "job_id"]
    return samples.groupBy(*keys).agg(F.min(F.struct(order, time))[time].alias("start_ms"), F.max(F.struct(order, time))[time].alias("end_ms"))


def ordered(jobs: DataFrame) -> DataFrame:
    """Jobs numbered by start, ties by id."""
    return jobs.withColumn("ord", F.row_number().over(Window.partitionBy(FLOW).orderBy("start_ms", "job_id")))


def _pairs(jobs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each two jobs of a workflow, dealt by blocks of its order, so that a workflow of any size is many tasks."""
    rows = ordered(jobs).withColumn("own", F.floor((F.col("ord") - 1) / block).cast("int"))
    last = F.max("own").over(Window.partitionBy(FLOW))
    side = lambda p: [F.col(c).alias(f"{p}_{c}") for c in ("job_id", "start_ms", "end_ms", "ord")]
    sized = rows.withColumn("last", last)
    first = sized.select(FLOW, *side("a"), F.col("own").alias("i"), F.explode(F.sequence("own", "last")).alias("j"))
    second = rows.select(FLOW, *side("b"), F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"))
    return first.join(second, [FLOW, "i", "j"]).where("a_ord < b_ord").drop("i", "j")


def _slack(jobs: DataFrame, threshold: float, width: int) -> DataFrame:
    """Ordered jobs with their slack and its scale: the power of two of ``width`` that holds twice the slack; and all
    ``scales`` of their workflow, no more than a time has bits."""
    slack = F.lit(threshold) * (F.col("end_ms") - F.col("start_ms"))
    scale = F.greatest(F.ceil(F.log2(F.greatest(2 * slack / F.lit(width), F.lit(1.0)))), F.lit(0)).cast("int")
    rows = ordered(jobs).withColumn("slack", slack).withColumn("scale", scale)
    return rows.withColumn("scales", F.collect_set("scale").over(Window.partitionBy(FLOW)))


def _around(rows: DataFrame, time: str, width: int) -> DataFrame:
    """Pairs (flow, src, dst, ord, a_start, a_end, slack, at) of jobs where the later one starts within the earlier
    one's slack around ``time``.

    An interval lies in two buckets of its scale at the most, however long it is; a start is shown once at each scale
    that its own workflow has.
    Both sides are sorted and merged: their sizes are taken for those of the jobs before rows are repeated, so that Spark
    would else broadcast them through the driver.
    """
    size = F.lit(width).cast("double") * F.pow(F.lit(2.0), F.col("scale"))
    spans = rows.select(FLOW, F.col("job_id").alias("src"), "ord", F.col("start_ms").alias("a_start"), F.col("end_ms").alias("a_end"), "slack", "scale", F.explode(F.sequence(
        F.floor((F.col(time) - F.col("slack")) / size), F.floor((F.col(time) + F.col("slack")) / size)
    )).alias("bucket"))
    starts = rows.select(FLOW, F.col("job_id").alias("dst"), F.col("start_ms").alias("at"), F.col("ord").alias("own"), F.explode("scales").alias("scale"))
    starts = starts.withColumn("bucket", F.floor(F.col("at") / size))
    near = F.col("at").between(F.col({"end_ms": "a_end", "start_ms": "a_start"}[time]) - F.col("slack"), F.col({"end_ms": "a_end", "start_ms": "a_start"}[time]) + F.col("slack"))
    return starts.join(spans.hint("merge"), [FLOW, "scale", "bucket"]).where(F.col("ord") < F.col("own")).where(near)


def near_edges(jobs: DataFrame, threshold: float = 0.1, width: int = 1_000) -> DataFrame:
    """The sequential and parallel edges of ``classify``, found by times, without the pairs that are neither."""
    rows = _slack(jobs, threshold, width)
    follows = _around(rows, "end_ms", width).withColumn("type", F.lit("sequential"))
    beside = _around(rows, "start_ms", width).withColumn("type", F.lit("parallel"))
    beside = beside.where(~F.col("at").between(F.col("a_end") - F.col("slack"), F.col("a_end") + F.col("slack")))
    return follows.unionByName(beside).select(FLOW, "src", "dst", "type", F.lit(None).cast("long").alias("delay"), "ord")


def incoming_delays(jobs: DataFrame, threshold: float = 0.1) -> DataFrame:
    """``incoming(classify(jobs), "delay")`` by counting: all earlier jobs but those that a job follows or runs beside."""
    near = near_edges(jobs, threshold).groupBy(FLOW, F.col("dst").alias("job_id")).agg(F.count(F.lit(1)).alias("near"))
    left = ordered(jobs).join(near, [FLOW, "job_id"], "left")
    n = (F.col("ord") - 1 - F.coalesce("near", F.lit(0))).cast("long")
    return left.select(FLOW, F.col("job_id").alias("dst"), n.alias("n")).where("n > 1")


def classify(jobs: DataFrame, threshold: float = 0.1) -> DataFrame:
    """An edge for each two jobs of a workflow, from the earlier: sequential, parallel, or delayed by the starts' difference."""
    slack = F.lit(threshold) * (F.col("a_end_ms") - F.col("a_start_ms"))
    near = lambda at: F.col("b_start_ms").between(F.col(at) - slack, F.col(at) + slack)
    kind = F.when(near("a_end_ms"), "sequential").when(near("a_start_ms"), "parallel").otherwise("delay")
    pairs = _pairs(jobs).withColumn("type", kind)
    delay = F.when(F.col("type") == "delay", F.col("b_start_ms") - F.col("a_start_ms"))
    return pairs.select(FLOW, F.col("a_job_id").alias("src"), F.col("b_job_id").alias("dst"), "type", delay.alias("delay"), F.col("a_ord").alias("ord"))


def classify_truncated(jobs: DataFrame, threshold: float = 0.1) -> DataFrame:
    """The older rules: whole bounds, half open, each of the tests by itself, delay from the end of one to the start of
    the next where neither holds."""
    slack = F.lit(threshold) * (F.col("a_end_ms") - F.col("a_start_ms"))
    whole = lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))
    near = lambda at: (F.col("b_start_ms") >= whole(F.col(at) - slack)) & (F.col("b_start_ms") < whole(F.col(at) + slack))
    kind = F.when(near("a_end_ms"), "sequential").when(near("a_start_ms"), "parallel").otherwise("delay")
    rows = _pairs(jobs).withColumn("type", kind).where((F.col("type") != "delay") | (F.col("b_start_ms") >= F.col("a_end_ms")))
    delay = F.when(F.col("type") == "delay", F.col("b_start_ms") - F.col("a_end_ms"))
    return rows.select(FLOW, F.col("a_job_id").alias("src"), F.col("b_job_id").alias("dst"), "type", delay.alias("delay"))


def incoming(edges: DataFrame, kind: str | None = None) -> DataFrame:
    """(workflow_id, dst, n) of the nodes with more than one incoming edge."""
    rows = edges if kind is None else edges.where(F.col("type") == kind)
    return rows.groupBy(FLOW, "dst").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def strongest(edges: DataFrame) -> DataFrame:
    """One incoming edge for each node: sequential before parallel before delay, the latest source of equal ones."""
    rank: Column = F.lit(0)
    for kind, p in PRIORITY.items():
        rank = F.when(F.col("type") == kind, p).otherwise(rank)
    nth = F.row_number().over(Window.partitionBy(FLOW, "dst").orderBy(rank.desc(), F.desc("ord")))
    return edges.withColumn("nth", nth).where("nth = 1").drop("nth", "ord")


def kept(jobs: DataFrame, threshold: float = 0.1, width: int = 1_000) -> DataFrame:
    """``strongest(classify(jobs))`` without all pairs of a workflow's jobs.

    The sources that a job follows or runs beside are found by the times around which it may start, in buckets of
    ``width`` times the power of two that fits a source's slack; a delay is always the one from the job before.
    """
    rows = _slack(jobs, threshold, width)
    latest = lambda time: _around(rows, time, width).groupBy(FLOW, "dst").agg(F.max(F.struct("ord", "src")).alias(time))
    before = Window.partitionBy(FLOW).orderBy("ord")
    each = rows.select(FLOW, F.col("job_id").alias("dst"), F.lag("job_id").over(before).alias("previous"), (F.col("start_ms") - F.lag("start_ms").over(before)).alias("gap"))
    each = each.join(latest("end_ms"), [FLOW, "dst"], "left").join(latest("start_ms"), [FLOW, "dst"], "left").where("previous is not null")
    kind = F.when(F.col("end_ms").isNotNull(), "sequential").when(F.col("start_ms").isNotNull(), "parallel").otherwise("delay")
    return each.select(FLOW, F.coalesce("end_ms.src", "start_ms.src", "previous").alias("src"), "dst", kind.alias("type"), F.when(kind == "delay", F.col("gap")).alias("delay"))


def reachable(edges: DataFrame, sources: DataFrame | None = None, most: int = 64) -> DataFrame:
    """Distinct (workflow_id, src, dst) that a path of edges joins; from ``sources`` (workflow_id, src) alone, if given.

    All paths double each round: only the paths that are new are joined with the ones known. Paths from given sources
    grow by an edge each round, and rounds are as many as the longest has edges. Joins are by job, so that a large
    workflow is split.
    """
    near = cut(edges.select(FLOW, "src", "dst").distinct())
    new = known = near if sources is None else cut(near.join(sources.select(FLOW, "src").distinct(), [FLOW, "src"]))
    rounds = most if sources is None else 1 << 20
    for _ in range(rounds):
        further = (known if sources is None else near).select(FLOW, F.col("src").alias("dst"), F.col("dst").alias("to"))
        longer = new.join(further, [FLOW, "dst"]).select(FLOW, "src", F.col("to").alias("dst")).distinct()
        new = cut(longer.join(known, [FLOW, "src", "dst"], "left_anti"))
        if not new.limit(1).count():
            return known
        known = cut(known.unionByName(new))
    raise RuntimeError("paths keep growing")


def without_reachable(edges: DataFrame, kind: str = "parallel", by: str = "sequential") -> DataFrame:
    """Edges of one type whose nodes no path of the other type joins; only paths from these edges' sources are followed."""
    asked = edges.where(F.col("type") == kind)
    paths = reachable(edges.where(F.col("type") == by), asked)
    return asked.join(paths, [FLOW, "src", "dst"], "left_anti")


def chains(edges: DataFrame, kinds: tuple[str, ...] = ("parallel", "delay"), most: int = 64) -> DataFrame:
    """(workflow_id, job_id, chain): jobs joined by edges of these types, by their smallest job.

    Each round joins a job's larger neighbours to the least one around it, then its smaller ones, until every job points
    at its chain's least. Joins are by job, so that a large workflow is split.
    """

    def pointed(rows: DataFrame) -> DataFrame:
        return rows.where("a <> b").select(FLOW, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def around(rows: DataFrame) -> DataFrame:
        return rows.groupBy(FLOW, "a").agg(F.min("b").alias("least"))

    state = cut(pointed(edges.where(F.col("type").isin(*kinds)).select(FLOW, F.col("src").alias("a"), F.col("dst").alias("b"))))
    for _ in range(most):
        both = state.unionByName(state.select(FLOW, F.col("b").alias("a"), F.col("a").alias("b")))
        least = around(both).withColumn("least", F.least("a", "least"))
        large = pointed(both.where("b > a").join(least, [FLOW, "a"]).select(FLOW, F.col("b").alias("a"), F.col("least").alias("b")))
        least = around(large)
        small = large.join(least, [FLOW, "a"]).select(FLOW, F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.withColumnRenamed("least", "b"))
        now = cut(pointed(small))
        if not now.exceptAll(state).limit(1).count() and now.count() == state.count():
            roots = now.select(FLOW, F.col("b").alias("job_id")).distinct()
            return now.select(FLOW, F.col("a").alias("job_id"), F.col("b").alias("chain")).unionByName(roots.withColumn("chain", F.col("job_id")))
        state = now
    raise RuntimeError("chains keep changing")


def external_predecessors(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(workflow_id, chain, src): sources of edges into a chain that lie outside it."""
    into = edges.join(members.withColumnRenamed("job_id", "dst"), [FLOW, "dst"])
    own = members.select(FLOW, F.col("job_id").alias("src"), F.col("chain").alias("own"))
    rows = into.join(own, [FLOW, "src"], "left").where(F.col("own").isNull() | (F.col("own") != F.col("chain")))
    return rows.select(FLOW, "chain", "src").distinct()


def necessary_delays(edges: DataFrame) -> DataFrame:
    """Delay edges that no other path makes redundant, the longest tried first.

    A delay that is the only edge into its job, or the only one out of it, is necessary, whatever the others are. Paths
    stay within jobs that edges join, so each such part that holds another delay is a group of its own.
    """
    rows = cut(edges.select(FLOW, "src", "dst", "type", "delay"))
    once = rows.select(FLOW, "src", "dst").distinct()
    into = once.groupBy(FLOW, "dst").agg(F.count(F.lit(1)).alias("into"))
    out = once.groupBy(FLOW, "src").agg(F.count(F.lit(1)).alias("out"))
    same = rows.groupBy(FLOW, "src", "dst").agg(F.count(F.lit(1)).alias("same"))  # edges beside it join the same two jobs
    known = rows.join(into, [FLOW, "dst"]).join(out, [FLOW, "src"]).join(same, [FLOW, "src", "dst"])
    known = cut(known.withColumn("alone", (F.col("type") == "delay") & (F.col("same") == 1) & ((F.col("into") == 1) | (F.col("out") == 1))))
    sure = known.where("alone").select(FLOW, "src", "dst", "delay")
    open_ = known.where("type = 'delay' and not alone")
    if not open_.limit(1).count():
        return sure
    parts = chains(rows, ("sequential", "parallel", "delay"))
    placed = known.join(parts.select(FLOW, F.col("job_id").alias("src"), "chain"), [FLOW, "src"])
    wanted = placed.where("type = 'delay' and not alone").select(FLOW, "chain").distinct()

    def run(part: pd.DataFrame) -> pd.DataFrame:
        others = {(a, b) for a, b, t in zip(part["src"], part["dst"], part["type"], strict=True) if t != "delay"}
        after: dict = {}
        for a, b in zip(part["src"], part["dst"], strict=True):
            after.setdefault(a, set()).add(b)
        rest = part[(part["type"] == "delay") & ~part["alone"]].sort_values(["delay", "src", "dst"], ascending=[False, True, True])
        kept = []
        for row in rest.itertuples():
            if (row.src, row.dst) not in others:
                after[row.src].discard(row.dst)
            seen, stack = set(), [row.src]
            while stack:
                at = stack.pop()
                for b in after.get(at, ()):
                    if b not in seen:
                        seen.add(b)
                        stack.append(b)
            if row.dst not in seen:
                kept.append(row.Index)
                after[row.src].add(row.dst)
        return part.loc[kept, [FLOW, "src", "dst", "delay"]]

    found = placed.join(wanted, [FLOW, "chain"], "left_semi").select(FLOW, "chain", "src", "dst", "type", "delay", "alone")
    return sure.unionByName(found.groupBy(FLOW, "chain").applyInPandas(run, f"{FLOW} long, src long, dst long, delay long"))


def schedule(jobs: DataFrame, edges: DataFrame, cumulative: bool = True, chosen: bool = False, most: int = 64) -> DataFrame:
    """(workflow_id, job_id, start_s, end_s): jobs start when their kept edge allows.

    Sequential jobs begin when the source ends, parallel ones with it, delayed ones a delay after its start - or after
    the chain's start, if not ``cumulative``. Jobs without an edge, or whose source isn't among the jobs, begin at 0.
    ``chosen`` edges are the kept ones already. Each job points at its source with the time between their starts; every
    round the pointers double, so rounds are few and joins are by job. Jobs whose sources lead in a circle begin at 0.
    """
    kept = (edges if chosen else strongest(edges)).select(FLOW, F.col("dst").alias("job_id"), "src", "type", "delay")
    lengths = jobs.select(FLOW, F.col("job_id").alias("src"), (F.col("end_ms") - F.col("start_ms")).alias("length"))
    rows = jobs.select(FLOW, "job_id").join(kept, [FLOW, "job_id"]).join(lengths, [FLOW, "src"])
    wait = F.when(F.col("type") == "sequential", F.col("length")).when(F.col("type") == "parallel", 0).otherwise(F.col("delay"))
    source = F.col("src") if cumulative else F.when(F.col("type") != "delay", F.col("src"))
    state = cut(rows.select(FLOW, "job_id", source.alias("source"), wait.cast("long").alias("wait")))
    for _ in range(most):
        if not state.where("source is not null").limit(1).count():
            break
        ahead = state.select(FLOW, F.col("job_id").alias("source"), F.col("source").alias("_source"), F.col("wait").alias("_wait"))
        met = state.join(ahead, [FLOW, "source"], "left")  # a source without an edge begins at 0
        state = cut(met.select(FLOW, "job_id", F.col("_source").alias("source"), (F.col("wait") + F.coalesce("_wait", F.lit(0))).alias("wait")))
    start = F.coalesce(F.when(F.col("source").isNull(), F.col("wait")), F.lit(0)) / 1000.0
    placed = jobs.join(state, [FLOW, "job_id"], "left").select(FLOW, "job_id", start.alias("start_s"), (F.col("end_ms") - F.col("start_ms")).alias("_length"))
    return placed.select(FLOW, "job_id", "start_s", (F.col("start_s") + F.col("_length") / 1000.0).alias("end_s"))
