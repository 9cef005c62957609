"""One large workflow beside small ones: edges, paths, chains, delays and schedules against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasewell.operators import dependencies as deps


@pytest.fixture(scope="module")
def jobs(spark):
    """A hot workflow with jobs of all lengths, also without any, and two small ones."""
    rng = np.random.default_rng(12)
    rows = [(1, i, int(a), int(a + 10 ** rng.uniform(0, 6) * (rng.random() > 0.1))) for i, a in enumerate(rng.integers(0, 3_000_000, 150))]
    rows += [(2, 1, 5, 9), (3, 1, 0, 10), (3, 2, 10, 20), (3, 3, 10, 10)]
    return spark.createDataFrame(rows, "workflow_id long, job_id long, start_ms long, end_ms long").repartition(5).cache()


def _set(df, *names):
    rows = df.select(*names).collect()
    assert len(set(rows)) == len(rows)
    return set(rows)


def test_near_edges_and_counts_are_those_of_all_pairs(jobs):
    names = ("workflow_id", "src", "dst", "type", "ord")
    every = deps.classify(jobs).cache()
    assert _set(deps.near_edges(jobs), *names) == _set(every.where("type <> 'delay'"), *names) == _set(deps.near_edges(jobs, width=10_000_000), *names)
    counted = ("workflow_id", "dst", "n")
    assert _set(deps.incoming_delays(jobs), *counted) == _set(deps.incoming(every, "delay"), *counted)
    assert _set(deps.kept(jobs), "workflow_id", "src", "dst", "type", "delay") == _set(deps.strongest(every), "workflow_id", "src", "dst", "type", "delay")
    assert deps.near_edges(jobs.limit(0)).count() == deps.incoming_delays(jobs.limit(0)).count() == 0


def test_pairs_in_blocks(jobs):
    names = ("workflow_id", "a_job_id", "b_job_id")
    rows = deps.ordered(jobs).collect()
    expected = {(a["workflow_id"], a["job_id"], b["job_id"]) for a in rows for b in rows if a["workflow_id"] == b["workflow_id"] and a["ord"] < b["ord"]}
    for block in (7, 1_000):
        assert _set(deps._pairs(jobs, block), *names) == expected


@pytest.fixture(scope="module")
def edges(spark):
    rng = np.random.default_rng(13)
    rows = set()
    for flow, n, m in ((1, 40, 70), (2, 6, 9)):
        for _ in range(m):
            a, b = sorted(rng.choice(n, 2, replace=False).tolist())
            rows.add((flow, a, b, str(rng.choice(["sequential", "parallel", "delay"]))))
    rows = [(*r, int(rng.integers(1, 50)) if r[3] == "delay" else None) for r in sorted(rows)]
    return spark.createDataFrame(rows, "workflow_id long, src long, dst long, type string, delay long").cache()


def _closure(pairs):
    out = set(pairs)
    while more := {(w, a, d) for w, a, b in out for v, c, d in pairs if (v, c) == (w, b)} - out:
        out |= more
    return out


def test_paths(edges):
    pairs = {(r["workflow_id"], r["src"], r["dst"]) for r in edges.collect()}
    assert _set(deps.reachable(edges), "workflow_id", "src", "dst") == _closure(pairs)
    some = edges.where("src < 5")
    assert _set(deps.reachable(edges, some), "workflow_id", "src", "dst") == {p for p in _closure(pairs) if (p[0], p[1]) in {(r["workflow_id"], r["src"]) for r in some.collect()}}
    sequential = _closure({(r["workflow_id"], r["src"], r["dst"]) for r in edges.where("type = 'sequential'").collect()})
    parallel = {(r["workflow_id"], r["src"], r["dst"]) for r in edges.where("type = 'parallel'").collect()}
    assert _set(deps.without_reachable(edges), "workflow_id", "src", "dst") == parallel - sequential
    ring = edges.sparkSession.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 1)], "workflow_id long, src long, dst long")
    assert deps.reachable(ring).count() == 9 == deps.reachable(ring, ring).count()


def test_chains(edges):
    for kinds in (("parallel", "delay"), ("sequential",)):
        rows = [(r["workflow_id"], r["src"], r["dst"]) for r in edges.collect() if r["type"] in kinds]
        label = {(w, x): x for w, a, b in rows for x in (a, b)}
        for _ in label:
            for w, a, b in rows:
                label[w, a] = label[w, b] = min(label[w, a], label[w, b])
        assert _set(deps.chains(edges, kinds), "workflow_id", "job_id", "chain") == {(w, x, c) for (w, x), c in label.items()}
    line = edges.sparkSession.range(200).selectExpr("1L AS workflow_id", "id AS src", "id + 1 AS dst", "'delay' AS type")
    assert deps.chains(line).agg(F.max("chain"), F.count("*")).first() == (0, 201)


def test_necessary_delays(edges):
    """Whole workflows, the longest delay first, as the definition says."""
    expected = set()
    rows = edges.collect()
    for flow in {r["workflow_id"] for r in rows}:
        own = [(r["src"], r["dst"], r["type"], r["delay"]) for r in rows if r["workflow_id"] == flow]
        left = list(own)
        for row in sorted((r for r in own if r[2] == "delay"), key=lambda r: (-r[3], r[0], r[1])):
            rest = [r for r in left if r != row]
            if (0, row[0], row[1]) in _closure({(0, a, b) for a, b, _, _ in rest}):
                left = rest
            else:
                expected.add((flow, row[0], row[1], row[3]))
    assert _set(deps.necessary_delays(edges), "workflow_id", "src", "dst", "delay") == expected


@pytest.mark.parametrize("cumulative", [True, False])
def test_schedule(spark, jobs, cumulative):
    edges = deps.kept(jobs).cache()
    by = {(r["workflow_id"], r["dst"]): r for r in edges.collect()}
    length = {(r["workflow_id"], r["job_id"]): r["end_ms"] - r["start_ms"] for r in jobs.collect()}

    def start(w, j):
        e = by.get((w, j))
        if e is None:
            return 0
        if e["type"] == "delay":
            return e["delay"] + (start(w, e["src"]) if cumulative else 0)
        return start(w, e["src"]) + (length[w, e["src"]] if e["type"] == "sequential" else 0)

    for r in deps.schedule(jobs, edges, cumulative, chosen=True).collect():
        key = r["workflow_id"], r["job_id"]
        assert r["start_s"] == start(*key) / 1000 and r["end_s"] == pytest.approx((start(*key) + length[key]) / 1000)
    ring = spark.createDataFrame([(1, 1, 2, "parallel", None, 1), (1, 2, 1, "parallel", None, 2)], "workflow_id long, src long, dst long, type string, delay long, ord int")
    two = spark.createDataFrame([(1, 1, 0, 5), (1, 2, 3, 9)], "workflow_id long, job_id long, start_ms long, end_ms long")
    assert {r["start_s"] for r in deps.schedule(two, ring, most=4).collect()} == {0.0}


def test_repeated_rows_are_not_broadcast(spark, jobs, tmp_path):
    """A start stands once for each scale, which Spark's estimate of its side leaves out."""
    jobs.write.parquet(f"{tmp_path}/jobs")
    read = spark.read.parquet(f"{tmp_path}/jobs")
    for made in (deps.near_edges(read), deps.incoming_delays(read), deps.kept(read)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        joined = [line for line in plan.splitlines() if "Join" in line and "bucket" in line]
        assert joined and all("SortMergeJoin" in line for line in joined)


def test_starts_are_repeated_for_their_own_workflow_only(jobs):
    """However many scales other workflows have, a start stands once for each scale of its own."""
    rows = deps._slack(jobs, 0.1, 1_000).collect()
    for flow in (1, 2, 3):
        own = [r for r in rows if r["workflow_id"] == flow]
        assert own and all(sorted(r["scales"]) == sorted({r["scale"] for r in own}) for r in own)
    assert len({len(r["scales"]) for r in rows}) > 1
