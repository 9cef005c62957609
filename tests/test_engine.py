"""Mixed phases, placements, candidates by time, ranges and other operators against hand-made values and brute force."""

import json
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasewell.functions import scalar
from phasewell.operators import central, decompose, dependencies, joins, model, optimise, replay, signals
from phasewell.sources import files

HDD = {"read": 80e6, "write": 40e6}


def _app(read, write, use, **more):
    return {"name": "a", "compute": [0], "read": [read], "write": [write], "placement": ["hdd"], "use_bb": [use], **more}


def test_a_mixed_phase_through_a_buffer_waits_for_all():
    """Prefetch of 0.1 GB at 80 MB/s, then read, write and destage share the buffer; destaging 4 GB at 40 MB/s ends last."""
    app = {**_app(1e8, 4e9, True), "compute": [0, 10], "read": [1e8, 0], "write": [4e9, 0], "placement": ["hdd", "hdd"], "use_bb": [True, False]}
    log = replay.simulate([app], {"hdd": HDD, "bb": {"read": 400e6, "write": 400e6, "persistent": "hdd"}})
    ends = {kind: max(r["t_end"] for r in log if r["type"] == kind) for kind in ("read", "write", "movement", "compute")}
    # a third of 400 MB/s for the read from 1.25 s on; then half of it for the write
    assert ends["read"] == pytest.approx(2.0) and ends["write"] == pytest.approx(2.0 + 3.9e9 / 200e6)
    assert ends["movement"] == pytest.approx(1.25 + 100) and ends["compute"] == pytest.approx(101.25 + 10)
    assert min(r["t_start"] for r in log if r["type"] in ("read", "write")) == pytest.approx(1.25)


def test_a_mixed_phase_without_a_buffer():
    log = replay.simulate([_app(8e8, 4e8, False)], {"hdd": HDD})
    assert max(r["t_end"] for r in log) == pytest.approx(20)  # both at half of their bandwidth


def test_placements_are_all_ways(spark):
    apps = [{"name": n, "compute": [0, 1], "read": [4e8, 0], "write": [0, 2e8]} for n in "ab"]
    tiers = {"hdd": HDD, "ssd": {"read": 200e6, "write": 100e6}}
    trials = replay.placements(spark, apps, list(tiers), buffered=False)
    got = {r["trial_id"]: r["makespan"] for r in replay.objective(replay.contended(trials, tiers), ["trial_id"]).collect()}
    every = []
    for where in product(tiers, repeat=4):
        placed = [{**a, "placement": list(where[2 * i : 2 * i + 2]), "use_bb": [False, False]} for i, a in enumerate(apps)]
        log = [r for r in replay.simulate(placed, tiers) if r["type"] in ("read", "write", "compute")]
        every.append(max(r["t_end"] for r in log) - min(r["t_start"] for r in log))
    assert sorted(got.values()) == pytest.approx(sorted(every)) and len(got) == 16


def test_trials_with_tiers_of_their_own(spark):
    rows = [(i, json.dumps([_app(8e8, 0, False)]), json.dumps({"hdd": {"read": r, "write": 1.0}})) for i, r in enumerate((80e6, 160e6))]
    log = replay.contended(spark.createDataFrame(rows, "trial_id long, apps string, tiers string"), {})
    assert {r["trial_id"]: r["makespan"] for r in replay.makespan(log, ["trial_id"]).collect()} == {0: 10.0, 1: 5.0}


def test_cluster_use(spark):
    log = replay.contended(spark.createDataFrame([(1, json.dumps([_app(0, 4e8, True), {**_app(8e8, 0, False), "name": "b"}]))], "trial_id long, apps string"), {"hdd": HDD, "bb": {"read": 400e6, "write": 400e6, "persistent": "hdd"}})
    assert replay.cpu_curve(log, ["trial_id"]).orderBy("at").first()["total"] == 2
    assert replay.tier_percent(log, ["trial_id"], {"bb": 8e8}).agg(F.max("percent")).first()[0] == pytest.approx(50)


def test_kept_edges_equal_all_pairs(spark):
    rng = np.random.default_rng(7)
    rows = [(int(rng.integers(3)), i, int(a), int(a + rng.integers(0, 400))) for i, a in enumerate(rng.integers(0, 2_000, 120))]
    jobs = spark.createDataFrame(rows + [(9, 500, 5, 5)], "workflow_id long, job_id long, start_ms long, end_ms long")
    edges = lambda df: sorted((r["workflow_id"], r["src"], r["dst"], r["type"], r["delay"] or 0) for r in df.collect())
    assert edges(dependencies.kept(jobs, width=37)) == edges(dependencies.strongest(dependencies.classify(jobs)))
    assert dependencies.kept(jobs.limit(0)).count() == 0


def test_pareto_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(optimise, "RANGES", 5)
    rng = np.random.default_rng(8)
    points = [(i, int(a), int(b)) for i, (a, b) in enumerate(rng.integers(0, 60, (300, 2)))]
    front = {i for i, a, b in points if not any(c <= a and d <= b and (c < a or d < b) for _, c, d in points)}
    df = spark.createDataFrame(points, "i long, a long, b long")
    assert {r["i"] for r in optimise.pareto(df, "a", "b").collect()} == front
    assert optimise.pareto(df.where("i = 0"), "a", "b").count() == 1 and optimise.pareto(df.limit(0), "a", "b").count() == 0


def _labels_by_all_starts(values, threshold=0.01):
    """Clusters by trying every start of the last one, the last start on ties."""
    x, inverse, n = np.unique(np.asarray(values, float), return_inverse=True, return_counts=True)
    own = lambda i, j: (n[i:j] * (x[i:j] - (n[i:j] * x[i:j]).sum() / n[i:j].sum()) ** 2).sum()
    m, near = len(x), 1e-9 * max(own(0, len(x)), 1e-300)
    best, paths = [0.0] + [own(0, j) for j in range(1, m + 1)], [[] for _ in range(m + 1)]
    for k in range(2, m + 1):
        now, ways = [np.inf] * (m + 1), [[] for _ in range(m + 1)]
        for j in range(k, m + 1):
            costs = {i: best[i] + own(i, j) for i in range(k - 1, j)}
            i = max(i for i, c in costs.items() if c <= min(costs.values()) + near)
            now[j], ways[j] = costs[i], [*paths[i], i]
        best, paths = now, ways
        if (n * x)[: paths[m][0]].sum() / (n * x).sum() <= threshold:
            break
    return np.searchsorted(paths[m], np.arange(m), "right")[inverse].tolist()


def test_labels_are_those_of_all_starts():
    rng = np.random.default_rng(9)
    series = [rng.integers(0, top, 60) * (rng.random(60) < 0.7) for top in (3, 30, 3_000) for _ in range(5)]
    series += [np.repeat([0, 1, 2, 3], 5), np.arange(40), rng.gamma(2, size=80).round(3)]
    for s in series:
        assert decompose.optimal_labels(s).tolist() == _labels_by_all_starts(s)


def test_clusters_of_a_long_series(spark):
    """A million samples: Spark counts the values, the labels come back to each sample."""
    value = F.when(F.col("id") % 3 == 0, F.pmod(F.xxhash64("id"), F.lit(200_000)) + 1_000_000).otherwise(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(500)))
    df = spark.range(0, 1_000_000, 1, 8).select(F.lit(1).cast("long").alias("job_id"), F.col("id").cast("int").alias("idx"), value.alias("bytesRead"), F.lit(0).alias("bytesWritten"))
    labelled = decompose.adaptive_labels(df)
    got = labelled.groupBy((F.col("idx") % 3 == 0).alias("high")).agg(F.min("label_read").alias("a"), F.max("label_read").alias("b"), F.max("label_write").alias("w")).collect()
    assert {(r["high"], r["a"] > 0, r["w"]) for r in got} == {(True, True, 0), (False, False, 0)} and {r["b"] for r in got if not r["high"]} == {0}
    x = np.sort(np.random.default_rng(1).random(300_000)) ** 3
    starts = decompose.cluster_starts(x, np.ones(len(x), int), 0.01)
    assert x[x < starts[0]].sum() <= 0.01 * x.sum()


def test_clusters_of_few_values_and_found_once(spark, monkeypatch):
    """The table of costs gives the starts that the search gives, and a representation has no second search in its plan."""
    rng = np.random.default_rng(11)
    signals = [np.unique(rng.integers(0, top, n), return_counts=True) for top in (3, 20, 500) for n in (1, 2, 9, 120)] + [(np.arange(100), np.ones(100, int))]
    table = [decompose.cluster_starts(*s) for s in signals]
    monkeypatch.setattr(decompose, "LEAVES", 0)
    assert [t.tolist() for t in table] == [decompose.cluster_starts(*s).tolist() for s in signals]
    monkeypatch.undo()
    df = spark.range(40).select((F.col("id") % 2).alias("job_id"), F.floor(F.col("id") / 2).cast("int").alias("idx"), (F.col("id") % 7).alias("bytesRead"), (F.col("id") % 3).alias("bytesWritten"))
    plan = decompose.adaptive_representation(df)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan


def test_change_points_of_a_published_length():
    """A series of 1,526 samples, as the published times have."""
    rng = np.random.default_rng(10)
    levels = np.repeat(rng.integers(0, 50, 40), 39)[:1526] + rng.normal(0, 0.1, 1526)
    cuts = decompose.pelt(levels, 10.0)
    assert len(cuts) == len(set(np.flatnonzero(np.diff(np.round(levels)) != 0) // 39)) or 30 <= len(cuts) <= 40


def test_patterns_of_the_decomposition_have_a_column(spark):
    rows = [(1, 1.0, 1.0, "str", "seq", 1.0, 1.0), (2, 1.0, 1.0, "stride", "uncl", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "phase_id long, read_volume double, write_volume double, read_io_pattern string, write_io_pattern string, read_io_size double, write_io_size double")
    assert [r["cat__read_io_pattern_stride"] for r in model.design_matrix(df, ["phase_id"]).collect()] == [1.0, 1.0]
    with pytest.raises(Exception, match="unknown pattern null"):
        model.design_matrix(df.withColumn("read_io_pattern", F.lit(None).cast("string")), ["phase_id"]).collect()


def test_targets_and_bandwidths(spark):
    model.check_targets(["lfs_bw", "lfs_sbb_bw"], ["lfs", "nfs"])
    with pytest.raises(ValueError, match="sbb_bw"):
        model.check_targets(["sbb_bw"], ["lfs"])
    runs = spark.createDataFrame([(1, 10.0, 2.0), (1, 20.0, 4.0), (2, 5.0, 0.0)], "k long, v double, s double")
    assert {r["k"]: r["bandwidth"] for r in model.average_bandwidth(runs, ["k"], F.col("v"), F.col("s")).collect()} == {1: 5.0, 2: 0.0}
    x = spark.createDataFrame([(i, float(i % 7), 2.0 * (i % 7) + 1) for i in range(80)], "phase_id long, remainder__a double, lfs_bw double")
    assert model.cross_validated(x, "lfs_bw", "phase_id") == pytest.approx(1.0)
    tiers = spark.createDataFrame([("hdd", 2.0), ("ssd", 3.0)], "tier string, speed double")
    table = model.tier_table(runs.groupBy("k").agg(F.sum("v").alias("v")), tiers, "k", F.col("v") * F.col("speed"), ["hdd", "ssd"])
    assert {(r["k"], r["hdd"], r["ssd"]) for r in table.collect()} == {(1, 60.0, 90.0), (2, 10.0, 15.0)}


def test_series_helpers(spark):
    df = spark.createDataFrame([(1, 0, 10, 1, None), (1, 1, 15, 2, 3), (2, 0, 7, 4, 5)], "job_id long, idx int, t long, accessA long, accessB long")
    assert {r["job_id"]: r["step"] for r in signals.sampling_step(df, "t").collect()} == {1: 5, 2: None}
    assert [r["steps"] for r in signals.normalised_time(df, "t").orderBy("job_id", "idx").collect()] == [0.0, 1.0, 0.0]
    assert [r["all"] for r in signals.row_sum(df, "^access", "all").orderBy("job_id", "idx").collect()] == [1, 5, 9]
    long = spark.createDataFrame([(1, "x", 2.0), (2, "x", 4.0)], "job_id long, feature string, value double")
    assert central.with_centroid(long).where("job_id = -1").first()["value"] == 3.0
    points = spark.createDataFrame([(1, i) for i in (3, 7, 9)], "job_id long, idx long")
    assert [(r["s"], r["e"]) for r in decompose.alternating_phases(points).orderBy("s").collect()] == [(3, 7), (9, None)]
    values = spark.createDataFrame([(float(v),) for v in [0, 0, 1, 50, 51, 50, 0, 1, 49]], "v double")
    assert decompose.silhouette_clusters(values, "v", most=4)[0] == 2


def test_sources_without_a_query(spark, tmp_path):
    jobs = spark.createDataFrame([(i,) for i in range(20)], "job_id long")
    assert files.sample_jobs(jobs, 50).count() == 50 and files.sample_jobs(jobs, 3).count() == 3 and files.sample_jobs(jobs.limit(0), 3).count() == 0
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "volume.json").write_text('[{"timestamp": 5, "bytesRead": 1, "bytesWritten": 2}]')
    assert files.arrays_from_objects(spark, f"{tmp_path}/old", ["timestamp", "bytesRead", "bytesWritten"]).first()["value"] == "[[5,1,2]]"
    edges = spark.createDataFrame([(1, "a", "b", "delay", 5)], "workflow_id long, src string, dst string, type string, delay long")
    graph = json.loads(files.node_link_json(edges, "workflow_id").first()["value"])
    assert [n["id"] for n in graph["nodes"]] == ["a", "b"] and graph["links"][0]["delay"] == 5
    events = spark.createDataFrame([(1, 0, 5.0, 1.0, 0.0, 0.0, "Seq", "Uncl", 2, 0)], "job_id long, event long, read_volume double, read_bw double, write_volume double, write_bw double, read_pattern string, write_pattern string, read_operations long, write_operations long")
    assert json.loads(files.representation_json(events).first()["value"])["read_volumes"] == [5.0]
    for _ in range(2):
        files.write_features(edges, f"{tmp_path}/features")
    assert spark.read.option("header", True).csv(f"{tmp_path}/features").count() == 2
    assert files.available(edges, ["src", "no"]).columns == ["src"]
    with pytest.raises(ValueError, match="no"):
        files.available(edges, ["no"])
    row = files.experiment_rows(spark, [([0, 1, 0, 1], [0, 1], [1, 0], 102.5, 5e9)], 2).first()
    assert row["tier_0"] == 0 and row["use_bb_1"] == 0 and row["runtime"] == 102.5


def test_more_scalars(spark):
    one = spark.range(1)
    of = lambda c: one.select(c).first()[0]
    assert of(scalar.pattern_from_ratio(F.lit(0.6))) == "seq" and of(scalar.pattern_from_ratio(F.lit(0.5))) == "rand"
    assert of(F.unix_millis(scalar.from_millis(F.lit(1_500)))) == 1_500 and of(scalar.share(F.lit(1))) == pytest.approx(1.0)
    assert of(scalar.has_extension(F.lit("a.JSON"), ".json")) is False
    runs = spark.createDataFrame([("w", 1, 5), ("w", 2, 3), ("x", 3, 1)], "name string, id long, start_ms long")
    assert [r["id"] for r in central.latest_first(runs, "w").collect()] == [2, 1]
    log = spark.createDataFrame([(1, "a", "read", 0.0, 3.0), (1, "b", "write", 1.0, 9.0), (1, "b", "eviction", 0.0, 50.0)], "workflow_id long, app string, type string, t_start double, t_end double")
    assert replay.workflow_makespan(log).first()["makespan"] == 8.0
    spans = spark.createDataFrame([("a", "read", 0.0, 2.0, 5.0)], "app string, type string, t_start double, t_end double, bandwidth double")
    assert [(r["at"], r["read"]) for r in replay.signals_of_log(spans).orderBy("at").collect()] == [(0, 5.0), (1, 5.0)]
    assert joins.natural(runs, runs.select("id")).count() == 3


def test_one_sided_events(spark):
    """Levels are phases of their own, leading and closing points are empty, idle sides have their ends."""
    rows = [(1, i, v, lab, w, int(w > 0)) for i, (v, lab, w) in enumerate([(0, 0, 0), (5, 1, 0), (6, 1, 0), (50, 2, 3), (0, 0, 0)])] + [(2, 0, 0, 0, 4, 1)]
    df = spark.createDataFrame(rows, "job_id long, idx int, bytesRead long, r int, bytesWritten long, w int")
    got = sorted(tuple(r) for r in signals.one_sided(df, "bytesRead", "r").collect())
    assert got == [(1, 0, 0.0, 0.0), (1, 1, 11.0, 5.5), (1, 2, 50.0, 50.0), (1, 3, 0.0, 0.0), (2, 0, 0.0, 0.0)]
    assert [tuple(r)[1:3] for r in signals.one_sided(df.where("job_id = 1"), "bytesRead", "r", merged=True).orderBy("event").collect()] == [(0, 0.0), (1, 61.0), (2, 0.0)]
    both = {(r["job_id"], r["event"]): (r["read_volume"], r["write_volume"]) for r in signals.separate_representation(df, "r", "w").collect()}
    assert both == {(1, 0): (0, 0), (1, 1): (11, 0), (1, 2): (50, 0), (1, 3): (0, 3), (1, 4): (0, 0), (2, 0): (0, 4)}
    assert signals.sampled_more_than(df).count() == 5


def test_projections_and_containment(spark):
    df = spark.createDataFrame([(1, 5.0, 2.0, "seq", "rand", 1.0, 1.0)], "id long, read_volume double, write_volume double, read_io_pattern string, write_io_pattern string, read_io_size double, write_io_size double")
    assert model.only_features(df, ["id"]).columns == ["id", *model.FEATURES]
    with pytest.raises(ValueError):
        model.only_features(df.drop("read_io_size"), ["id"])
    assert joins.renamed(df, {"id": "key", "read_volume": "no"}, ("no", "write_volume")).columns == ["key", *df.columns[3:]]
    points = spark.createDataFrame([(0, 5, True), (1, 6, False), (3, 2, False), (5, 5, True), (-1, 2, False)], "s int, e int, yes boolean")
    assert all(r["got"] == r["yes"] for r in points.select("yes", joins.contained(F.col("s"), F.col("e"), F.lit(0), F.lit(5)).alias("got")).collect())


def test_training_table_and_tier_table_move_no_rows(spark, small):
    from phasewell.operators import model
    from phasewell.plans import tables

    phases = tables.phases(spark, small)
    whole = model.design_matrix(phases, ["phase_id"]).join(model.target_matrix(phases, ["phase_id"]), "phase_id")
    table = model.training_table(phases, ["phase_id"])
    assert sorted(map(tuple, table.select(whole.columns).collect())) == sorted(map(tuple, whole.collect()))
    tiers = spark.createDataFrame([("fast", 200.0)], "tier string, bandwidth double")
    timed = model.tier_table(phases, tiers, "phase_id", F.col("read_volume") / F.col("bandwidth"), ["fast", "none"])
    assert timed.columns == ["phase_id", "fast", "none"] and timed.where("fast is null or none is not null").count() == 0
    for made in (table, timed):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
