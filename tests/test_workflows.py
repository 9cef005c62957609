"""Dependencies, replay, models, joins and scalar functions against known values."""

import json

import pytest
from pyspark.sql import functions as F

from phasewell.functions import scalar
from phasewell.operators import central, dependencies, joins, model, optimise, replay
from phasewell.sources import files


def _jobs(spark, *spans):
    return spark.createDataFrame([(1, i + 1, a, b) for i, (a, b) in enumerate(spans)], "workflow_id long, job_id long, start_ms long, end_ms long")


def _edges(df):
    return sorted((r["src"], r["dst"], r["type"], r["delay"]) for r in df.collect())


def test_dependencies(spark):
    jobs = _jobs(spark, (1000, 2000), (1050, 3000), (3000, 5300))
    assert _edges(dependencies.strongest(dependencies.classify(jobs))) == [(1, 2, "parallel", None), (2, 3, "sequential", None)]
    jobs = _jobs(spark, (1000, 1950), (1900, 3000), (3000, 4000))
    assert [e for e in _edges(dependencies.classify_truncated(jobs)) if e[2] == "sequential"] == [(1, 2, "sequential", None), (2, 3, "sequential", None)]
    jobs = _jobs(spark, (1000, 2000), (1900, 3000), (5000, 7000))
    assert {(1, 2, "sequential", None), (2, 3, "delay", 2000)} <= set(_edges(dependencies.classify_truncated(jobs)))
    jobs = _jobs(spark, (0, 100_000), (200_000, 300_000), (325_000, 400_000))
    assert (1, 2, "delay", 200_000) in _edges(dependencies.classify(jobs))


def test_paths_chains_and_schedule(spark):
    edges = spark.createDataFrame([(1, 1, 2, "sequential", None, 1), (1, 2, 3, "sequential", None, 2), (1, 1, 3, "parallel", None, 1), (1, 4, 5, "parallel", None, 4), (1, 3, 4, "delay", 5000, 3)], "workflow_id long, src long, dst long, type string, delay long, ord int")
    assert (1, 5) in {(r["src"], r["dst"]) for r in dependencies.reachable(edges).collect()}
    assert _edges(dependencies.without_reachable(edges).select("src", "dst", "type", "delay")) == [(4, 5, "parallel", None)]
    assert {r["job_id"]: r["chain"] for r in dependencies.chains(edges).collect()} == {1: 1, 3: 1, 4: 1, 5: 1}
    assert {(r["chain"], r["src"]) for r in dependencies.external_predecessors(edges, dependencies.chains(edges)).collect()} == {(1, 2)}
    assert [(r["src"], r["dst"]) for r in dependencies.necessary_delays(edges).collect()] == [(3, 4)]
    jobs = _jobs(spark, (0, 1000), (1000, 3000), (3000, 4000), (8000, 9000), (8000, 9500))
    got = {r["job_id"]: (r["start_s"], r["end_s"]) for r in dependencies.schedule(jobs, edges).collect()}
    assert got == {1: (0, 1), 2: (1, 3), 3: (3, 4), 4: (8, 9), 5: (8, 9.5)}


HDD, BUFFER = {"read": 80e6, "write": 40e6}, {"read": 400e6, "write": 400e6, "persistent": "hdd"}


def _app(bb=(False, False), **more):
    return {"name": "a", "compute": [0, 10], "read": [1e9, 0], "write": [0, 5e9], "placement": ["hdd", "hdd"], "use_bb": list(bb)} | more


def _span(log):
    counted = [r for r in log if r["type"] in ("read", "write", "compute")]
    return max(r["t_end"] for r in counted) - min(r["t_start"] for r in counted)


@pytest.mark.parametrize(
    ("app", "buffer", "span"),
    [(_app(), BUFFER, 147.5), (_app((False, True)), BUFFER, 47.5), (_app(bw=[100e6, 100e6]), BUFFER, 70.0), (_app((True, False)), {**BUFFER, "read": 800e6, "write": 800e6}, 136.25)],
)
def test_contended_replay(app, buffer, span):
    log = replay.simulate([app], {"hdd": HDD, "bb": buffer})
    assert abs(_span(log) - span) < 1e-6


def test_buffer_peak_and_sharing(spark):
    apps = [_app((False, True)), _app((False, True), name="b", start=2.0)]
    log = replay.simulate(apps, {"hdd": HDD, "bb": BUFFER})
    assert abs(max(r["tier_level"].get("bb", 0) for r in log) - 10e9) < 1
    both = replay.simulate([{**_app(), "name": n, "compute": [0], "read": [1e9], "write": [0], "placement": ["hdd"], "use_bb": [False], "start": s} for n, s in (("a", 0.0), ("b", 5.0))], {"hdd": HDD})
    assert [r["bandwidth_concurrency"] for r in both if r["app"] == "a"] == [1, 2]
    trials = spark.createDataFrame([(7, json.dumps(apps))], "trial_id long, apps string")
    got = replay.contended(trials, {"hdd": HDD, "bb": BUFFER})
    assert abs(replay.peak_buffer(got, ["trial_id"]).first()["peak"] - 10e9) < 1


def _one(name="a", read=0.0, write=0.0, use=False, **more):
    return {"name": name, "compute": [0], "read": [read], "write": [write], "placement": ["hdd"], "use_bb": [use], **more}


def test_apps_wait_for_cores():
    apps = [_one("a", 8e8, cores=2), _one("b", 8e8, cores=[1, 3]), _one("c", 8e8, cores=1)]
    spans = {r["app"]: (r["t_start"], r["t_end"]) for r in replay.simulate(apps, {"hdd": {"read": 80e6, "write": 40e6}}, cores=3)}
    assert spans == {"a": (0, 10), "b": (10, 20), "c": (20, 30)}  # first in first out: c's core is free, but b is before it


def test_a_tier_has_ten_slots():
    log = replay.simulate([_one(f"a{i}", 8e8) for i in range(11)], {"hdd": {"read": 80e6, "write": 40e6}})
    assert max(r["bandwidth_concurrency"] for r in log) == 10
    assert {r["app"] for r in log if r["t_start"] == 0} == {f"a{i}" for i in range(10)}
    assert sum(r["volume"] for r in log) == pytest.approx(11 * 8e8) and max(r["t_end"] for r in log) == pytest.approx(110)


def test_a_full_buffer_evicts_clean_data():
    tiers = {"hdd": {"read": 80e6, "write": 40e6}, "bb": {"read": 800e6, "write": 400e6, "persistent": "hdd", "capacity": 10e9}}
    log = replay.simulate([_one(write=12e9, use=True)], tiers)
    evicted = [(r["t_end"], r["volume"], r["tier_level"]["bb"]) for r in log if r["type"] == "eviction"]
    # 200 MB/s come in and 40 MB/s become clean: full after 50 s with 2 GB clean, full again after 60 s with 0.4 GB
    assert [pytest.approx(e) for e in evicted[:2]] == [(50, 2e9, 8e9), (60, 0.4e9, 9.6e9)]
    assert max(r["t_end"] for r in log if r["type"] == "write") == pytest.approx(60)
    assert max(r["tier_level"]["bb"] for r in log) <= 10e9 * (1 + 1e-9) and log[-1]["tier_level"]["hdd"] == pytest.approx(12e9)
    full = replay.simulate([_one(write=12e9)], {"hdd": {"read": 80e6, "write": 40e6, "capacity": 10e9}})
    assert sum(r["volume"] for r in full) == pytest.approx(10e9)
    erased = replay.simulate([_one(write=4e9, use=True, erase=True)], tiers)
    assert erased[-1]["tier_level"]["bb"] == pytest.approx(0, abs=1)


def test_uncontended_equals_the_event_loop(spark):
    rows = [("a", 0, 0.0, 1e9, 0.0), ("a", 1, 10.0, 0.0, 5e9), ("b", 0, 0.0, 2e9, 1e9)]
    df = spark.createDataFrame(rows, "app string, i int, compute double, read double, write double")
    got = {r["app"]: r["makespan"] for r in replay.makespan(replay.uncontended(df, F.lit(80e6), F.lit(40e6)), ["app"]).collect()}
    assert got["a"] == pytest.approx(147.5)


def test_eviction(spark):
    rows = [(9.5e9, 5e9, 2.5e9), (9.5e9, 9.5e9, 0.0), (9.5e9, 8e9, 1.5e9), (7.5e9, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "level double, dirty double, wanted double")
    assert all(r[0] == r["wanted"] for r in df.select(replay.evicted(F.col("level"), F.col("dirty"), F.lit(10e9)), "wanted").collect())


def test_interval_joins(spark):
    points = spark.createDataFrame([(1, i) for i in range(30)], "k long, at long")
    spans = spark.createDataFrame([(1, 0, 20, 105), (1, 0, 20, 0), (1, 20, 30, 0)], "k long, s long, e long, v long")
    assert [r["v"] for r in joins.last_positive(points, spans, "k", "v", 4).orderBy("at").collect()] == [105] * 20 + [0] * 10
    total = joins.running_total(spans.where("v > 0"), ["k"], "s", "e", F.col("v"))
    assert [(r["at"], r["total"]) for r in total.orderBy("at").collect()] == [(0, 105), (20, 0)]
    grid = joins.on_grid(points.withColumn("v", F.lit(2)).where("at % 4 = 0"), "at", ["v"], 2, ["k"])
    assert grid.count() == 15 and grid.agg(F.sum("v")).first()[0] == 16


def test_scalar_functions(spark):
    one = spark.range(1)
    of = lambda c: one.select(c).first()[0]
    assert [of(scalar.convert_size(F.lit(x))) for x in (0, 1, 1000, 1_500_000, 10**9)] == ["0B", "1.0 B", "1.0 KB", "1.5 MB", "1.0 GB"]
    assert [of(scalar.snake_case(F.lit(x))) for x in ("CamelCase", "Camel", "C")] == ["camel_case", "camel", "c"]
    assert of(scalar.parse_elapsed(F.lit("real 1m2.345s"))) == pytest.approx(62.345) and of(scalar.parse_elapsed(F.lit("0m5.3s"))) == pytest.approx(5.003)
    assert of(scalar.pattern_of(F.lit("accessSeqRead"))) == "Seq" and of(scalar.model_pattern(F.lit("Str"))) == "stride"
    assert of(scalar.model_name(F.lit("LinearRegression"))) == "linear_regression" and of(scalar.upper_at(F.lit("abc"), [0, 2])) == "AbC"
    assert of(optimise.padded(F.array(F.lit(1), F.lit(2)), F.lit(4))) == [1, 2, 2, 2]


def test_model(spark):
    rows = [(i, float(i % 3 * 100), float(i % 2 * 50), "seq", "uncl", 10.0 + i % 7, 20.0, float(i % 3 + 1) * 10) for i in range(60)]
    df = spark.createDataFrame(rows, "phase_id long, read_volume double, write_volume double, read_io_pattern string, write_io_pattern string, read_io_size double, write_io_size double, lfs_bw double")
    x = model.design_matrix(df, ["phase_id"])
    assert len(x.columns) == 1 + 8 + 6 and x.columns[1] == "cat__read_io_pattern_uncl"
    with_y = x.join(model.target_matrix(df, ["phase_id"]), "phase_id")
    out = model.predict(with_y, {"lfs_bw": model.train(with_y, "lfs_bw", "tree")}, ["phase_id"])
    idle = {r[0] for r in df.where("read_volume = 0 and write_volume = 0").select("phase_id").collect()}
    assert idle and all(r["lfs_bw"] == 0 for r in out.collect() if r["phase_id"] in idle)
    with pytest.raises(Exception, match="unknown pattern"):
        model.design_matrix(df.withColumn("read_io_pattern", F.lit("odd")), ["phase_id"]).collect()


def test_central_job_and_hull(spark):
    rows = [(j, i, [0, 10, 20][j % 3] + i) for j in range(9) for i in range(8)]
    long = central.features(spark.createDataFrame(rows, "job_id long, idx int, v long"), ["v"])
    assert long.select("feature").distinct().count() == 23
    assert central.central_job(central.scaled(long)).first()["job_id"] == 1
    points = spark.createDataFrame([("k", x, y) for x, y in [(0.0, 0.0), (1.0, 2.0), (2.0, 0.5), (3.0, 3.0)]], "k string, x double, y double")
    assert [(r["x"], r["y"]) for r in optimise.lower_hull(points, "k", "x", "y").orderBy("x").collect()] == [(0, 0), (2, 0.5), (3, 3)]


def test_files(spark, tmp_path):
    folder = tmp_path / "flow" / "17"
    folder.mkdir(parents=True)
    (folder / "volume.json").write_text("[[5000, 1, 2], [0, 3, 4], [5000, 9, 9]]")
    (folder / "operationsCount.json").write_text("[[0, 1, 1]]")
    got = files.read_workflow(spark, str(tmp_path / "flow"), ("volume", "operationsCount")).orderBy("idx").collect()
    assert [(r["timestamp"], r["bytesRead"], r["operationRead"]) for r in got] == [(0, 3, 1), (5000, 1, 0)] and got[0]["job_id"] == "17"
    tiers = files.read_cluster(spark, "defaults: {cores_per_node: 2}\ntiers:\n- {name: hdd, capacity: 80, max_bandwidth: {read: {seq: 40, rand: 40}, write: {seq: 10, rand: 10}}}\nephemeral_tier: {name: bb, persistent_tier: hdd, capacity: 10, max_bandwidth: 5}\n")
    assert [(r["name"], r["read_seq"], r["kind"]) for r in tiers.collect()] == [("hdd", 80e6, "persistent"), ("bb", 5.0, "ephemeral")]
    path = tmp_path / "dependencies.json"
    path.write_text('[["a", "b", {"type": "delay", "delay": 5}], ["b", "c", {"type": "sequential"}]]')
    assert sorted((r["src"], r["type"], r["delay"]) for r in files.read_edges(spark, str(path)).collect()) == [("a", "delay", 5), ("b", "sequential", None)]
    csv = tmp_path / "set" / "job_12.csv"
    csv.parent.mkdir()
    csv.write_text(",timestamp,bytesRead\n0,1.0,5\n1,1.0,6\n2,6.0,7\n")
    assert [(r["job_id"], r["dataset"], r["bytesRead"]) for r in files.read_job_csv(spark, str(csv.parent)).orderBy("timestamp").collect()] == [("12", "set", 5), ("12", "set", 7)]
    assert files.list_jobs(spark, str(csv.parent)).first()["job_id"] == "12"
    assert files.random_phases(spark, 5, 1e6).where("read_volume + write_volume <> 1e6").count() == 0


def test_facility_location(spark):
    from itertools import product

    demand, capacity, distance = {1: 3, 2: 2}, {"a": 4, "b": 4}, {"a": {1: 1, 2: 5}, "b": {1: 4, 2: 2}}
    got = {tuple(r["sites"]): r["cost"] for r in optimise.facility_location(spark, demand, capacity, {"a": 10, "b": 1}, distance).collect()}
    best = min(x * 1 + (3 - x) * 4 + y * 5 + (2 - y) * 2 for x, y in product(range(4), range(3)) if x + y <= 4 and 5 - x - y <= 4)
    assert got == {("a", "b"): best + 11}


def test_streams_are_windows(spark, tmp_path):
    from phasewell.streaming import phases

    rows = [(1, f"2024-01-01 00:00:{s:02d}", 1, 0) for s in (0, 2, 6)] + [(1, "2024-01-01 00:10:00", 5, 5)]
    events = spark.createDataFrame(rows, "job_id long, ts string, bytesRead long, bytesWritten long").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r["bytesRead"] for r in phases.sampled(events).collect()) == [1, 2, 5]
    assert sorted(r["read_volume"] for r in phases.open_phases(events).collect()) == [3, 5]


def test_signals_of_a_log(spark):
    rows = [("a", "read", 0.0, 3.0, 5.0), ("a", "compute", 3.0, 5.0, 0.0), ("a", "write", 5.0, 7.0, 9.0)]
    log = spark.createDataFrame(rows, "app string, type string, t_start double, t_end double, bandwidth double")
    ticks = replay.signal_of_ticks(log).orderBy("at").collect()
    assert [(r["at"], r["read_bw"], r["write_bw"]) for r in ticks] == [(0, 5, 0), (1, 5, 0), (2, 5, 0), (3, 0, 0), (4, 0, 9), (5, 0, 9)]
    assert [(r["at"], r["read_bw"]) for r in replay.signal_of_ends(log).orderBy("at").collect()] == [(0, 0), (3, 5), (5, 0), (7, 0)]
    points = replay.signal_of_points(log, 8).orderBy("at").collect()
    assert [(r["at"], r["read_bw"], r["write_bw"]) for r in points] == [(0, 5, 0), (1, 5, 0), (2, 5, 0), (3, 0, 0), (4, 0, 0), (5, 0, 9), (6, 0, 9), (7, 0, 0)]


def test_one_hot_columns_are_held_as_bytes(spark, monkeypatch):
    """Rows that several fits share hold their patterns in a byte each; fits are those of the rows themselves."""
    rows = spark.range(400).selectExpr("CAST(id % 2 AS double) AS cat__p_seq", "CAST(id % 2 = 0 AS double) AS cat__p_rand", "id / 400 AS remainder__size", "id % 2 * 5 + id / 100 AS lfs_bw").coalesce(1)
    held, cache = [], type(rows).cache
    monkeypatch.setattr(type(rows), "cache", lambda x: held.append(dict(x.dtypes)) or cache(x))
    fitted = model.train_all(rows, {"lfs_bw": "forest"})["lfs_bw"]
    own = model.train(rows, "lfs_bw", "forest")
    assert held[0]["cat__p_seq"] == held[0]["cat__p_rand"] == "tinyint" and held[0]["remainder__size"] == held[0]["lfs_bw"] == "double"
    assert fitted.stages[-1].toDebugString.split("\n", 1)[1] == own.stages[-1].toDebugString.split("\n", 1)[1]
