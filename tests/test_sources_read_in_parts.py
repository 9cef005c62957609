"""BSON dumps read in ranges of bytes, and a service's pages in ranges of time, from files and a local server."""

import datetime
import http.server
import json
import struct
import threading
import urllib.parse

import pytest

from phasewell.sources import bson, pages


def _encoded(document: dict) -> bytes:
    out = b""
    for name, v in document.items():
        key = name.encode() + b"\0"
        if isinstance(v, bool):
            out += b"\x08" + key + bytes([v])
        elif isinstance(v, int):
            out += (b"\x10" + key + struct.pack("<i", v)) if abs(v) < 1 << 31 else (b"\x12" + key + struct.pack("<q", v))
        elif isinstance(v, float):
            out += b"\x01" + key + struct.pack("<d", v)
        elif isinstance(v, str):
            out += b"\x02" + key + struct.pack("<i", len(v.encode()) + 1) + v.encode() + b"\0"
        elif isinstance(v, datetime.datetime):
            out += b"\x09" + key + struct.pack("<q", round(v.timestamp() * 1000))
        elif isinstance(v, bytes) and len(v) == 12:
            out += b"\x07" + key + v
        elif isinstance(v, bytes):
            out += b"\x05" + key + struct.pack("<i", len(v)) + b"\0" + v
        elif isinstance(v, list):
            out += b"\x04" + key + _encoded({str(i): x for i, x in enumerate(v)})
        elif isinstance(v, dict):
            out += b"\x03" + key + _encoded(v)
        elif v is None:
            out += b"\x0a" + key
        else:
            out += b"\x0b" + key + v[0].encode() + b"\0" + v[1].encode() + b"\0"
    return struct.pack("<i", len(out) + 5) + out + b"\0"


def _rows(n):
    when = datetime.datetime(2022, 7, 7, 15, 0, tzinfo=datetime.timezone.utc)
    return [
        {"_id": i.to_bytes(12, "big"), "jobid": i % 3, "timeFrame": when + datetime.timedelta(seconds=5 * i), "bytesRead": i << 33, "share": i / 2, "ok": i % 2 == 0,
         "host": "_id\0n" * (i % 4) if i % 5 else None, "nested": {"_id": 1, "l": [1, "é", {"_id": 2}]}, "re": ("a", "i"), "raw": b"\x05\0\0\0\0" * (i % 7)}
        for i in range(n)
    ]


SCHEMA = "jobid bigint, timeFrame timestamp, bytesRead bigint, share double, ok boolean, host string, nested string, missing int"


@pytest.fixture(scope="module")
def dump(tmp_path_factory):
    folder = tmp_path_factory.mktemp("dump")
    (folder / "a.bson").write_bytes(b"".join(map(_encoded, _rows(400))))
    (folder / "empty.bson").write_bytes(b"")
    (folder / "other.txt").write_bytes(b"x")
    return folder


@pytest.mark.parametrize("size", [97, 1_000, 1 << 20])
def test_every_document_once_in_ranges_of_any_size(spark, dump, size):
    df = bson.read_dump(spark, str(dump), SCHEMA, rangeBytes=size)
    assert df.rdd.getNumPartitions() == -(-(dump / "a.bson").stat().st_size // size)
    got = sorted(df.collect(), key=lambda r: r["bytesRead"])
    for r, d in zip(got, _rows(400), strict=True):
        assert (r["jobid"], r["bytesRead"], r["share"], r["ok"], r["host"], r["missing"]) == (d["jobid"], d["bytesRead"], d["share"], d["ok"], d["host"], None)
        assert r["timeFrame"].timestamp() == d["timeFrame"].timestamp() and json.loads(r["nested"]) == d["nested"]


def test_only_asked_fields_are_decoded(dump, monkeypatch):
    from pyspark.sql import types as T
    from pyspark.sql.datasource import EqualTo

    seen = []
    decoded = bson.value
    monkeypatch.setattr(bson, "value", lambda raw, kind, a, b: seen.append(kind) or decoded(raw, kind, a, b))
    reader = bson.BsonReader(T.StructType([T.StructField("jobid", T.LongType()), T.StructField("share", T.DoubleType())]), {"path": str(dump / "a.bson")})
    assert list(reader.pushFilters([EqualTo(("jobid",), 2), EqualTo(("share",), 1.0), EqualTo(("jobid",), 1)])) == [EqualTo(("share",), 1.0), EqualTo(("jobid",), 1)]
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["jobid"] for r in rows] == [2] * 133 and seen.count(0x10) == 400 and seen.count(0x01) == 133 and len(seen) == 533


def test_pushed_filter_gives_the_same_rows(spark, dump):
    df = bson.read_dump(spark, str(dump), SCHEMA, rangeBytes=500).where("jobid = 1 and share > 10")
    assert sorted(r["bytesRead"] for r in df.collect()) == [r["bytesRead"] for r in _rows(400) if r["jobid"] == 1 and r["share"] > 10]
    assert df.where("jobid = 2").count() == 0


def test_wrong_dumps_are_errors(spark, tmp_path):
    whole = b"".join(map(_encoded, _rows(5)))
    (tmp_path / "cut.bson").write_bytes(whole[:-3])
    with pytest.raises(Exception, match="no document"):
        bson.read_dump(spark, str(tmp_path / "cut.bson"), "jobid bigint").collect()
    with pytest.raises(Exception, match="schema"):
        spark.read.format("bson_dump").load(str(tmp_path))
    with pytest.raises(Exception, match="no such kinds"):
        bson.read_dump(spark, str(tmp_path / "cut.bson"), "jobid array<int>").collect()


def test_metrics_of_jobs(spark, tmp_path):
    when = datetime.datetime(2022, 7, 7, tzinfo=datetime.timezone.utc)
    rows = [{"_id": bytes(12), "jobid": j, "timeFrame": when, "bytesRead": j, "bytesWritten": 5, "operationRead": 1, "operationWrite": 2} for j in (1, 1, 2)]
    (tmp_path / "FileIOSummaryGw.bson").write_bytes(b"".join(map(_encoded, rows)))
    (tmp_path / "JobEvent.bson").write_bytes(_encoded({"_id": bytes(12), "jobid": 1, "timeFrame": when, "type": "custom", "message": "Start"}))
    assert [tuple(r) for r in bson.read_metrics(spark, str(tmp_path), "io", [1]).collect()] == [(1, when.timestamp(), 1, 5)]
    assert bson.read_metrics(spark, str(tmp_path), "operation").count() == 2
    assert bson.read_metrics(spark, str(tmp_path), "event", [1, 2]).select("event_type", "event_message").first() == ("custom", "Start")
    assert bson.read_metrics(spark, str(tmp_path), "process").count() == 0


@pytest.fixture(scope="module")
def service(tmp_path_factory):
    """Serves rows of a file; every first question about a range fails, object ``bad`` always does."""
    file = tmp_path_factory.mktemp("service") / "series.json"
    file.write_text(json.dumps([[t, t * 10, t % 7] for t in range(1000, 1100)]))
    asked: list[dict] = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            url = urllib.parse.urlparse(self.path)
            q = {k: v[0] for k, v in urllib.parse.parse_qs(url.query).items()}
            again = q in asked
            asked.append(q)
            if q["objectId"] == "none":
                return self.send_error(404)
            if q["objectId"] == "bad" or not again:
                return self.send_error(503)
            if url.path == "/job/objectid":
                body = {"jobid": 7, "user": "u", "token": self.headers["Authorization"]}
            else:  # both bounds count here
                body = [["timestamp", "bytesRead", "rest"], *[r for r in json.loads(file.read_text()) if int(q["start"]) <= r[0] <= int(q["end"])]]
            raw = json.dumps(body).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}/", asked
    server.shutdown()


def test_pages_by_time(spark, service):
    address, asked = service
    df = pages.read_series(spark, address, "a", "volume", ["bytesRead", "other"], 990, 1200, rangeSeconds=30)
    assert df.rdd.getNumPartitions() == 7
    assert sorted(map(tuple, df.collect())) == [(t, t * 10, None) for t in range(1000, 1100)]
    asked.clear()
    got = pages.read_series(spark, address, "b", "volume", ["bytesRead"], 0, 10_000, rangeSeconds=25).where("timestamp >= 1010 and timestamp < 1050").collect()
    assert sorted(r["timestamp"] for r in got) == list(range(1010, 1050))
    assert {(q["start"], q["end"]) for q in asked} == {("1010", "1035"), ("1035", "1050")}


def test_failing_pages(spark, service):
    address, _ = service
    with pytest.raises(Exception, match="503"):
        pages.read_series(spark, address, "bad", "volume", ["bytesRead"], 1000, 1010, tries=2).collect()
    assert pages.read_series(spark, address, "bad", "volume", ["bytesRead"], 1000, 1010, tries=1, onError="empty").count() == 0
    assert pages.read_series(spark, address, "a", "volume", ["bytesRead"], 5, 5).count() == 0


def test_metadata(spark, service):
    address, _ = service
    ids = spark.createDataFrame([("m",), ("m",), ("none",), (None,)], "object_id string")
    got = {r["object_id"]: r["metadata"] for r in pages.read_metadata(ids, address, ["jobid", "token", "no"], token="t").collect()}
    assert got == {"m": {"jobid": "7", "token": "t"}, "none": None}
    held = pages.read_metadata(ids.limit(1), address).select(pages.of_key("user").alias("u"), pages.of_key("no").alias("n")).first()
    assert tuple(held) == ("u", None)


def test_a_long_csv_is_read_by_several_tasks(spark, tmp_path):
    """Files of two headers, one of them long: the first row of a timestamp counts also across its parts."""
    from phasewell.sources import files

    (tmp_path / "d").mkdir()
    lines = [f"{i},{i // 2},{i * 3},x{i},{i}" for i in range(20_000)]
    (tmp_path / "d" / "io_job_1.csv").write_text("\n".join([",timestamp,bytesRead,note,bytesWritten", *lines]) + "\n")
    (tmp_path / "d" / "io_job_2.csv").write_text("bytesWritten,timestamp\r\n5,1.5\r\n6,1.5\r\nno,2.5\r\n")
    (tmp_path / "d" / "io_job_3.csv").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        df = files.read_job_csv(spark, str(tmp_path))
        plan = df._jdf.queryExecution().executedPlan().toString()
        got = df.collect()
        assert spark.read.csv(str(tmp_path / "d" / "io_job_1.csv")).rdd.getNumPartitions() > 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert "note" not in plan.split("ReadSchema", 1)[1]
    one = sorted((r["timestamp"], r["bytesRead"], r["bytesWritten"]) for r in got if r["job_id"] == "1")
    assert one == [(float(t), 6 * t, 2 * t) for t in range(10_000)]
    assert sorted((r["timestamp"], r["bytesRead"], r["bytesWritten"], r["dataset"]) for r in got if r["job_id"] == "2") == [(1.5, None, 5, "d"), (2.5, None, None, "d")]
    assert files.read_job_csv(spark, str(tmp_path / "d" / "io_job_3.csv")).count() == 0
