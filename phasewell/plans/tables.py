"""The test tables as the engine's tables, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ACCESS

#: Seconds of a sample, and the sums from which a sample counts as I/O: first and second level.
STEP, LEVEL1, LEVEL2 = 21_600, 3_000, 10_000
METRICS = ["bytesRead", "bytesWritten", "operationRead", "operationWrite", *(f"access{p}{d}" for d in ("Read", "Write") for p in ACCESS)]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of each job and 6-hour bucket that has events; values are cents."""
    events = load(spark, sf_dir, "events")
    second = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    read = F.col("event_type").isin("view", "click")
    write = F.col("event_type").isin("purchase", "signup")
    value = F.round(F.col("value") * 100).cast("long")
    pattern = F.get_json_object("props", "$.k").cast("long") % len(ACCESS)
    total = lambda flag, v, name: F.sum(F.when(flag, v).otherwise(0)).cast("long").alias(name)
    return events.groupBy(F.col("user_id").alias("job_id"), F.floor(second / STEP).cast("long").alias("bucket")).agg(
        total(read, value, "bytesRead"), total(write, value, "bytesWritten"), total(read, F.lit(1), "operationRead"), total(write, F.lit(1), "operationWrite"),
        *[total(side & (pattern == i), F.lit(1), f"access{p}{d}") for side, d in ((read, "Read"), (write, "Write")) for i, p in enumerate(ACCESS)],
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of every job on a grid without gaps, with their joint signal ``norm`` and labels."""
    from ..operators.joins import on_grid

    rows = on_grid(samples(spark, sf_dir), "bucket", METRICS, 1, ["job_id"], "idx").withColumn("ts_s", F.col("bucket") * STEP)
    level = lambda v: (F.when(v >= LEVEL1, 1).otherwise(0) + F.when(v >= LEVEL2, 1).otherwise(0)).cast("int")
    norm = F.col("bytesRead") + F.col("bytesWritten")
    rows = rows.withColumn("norm", norm).withColumn("label", level(F.col("norm")))
    return rows.withColumn("label_read", level(F.col("bytesRead"))).withColumn("label_write", level(F.col("bytesWritten"))).drop("bucket")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs of their customer's workflow, from the order to the last shipment."""
    millis = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    last = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("shipped"))
    rows = load(spark, sf_dir, "orders").join(last, "o_orderkey", "left").withColumn("end", F.greatest(F.coalesce("shipped", "o_orderdate"), "o_orderdate"))
    return rows.select(F.col("o_custkey").alias("workflow_id"), F.col("o_orderkey").alias("job_id"), millis("o_orderdate").alias("start_ms"), millis("end").alias("end_ms"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items, the first of each order and line number."""
    from ..operators.joins import first_of

    return first_of(load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_discount", "l_tax"])


def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as phases with features and bandwidths of two tiers, one of them with gaps."""
    rows = items(spark, sf_dir)
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    read = F.when(F.col("l_returnflag") == "R", 0).otherwise(cents)
    write = F.when(F.col("l_returnflag") == "R", cents).when(F.col("l_returnflag") == "A", F.floor(cents / 2)).otherwise(0).cast("long")
    pattern = F.when(F.col("l_linestatus") == "O", "seq").when(F.col("l_returnflag") == "A", "rand").otherwise("stride")
    return rows.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("phase_id"), read.cast("long").alias("read_volume"), write.alias("write_volume"),
        pattern.alias("read_io_pattern"), F.when(F.col("l_returnflag") == "N", "uncl").otherwise(pattern).alias("write_io_pattern"),
        (F.col("l_quantity") * 1000).alias("read_io_size"), (F.col("l_quantity") * 500).alias("write_io_size"),
        F.col("l_extendedprice").alias("ioi_bw"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("lfs_bw"),
        F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("sbb_bw"),
    )


_ACCESS_SQL = ", ".join(f"sum(CASE WHEN {d[0]} AND p = {i} THEN 1 ELSE 0 END)::BIGINT AS access{a}{d}" for d in ("Read", "Write") for i, a in enumerate(ACCESS)).replace("WHEN R AND", "WHEN rd AND").replace("WHEN W AND", "WHEN wr AND")
SAMPLES_SQL = f"""raw AS (
  SELECT user_id AS job_id, floor(epoch_us(ts) / {STEP}000000)::BIGINT AS bucket, round(value * 100)::BIGINT AS v,
         event_type IN ('view', 'click') AS rd, event_type IN ('purchase', 'signup') AS wr,
         CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 AS p FROM events
), samples AS (
  SELECT job_id, bucket, sum(CASE WHEN rd THEN v ELSE 0 END)::BIGINT AS bytesRead, sum(CASE WHEN wr THEN v ELSE 0 END)::BIGINT AS bytesWritten,
         sum(CASE WHEN rd THEN 1 ELSE 0 END)::BIGINT AS operationRead, sum(CASE WHEN wr THEN 1 ELSE 0 END)::BIGINT AS operationWrite, {_ACCESS_SQL}
  FROM raw GROUP BY 1, 2
)"""
_LEVEL_SQL = lambda x: f"(CASE WHEN {x} >= {LEVEL2} THEN 2 WHEN {x} >= {LEVEL1} THEN 1 ELSE 0 END)"
GRID_SQL = f"""{SAMPLES_SQL}, grid AS (
  SELECT job_id, lo, unnest(range(lo, hi + 1)) AS bucket FROM (SELECT job_id, min(bucket) AS lo, max(bucket) AS hi FROM samples GROUP BY 1)
), signals AS (
  SELECT g.job_id, (g.bucket - lo)::INTEGER AS idx, g.bucket * {STEP} AS ts_s, {", ".join(f"coalesce({m}, 0) AS {m}" for m in METRICS)},
         coalesce(bytesRead, 0) + coalesce(bytesWritten, 0) AS norm
  FROM grid g LEFT JOIN samples s ON s.job_id = g.job_id AND s.bucket = g.bucket
), sizes AS (SELECT job_id, max(idx) + 1 AS n FROM signals GROUP BY 1)"""
SIGNALS_SQL = f"""{GRID_SQL}, labelled AS (
  SELECT *, {_LEVEL_SQL("norm")} AS label, {_LEVEL_SQL("bytesRead")} AS label_read, {_LEVEL_SQL("bytesWritten")} AS label_write FROM signals
)"""
JOBS_SQL = """jobs AS (
  SELECT o_custkey AS workflow_id, o_orderkey AS job_id, epoch_ms(o_orderdate) AS start_ms,
         epoch_ms(greatest(coalesce(shipped, o_orderdate), o_orderdate)) AS end_ms
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY workflow_id ORDER BY start_ms, job_id) AS ord FROM jobs
), edges AS (
  SELECT a.workflow_id, a.job_id AS src, b.job_id AS dst, a.ord,
         CASE WHEN b.start_ms BETWEEN a.end_ms - 0.1::DOUBLE * (a.end_ms - a.start_ms) AND a.end_ms + 0.1::DOUBLE * (a.end_ms - a.start_ms) THEN 'sequential'
              WHEN b.start_ms BETWEEN a.start_ms - 0.1::DOUBLE * (a.end_ms - a.start_ms) AND a.start_ms + 0.1::DOUBLE * (a.end_ms - a.start_ms) THEN 'parallel'
              ELSE 'delay' END AS type, b.start_ms - a.start_ms AS gap
  FROM numbered a JOIN numbered b ON a.workflow_id = b.workflow_id AND a.ord < b.ord
), kept AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY workflow_id, dst ORDER BY
    CASE type WHEN 'sequential' THEN 3 WHEN 'parallel' THEN 2 ELSE 1 END DESC, ord DESC) AS nth FROM edges) WHERE nth = 1
)"""
ITEMS_SQL = """items AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_discount, l_tax) AS nth FROM lineitem) WHERE nth = 1)"""
PHASES_SQL = f"""{ITEMS_SQL}, phases AS (
  SELECT l_orderkey * 10 + l_linenumber AS phase_id, CASE WHEN l_returnflag = 'R' THEN 0 ELSE c END AS read_volume,
         CASE l_returnflag WHEN 'R' THEN c WHEN 'A' THEN floor(c / 2)::BIGINT ELSE 0 END AS write_volume, p AS read_io_pattern,
         CASE WHEN l_returnflag = 'N' THEN 'uncl' ELSE p END AS write_io_pattern, l_quantity * 1000 AS read_io_size, l_quantity * 500 AS write_io_size,
         l_extendedprice AS ioi_bw, l_extendedprice * (1 - l_discount) AS lfs_bw, CASE WHEN l_linenumber <> 3 THEN l_extendedprice * (1 + l_tax) END AS sbb_bw
  FROM (SELECT *, round(l_extendedprice * 100)::BIGINT AS c,
               CASE WHEN l_linestatus = 'O' THEN 'seq' WHEN l_returnflag = 'A' THEN 'rand' ELSE 'stride' END AS p FROM items)
), measured AS (
  SELECT *, CASE WHEN read_volume + write_volume = 0 THEN 0.0::DOUBLE
                 ELSE (read_volume * read_io_size + write_volume * write_io_size) / (read_volume + write_volume) END AS size FROM phases
)"""
