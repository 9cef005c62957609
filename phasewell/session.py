"""Session settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "phasewell", partitions: int | None = None) -> SparkSession:
    """A session in UTC with adaptive execution; shuffle partitions only where given, the cluster's otherwise."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def spread(df, *keys: str):
    """``df`` dealt by a hash of ``keys`` to as many tasks as a shuffle has: for rows that are few but take Python long, so
    that adaptive execution doesn't put them together by their bytes. Rows of equal keys stay together."""
    from pyspark.sql import functions as F

    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*keys))


def cut(df):
    """Compute ``df`` once into the checkpoint folder that the cluster names; a local session may have a temporary one."""
    import tempfile

    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="phasewell-"))
    return df.checkpoint(eager=True)
