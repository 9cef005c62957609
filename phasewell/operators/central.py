"""Features of job runs and the most central run."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINTS = 20


def dft(signals: DataFrame, value: str, points: int = POINTS) -> DataFrame:
    """(job_id, k, magnitude): the discrete Fourier transform of the first ``points`` samples, padded with zeros, scaled
    by 2 / the series' whole length."""
    n = signals.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
    waves = signals.where(F.col("idx") < points).select("job_id", "idx", F.col(value).cast("double").alias("x")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    angle = F.lit(2 * math.pi / points) * F.col("k") * F.col("idx")
    parts = waves.groupBy("job_id", "k").agg(F.sum(F.col("x") * F.cos(angle)).alias("re"), F.sum(F.col("x") * F.sin(angle)).alias("im"))
    return parts.join(n, "job_id").select("job_id", "k", (F.sqrt(F.col("re") ** 2 + F.col("im") ** 2) * 2 / F.col("n")).alias("magnitude"))


def features(signals: DataFrame, values: list[str]) -> DataFrame:
    """(job_id, feature, value): minimum, maximum, mean and Fourier magnitudes of each series."""
    out = None
    for v in values:
        stats = signals.groupBy("job_id").agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"))
        long = stats.select("job_id", F.inline(F.array(*[F.struct(F.lit(f"{v}_{c}").alias("feature"), F.col(c).cast("double").alias("value")) for c in ("min", "max", "mean")])))
        waves = dft(signals, v).select("job_id", F.format_string(f"{v}_fft%02d", F.col("k")).alias("feature"), F.col("magnitude").alias("value"))
        both = long.unionByName(waves)
        out = both if out is None else out.unionByName(both)
    return out


def scaled(long: DataFrame, kind: str = "minmax") -> DataFrame:
    """Features scaled over all jobs: to [0, 1] with 0 for constant ones, or to z-scores (null for constant ones)."""
    stats = long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
    rows = long.join(F.broadcast(stats), "feature")  # one row for each feature, a fixed number
    if kind == "minmax":
        value: Column = F.coalesce(F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    else:
        value = F.try_divide(F.col("value") - F.col("mu"), F.col("sd"))
    return rows.select("job_id", "feature", value.alias("value"))


def distances(long: DataFrame) -> DataFrame:
    """(job_id, distance) to the centroid of all jobs."""
    centre = long.groupBy("feature").agg(F.avg("value").alias("centre"))
    return long.join(F.broadcast(centre), "feature").groupBy("job_id").agg(F.sqrt(F.sum(F.pow(F.col("value") - F.col("centre"), 2.0))).alias("distance"))


def central_job(long: DataFrame) -> DataFrame:
    """The job nearest to the centroid, ties to the smaller id."""
    return distances(long).orderBy("distance", "job_id").limit(1)


def vector_distances(rows: DataFrame, id_column: str, vector: str, group: str) -> DataFrame:
    """(id, group, distance) of each vector to its group's centroid."""
    long = rows.select(id_column, group, F.posexplode(vector).alias("at", "x"))
    centre = long.groupBy(group, "at").agg(F.avg(F.col("x").cast("double")).alias("centre"))
    return long.join(centre, [group, "at"]).groupBy(id_column, group).agg(F.sqrt(F.sum(F.pow(F.col("x") - F.col("centre"), 2.0))).alias("distance"))


def principal_components(rows: DataFrame, id_column: str, vector: str, k: int = 2) -> DataFrame:
    """(id, components) of the centred vectors."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = rows.select(id_column, array_to_vector(F.col(vector).cast("array<double>")).alias("raw"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="raw", outputCol="x").fit(data).transform(data)
    model = PCA(k=k, inputCol="x", outputCol="pc").fit(centred)
    return model.transform(centred).select(id_column, vector_to_array("pc").alias("components"))


def latest_first(jobs: DataFrame, name: str, most: int = 50) -> DataFrame:
    """Runs of a workflow by name, in order of their start."""
    return jobs.where(F.col("name") == name).orderBy("start_ms").limit(most)


def with_centroid(long: DataFrame, name: int = -1) -> DataFrame:
    """Features and, under an id of its own, the centroid of all jobs."""
    return long.unionByName(long.groupBy("feature").agg(F.avg("value").alias("value")).select(F.lit(name).cast("long").alias("job_id"), "feature", "value"))
