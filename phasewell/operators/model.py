"""Bandwidth of storage tiers as a function of phase features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import descent

CATEGORIES = ("uncl", "seq", "rand", "stride")
LARGEST_IO = 8e6
#: Columns with a target's suffix that aren't targets.
NO_TARGETS = ("ioi_bw",)


def targets(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.endswith("_bw") and c not in NO_TARGETS]


def _one_hot(column: str) -> list[Column]:
    own = F.when(F.col(column) == "str", F.lit("stride")).otherwise(F.col(column))  # the decomposition's name of it
    checked = F.when(own.isin(*CATEGORIES), own).otherwise(F.raise_error(F.concat(F.lit("unknown pattern "), F.coalesce(F.col(column), F.lit("null")))))
    return [F.when(checked == c, 1.0).otherwise(0.0).alias(f"cat__{column}_{c}") for c in CATEGORIES]


def design_matrix(phases: DataFrame, keep: list[str]) -> DataFrame:
    """One-hot patterns, volume ratios, operation sizes in units of the largest, their mean; ``nodes`` is 1 where absent."""
    total = F.col("read_volume") + F.col("write_volume")
    ratio = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), total.cast("double")), F.lit(0.0))
    nodes = F.col("nodes").cast("double") if "nodes" in phases.columns else F.lit(1.0)
    return phases.select(
        *keep, *_one_hot("read_io_pattern"), *_one_hot("write_io_pattern"),
        nodes.alias("remainder__nodes"), ratio("read_volume").alias("remainder__read_ratio"), ratio("write_volume").alias("remainder__write_ratio"),
        (F.col("read_io_size") / LARGEST_IO).alias("remainder__read_io_size"), (F.col("write_io_size") / LARGEST_IO).alias("remainder__write_io_size"),
        (mean_io_size() / LARGEST_IO).alias("remainder__avg_io_size"),
    )


def mean_io_size() -> Column:
    """Operation size weighted by volume, 0 without volume."""
    weighted = F.col("read_volume") * F.col("read_io_size") + F.col("write_volume") * F.col("write_io_size")
    return F.coalesce(F.try_divide(weighted.cast("double"), (F.col("read_volume") + F.col("write_volume")).cast("double")), F.lit(0.0))


def average_bandwidth(runs: DataFrame, keys: list[str], volume: Column, seconds: Column) -> DataFrame:
    """Volume over time of each key's runs together, 0 without time."""
    return runs.groupBy(*keys).agg(F.coalesce(F.try_divide(F.sum(volume).cast("double"), F.sum(seconds).cast("double")), F.lit(0.0)).alias("bandwidth"))


def check_targets(wanted: list[str], tiers: list[str]) -> None:
    """Targets are tiers' bandwidths, with or without a buffer."""
    unknown = set(wanted) - {f"{t}{kind}_bw" for t in tiers for kind in ("", "_sbb")}
    if unknown:
        raise ValueError(f"no such tiers: {sorted(unknown)}")


def active() -> Column:
    return F.when((F.col("read_volume") == 0) & (F.col("write_volume") == 0), 0.0).otherwise(1.0)


def target_matrix(phases: DataFrame, keep: list[str]) -> DataFrame:
    """Operations a second of each tier: bandwidth over the mean operation size, 0 without volume or size."""
    return phases.select(*keep, *[_rate(c) for c in targets(phases)])


def _rate(target: str) -> Column:
    return F.coalesce(F.try_divide(F.col(target) * active(), mean_io_size()), F.lit(0.0)).alias(target)


def training_table(phases: DataFrame, keep: list[str], labels: list[str] | None = None) -> DataFrame:
    """``design_matrix`` beside ``target_matrix``, or some of its columns, from one pass over the phases."""
    return design_matrix(phases, [*keep, *(_rate(c) for c in (targets(phases) if labels is None else labels))])


def target_maxima(y: DataFrame) -> DataFrame:
    """One row: the largest value of each target, by which they could be scaled."""
    return y.agg(*[F.max(c).alias(c) for c in targets(y)])


#: The columns that predictions are made from, in this order.
FEATURES = ("nodes", "read_volume", "write_volume", "read_io_pattern", "write_io_pattern", "read_io_size", "write_io_size")


def only_features(phases: DataFrame, keep: list[str]) -> DataFrame:
    """FEATURES alone, beside ``keep``; nodes are 1 where absent, any other absent column is an error."""
    rows = phases if "nodes" in phases.columns else phases.withColumn("nodes", F.lit(1))
    if missing := [c for c in FEATURES if c not in rows.columns]:
        raise ValueError(f"no columns {missing}")
    return rows.select(*keep, *FEATURES)


def fold(key: str, folds: int = 5) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(folds)).cast("int")


def regressor(kind: str, label: str):
    from pyspark.ml import regression as R

    made = {
        "linear": lambda: R.LinearRegression(solver="normal"), "ridge": lambda: R.LinearRegression(regParam=0.1, elasticNetParam=0.0),
        "lasso": lambda: R.LinearRegression(regParam=0.1, elasticNetParam=1.0), "elastic": lambda: R.LinearRegression(regParam=0.1, elasticNetParam=0.5),
        "tree": lambda: R.DecisionTreeRegressor(seed=1), "forest": lambda: R.RandomForestRegressor(seed=1, numTrees=20), "boosted": lambda: R.GBTRegressor(seed=1, maxIter=10),
    }
    return made[kind]().setLabelCol(label).setFeaturesCol("features").setPredictionCol(f"predicted_{label}")


DESCENT = {"svr": descent.support_vectors, "multilayer": descent.multilayer}


def train(x: DataFrame, label: str, kind: str = "linear"):
    """A fitted pipeline from design-matrix columns to a label; kinds "svr" and "multilayer" are fitted by descent."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    inputs = [c for c in x.columns if c.startswith(("cat__", "remainder__"))]
    if kind in DESCENT:
        return DESCENT[kind](x, inputs, label)
    return Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="features"), regressor(kind, label)]).fit(x)


def _one_hot_as(x: DataFrame, kind: str) -> DataFrame:
    """The one-hot columns, which are 0 or 1, in another type: bytes take an eighth of the memory where rows are held."""
    return x.select(*[F.col(c).cast(kind).alias(c) if c.startswith("cat__") else c for c in x.columns])


def train_all(x: DataFrame, kinds: dict[str, str]) -> dict[str, object]:
    """A fitted pipeline for each label and its kind; the rows of design and labels are computed once for all fits."""
    held = _one_hot_as(x.select(*[c for c in x.columns if c in kinds or c.startswith(("cat__", "remainder__"))]), "byte").cache()
    try:
        return {label: train(_one_hot_as(held, "double"), label, kind) for label, kind in kinds.items()}
    finally:
        held.unpersist()


def fold_scores(x: DataFrame, label: str, key: str, kind: str = "linear", folds: int = 5, of_fold: Column | None = None) -> list[float | None]:
    """R2 of each fold under the model of the others; folds by a hash of ``key`` unless ``of_fold`` numbers them."""
    scores = []
    numbered = x.withColumn("_fold", fold(key, folds) if of_fold is None else of_fold).cache()
    for f in range(folds):
        out = train(numbered.where(F.col("_fold") != f).drop("_fold"), label, kind).transform(numbered.where(F.col("_fold") == f).drop("_fold"))
        scores.append(r2(out, label, f"predicted_{label}"))
    numbered.unpersist()
    return scores


def cross_validated(x: DataFrame, label: str, key: str, kind: str = "linear", folds: int = 5) -> float:
    """The mean R2 over folds; the model to keep is refitted on all rows."""
    known = [s for s in fold_scores(x, label, key, kind, folds) if s is not None]
    return sum(known) / len(known) if known else float("nan")


def r2(rows: DataFrame, label: str, predicted: str) -> float | None:
    mean = rows.agg(F.avg(label)).first()[0]
    got = rows.agg(F.sum(F.pow(F.col(label) - F.col(predicted), 2.0)).alias("e"), F.sum(F.pow(F.col(label) - F.lit(mean), 2.0)).alias("t")).first() if mean is not None else None
    return 1 - got["e"] / got["t"] if got and got["t"] else None


def predict(x: DataFrame, models: dict[str, object], keep: list[str], operations: bool = True) -> DataFrame:
    """Bandwidths from fitted models; those of operation rates are multiplied by the mean operation size."""
    out = x
    for model in models.values():
        out = model.transform(out).drop("features")
    size = F.col("remainder__avg_io_size") * LARGEST_IO if operations else F.lit(1.0)
    none = (F.col("remainder__read_ratio") == 0) & (F.col("remainder__write_ratio") == 0)
    return out.select(*keep, *[F.when(none, 0.0).otherwise(F.col(f"predicted_{t}") * size).alias(t) for t in models])


def save(model, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def incomplete(table: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a null in any of these columns."""
    return table.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))


def complete(table: DataFrame, computed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Null cells filled from a computed table; others stay."""
    other = computed.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    rest = [c for c in table.columns if c not in columns]
    return table.join(other, key, "left").select(*rest, *[F.coalesce(c, f"_new_{c}").alias(c) for c in columns])


def tier_table(phases: DataFrame, tiers: DataFrame, key: str, bandwidth: Column, names: list[str]) -> DataFrame:
    """One bandwidth column for each tier, null for a name that ``tiers`` lacks; ``tiers`` is a cluster's description, a
    few rows, which become one row beside each phase, so that phases aren't repeated or grouped. Phases have one row for
    each key."""
    of = {n: F.first(F.when(F.col("tier") == n, F.struct(*tiers.columns)), ignorenulls=True).alias(f"_tier{i}") for i, n in enumerate(names)}
    rows = phases.crossJoin(F.broadcast(tiers.agg(*of.values())))
    for i, n in enumerate(names):
        own = rows.select("*", *[F.col(f"_tier{i}.{c}").alias(c) for c in tiers.columns])
        rows = own.withColumn(f"_bw{i}", F.when(F.col("tier").isNotNull(), bandwidth)).drop(*tiers.columns)
    return rows.select(key, *[F.col(f"_bw{i}").alias(n) for i, n in enumerate(names)])
