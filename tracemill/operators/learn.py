"""Latency models with Spark ML."""

from __future__ import annotations

from itertools import product

from pyspark.ml import Pipeline
from pyspark.ml.feature import PolynomialExpansion, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import detect
from .lineage import checkpoint

LEAST = 20
#: Rows of a table that may be broadcast.
FEW = 100_000


def ridge(rows: DataFrame, features: list[str], label: str, alpha: float = 1.0, degree: int = 1):
    """L2: standardised (and expanded) features with a ridge penalty. Spark scales the penalty by the label's deviation and the
    features by their sample deviation; the factor makes it the textbook alpha on population-scaled features."""
    n, sd = rows.agg(F.count("*"), F.stddev_pop(label)).first()
    stages = [VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="skip")]
    if degree > 1:
        stages.append(PolynomialExpansion(degree=degree, inputCol="_raw", outputCol="_poly"))
    stages.append(StandardScaler(inputCol="_poly" if degree > 1 else "_raw", outputCol="_x", withMean=True))
    penalty = alpha * (sd or 0.0) * (n - 1) / n**2 if n else 0.0
    stages.append(LinearRegression(featuresCol="_x", labelCol=label, predictionCol="predicted", regParam=penalty, elasticNetParam=0.0, standardization=False, solver="normal"))
    return Pipeline(stages=stages).fit(rows)


def boosted(rows: DataFrame, features: list[str], label: str, trees: int = 200, depth: int = 4, rate: float = 0.1, seed: int = 42):
    """L1: gradient boosted trees by histograms. Rows of equal features are one with their mean label and their number as weight: under
    squared loss splits and leaves depend on the rows by these alone, so all rows count, and a tree costs the distinct ones."""
    rows = rows.where(F.col(label).isNotNull()).groupBy(*features).agg(F.avg(label).alias(label), F.count("*").cast("double").alias("_weight"))
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="skip"), GBTRegressor(featuresCol="_raw", labelCol=label, weightCol="_weight", predictionCol="predicted", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed)]).fit(rows)


def trained(rows: DataFrame, features: list[str], label: str, kind: str = "ridge", log: bool = False, mode: str | None = None, **options) -> list[tuple]:
    """L3, L4: (mode value or None, model) fitted on all rows, or apart for each value of a mode column; fewer than LEAST rows give none."""
    target = "_target"
    rows = rows.withColumn(target, F.log1p(label) if log else F.col(label).cast("double"))
    parts = [(None, rows)] if mode is None else [(v, rows.where(F.col(mode) == v)) for (v,) in rows.select(mode).distinct().orderBy(mode).collect() if v is not None]
    return [(v, (boosted if kind == "boosted" else ridge)(part, features, target, **options)) for v, part in parts if part.count() >= LEAST]


def predicted(rows: DataFrame, models: list[tuple], log: bool = False, mode: str | None = None) -> DataFrame:
    """All rows with predicted, back from the logarithm and not below 0; null where the mode has no model or a feature is missing."""
    known, features = [v for v, _ in models if v is not None], models[0][1].stages[0].getInputCols() if models else []
    able = F.coalesce(F.col(mode).isin(known), F.lit(False)) if known else F.lit(bool(models))
    for c in features:
        able = able & F.col(c).isNotNull() & ~F.coalesce(F.isnan(F.col(c).cast("double")), F.lit(False))
    rest = rows.where(~able)
    out = rest.select(*rows.columns, F.lit(None).cast("double").alias("predicted"))
    for v, model in models:
        part = model.transform(rows if v is None else rows.where(F.col(mode) == v))
        part = part.select(*rows.columns, F.greatest(F.expm1("predicted") if log else F.col("predicted"), F.lit(0.0)).alias("predicted"))
        out = out.unionByName(part)
    return out


def random_split(rows: DataFrame, seed: int = 42) -> DataFrame:
    """is_train for four rows of five."""
    return rows.withColumn("is_train", F.rand(seed) < 0.8)


def grid(kinds=("ridge", "boosted"), logs=(False, True), splits=("random", "group"), modes=(None, "mode"), iqr=(1.5, 3.0, float("inf"))) -> list[dict]:
    """The experiment grid."""
    return [dict(zip(("kind", "log", "split", "mode", "iqr"), x, strict=True)) for x in product(kinds, logs, splits, modes, iqr)]


def bounds(rows: DataFrame, keys: list[str], label: str, configs: list[dict]) -> dict[float, DataFrame]:
    """The bounds of each finite iqr among the configurations, worked out once and written down."""
    found = {}
    for k in sorted({c["iqr"] for c in configs} - {float("inf")}):
        limits = checkpoint(detect.iqr_bounds(rows, keys, label, k))
        found[k] = F.broadcast(limits) if limits.count() <= FEW else limits
    return found


def experiment(rows: DataFrame, features: list[str], label: str, keys: list[str], config: dict, limits: dict[float, DataFrame] | None = None, measures: tuple[str, ...] = (), **options) -> dict:
    """Quality on the test rows of one configuration; all of regression_quality or the measures named. limits: bounds() of
    these rows, if several experiments share them."""
    if config["iqr"] != float("inf"):
        rows = detect.iqr_clean(rows, (limits or bounds(rows, keys, label, [config]))[config["iqr"]], keys, label)
    rows = detect.group_split(rows, keys) if config["split"] == "group" else random_split(rows)
    models = trained(rows.where("is_train"), features, label, config["kind"], config["log"], config["mode"], **options)
    if not models:
        return config | {"r2": None}
    tested = predicted(rows.where("not is_train"), models, config["log"], config["mode"]).where("predicted is not null")
    got = detect.regression_quality(tested, label, "predicted", len(features)).select(*measures or "*").first()
    return config | (got.asDict() if got else {"r2": None})


def champion(results: list[dict]) -> dict | None:
    """The best test R2 among grouped splits by mode, else among those by mode, else of all."""
    for pick in (lambda r: r["split"] == "group" and r["mode"], lambda r: r["mode"], lambda r: True):
        if hits := [r for r in results if pick(r) and r.get("r2") is not None]:
            return max(hits, key=lambda r: r["r2"])
    return None


def importances(model, features: list[str]) -> list[tuple[str, float]]:
    """Coefficients or importances, the largest first."""
    last = model.stages[-1]
    values = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    names = features if len(values) == len(features) else [f"term{k}" for k in range(len(values))]
    return sorted(zip(names, (float(v) for v in values)), key=lambda x: -abs(x[1]))
