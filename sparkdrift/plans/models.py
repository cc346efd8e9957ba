"""Regression estimators: a factory, fitting, importances, saved versions."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdrift.operators.registry import STAGES, latest_by_stage
from sparkdrift.sources.files import exists

FEATURES = "features"


def ridge(label: str, rows: int, label_std: float, alpha: float = 1.0, fit_intercept: bool = True) -> Estimator:
    """Least squares with an L2 penalty of ``alpha`` on the raw coefficients.

    The solver minimises the mean squared error of the label scaled by its population deviation, so
    the penalty is expressed in that scale.
    """
    return LinearRegression(
        featuresCol=FEATURES,
        labelCol=label,
        solver="normal",
        elasticNetParam=0.0,
        standardization=False,
        fitIntercept=fit_intercept,
        regParam=alpha / max(rows, 1) * label_std,
    )


def random_forest(
    label: str, trees: int = 100, depth: int = 10, min_leaf: int = 2, seed: int = 42
) -> Estimator:
    return RandomForestRegressor(
        featuresCol=FEATURES,
        labelCol=label,
        numTrees=trees,
        maxDepth=depth,
        minInstancesPerNode=min_leaf,
        featureSubsetStrategy="all",
        seed=seed,
    )


def gradient_boosting(
    label: str, rounds: int = 100, depth: int = 5, rate: float = 0.1, seed: int = 42
) -> Estimator:
    return GBTRegressor(
        featuresCol=FEATURES, labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed
    )


MODELS: dict[str, Callable[..., Estimator]] = {
    "ridge": ridge,
    "random_forest": random_forest,
    "gradient_boosting": gradient_boosting,
}


def create_model(kind: str, train: DataFrame, label: str, **params: Any) -> Estimator:
    """Estimator by name. Ridge first measures the label, one aggregation over the training rows."""
    if kind not in MODELS:
        raise ValueError(f"unknown model type '{kind}', available: {sorted(MODELS)}")
    if kind == "ridge":
        measured = train.agg(F.count(label).alias("n"), F.stddev_pop(label).alias("std")).first()
        return ridge(label, measured["n"], measured["std"] or 0.0, **params)
    return MODELS[kind](label, **params)


# Kinds that pass over their rows hundreds of times, and the rows that are worth a task in such a pass.
MANY_PASSES = ("random_forest", "gradient_boosting")
ROWS_PER_TASK = 20_000


def deal_evenly(rows: DataFrame, order: Sequence[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """All rows in equal parts, their number by the rows alone, each part in the given order.

    A pass starts a task for every part, also for empty ones, and waits for the fullest. Windows leave
    as many parts as the session shuffles into and fill one for each series. Counting reads the rows.
    """
    parts = max(1, math.ceil(rows.count() / rows_per_task))
    return rows.repartition(parts).sortWithinPartitions(*order)


def fit_model(
    kind: str, train: DataFrame, features: Sequence[str], label: str, **params: Any
) -> PipelineModel:
    """Assemble the feature vector and fit. The vectors are kept while the solver iterates."""
    assembler = VectorAssembler(inputCols=list(features), outputCol=FEATURES)
    rows = train.select(*features, label)
    dealt = rows
    if kind in MANY_PASSES:
        rows.persist()
        dealt = deal_evenly(rows, [label, *features])
    vectors = assembler.transform(dealt).select(FEATURES, label).persist()
    try:
        fitted = create_model(kind, vectors, label, **params).fit(vectors)
    finally:
        vectors.unpersist()
        rows.unpersist()
    return PipelineModel(stages=[assembler, fitted])


def feature_importance(
    spark: SparkSession, model: PipelineModel, signed: bool = False
) -> DataFrame:
    """(feature, importance): absolute coefficients or tree importances, one row per feature."""
    assembler, fitted = model.stages
    if hasattr(fitted, "featureImportances"):
        weights = fitted.featureImportances.toArray()
    else:
        weights = fitted.coefficients.toArray()
        weights = weights if signed else abs(weights)
    rows = [(n, float(w)) for n, w in zip(assembler.getInputCols(), weights)]
    return spark.createDataFrame(rows, "feature string, importance double")


def version_path(root: str, model_name: str, version: int) -> str:
    return f"{root.rstrip('/')}/{model_name}/{int(version)}"


def save_version(model: PipelineModel, root: str, model_name: str, version: int) -> str:
    path = version_path(root, model_name, version)
    model.write().overwrite().save(path)
    return path


def load_version(spark: SparkSession, root: str, model_name: str, version: int) -> PipelineModel:
    path = version_path(root, model_name, version)
    if not exists(spark, path):
        raise LookupError(f"model '{model_name}' version {version} not found")
    return PipelineModel.load(path)


def load_stage(
    spark: SparkSession, versions: DataFrame, root: str, model_name: str, stage: str = "Production"
) -> PipelineModel | None:
    """Newest version of a stage; None when the stage is empty."""
    if stage not in STAGES:
        raise ValueError(f"invalid stage '{stage}', must be one of {list(STAGES)}")
    newest = (
        latest_by_stage(versions)
        .where((F.col("model_name") == model_name) & (F.col("stage") == stage))
        .first()
    )
    return None if newest is None else load_version(spark, root, model_name, newest["version"])


def load_serving(
    spark: SparkSession, versions: DataFrame, root: str, model_name: str
) -> PipelineModel:
    """Production model, else Staging."""
    for stage in ("Production", "Staging"):
        found = load_stage(spark, versions, root, model_name, stage)
        if found is not None:
            return found
    raise LookupError(f"model '{model_name}' has no Production or Staging version")
