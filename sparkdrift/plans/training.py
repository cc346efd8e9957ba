"""Training and scoring jobs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdrift.config import FeatureConfig, TrainingConfig
from sparkdrift.operators.metrics import DEFAULT_METRICS, regression_metrics
from sparkdrift.operators.registry import compare_production, register_gate
from sparkdrift.operators.split import (
    build_training_frame,
    feature_matrix,
    non_empty_columns,
    numeric_columns,
    temporal_split,
)
from sparkdrift.operators.transform import DEFAULT_ZONE
from sparkdrift.operators.windows import Series
from sparkdrift.plans.models import fit_model, save_version
from sparkdrift.sources.files import exists, temporary_tables, write_once
from sparkdrift.sources.runs import append_table
from sparkdrift.sources.table import in_period


# Days that are trained on and scored unless a period is given.
TRAINING_DAYS, SCORING_DAYS = 30, 7


def prepare_data(
    observations: DataFrame,
    series: Series,
    config: FeatureConfig = FeatureConfig(),
    training: TrainingConfig = TrainingConfig(),
    tz: str | None = DEFAULT_ZONE,
    features: Sequence[str] | None = None,
    **period: Any,
) -> DataFrame:
    """Observations -> features, target, split label, complete rows.

    The cut points come from all rows that have a target, before incomplete rows are removed. ``start``,
    ``end``, ``days`` or ``location`` narrow the observations first, as ``in_period`` does; with any of
    them given, the period reaches 30 days back unless told otherwise.
    """
    if period:
        observations = in_period(
            observations, **{"days": TRAINING_DAYS, "time_column": series.time} | period
        )
    frame = build_training_frame(observations, series, config, tz)
    labelled = temporal_split(frame, series.time, training.test_days, training.validation_days)
    keep = list(dict.fromkeys([*series.keys, series.time, "split"]))
    return feature_matrix(labelled, config, keep=keep, features=features)


def model_features(observations: DataFrame, config: FeatureConfig = FeatureConfig(), exclude: Sequence[str] = ()) -> list[str]:
    """Measured columns that hold any value; one aggregation over the raw columns."""
    candidates = [c for c in numeric_columns(observations, config) if c not in exclude]
    return non_empty_columns(observations, candidates)


@dataclass
class Trained:
    """A fitted model with its predictions and metrics per split."""

    model: PipelineModel
    predictions: DataFrame
    metrics: DataFrame
    features: list[str]


def train_model(
    prepared: DataFrame,
    kind: str,
    label: str,
    features: Sequence[str],
    metrics: Sequence[str] = DEFAULT_METRICS,
    **params: Any,
) -> Trained:
    """Fit on the training rows; metrics of all splits come from one grouped aggregation."""
    model = fit_model(kind, prepared.where(F.col("split") == "train"), features, label, **params)
    predictions = model.transform(prepared).drop("features")
    scored = regression_metrics(predictions, label, "prediction", metrics, ["split"])
    return Trained(model, predictions, scored, list(features))


def prefixed_metrics(scored: DataFrame, run_id: str) -> DataFrame:
    """Metrics per split as long rows named ``<split>_<metric>``."""
    names = [c for c in scored.columns if c not in ("split", "n_samples")]
    return scored.unpivot(["split"], names, "metric", "value").select(
        F.lit(run_id).alias("run_id"),
        F.concat("split", F.lit("_"), "metric").alias("key"),
        F.col("value").cast("double").alias("value"),
    )


VERSION_SCHEMA = (
    "model_name string, version bigint, stage string, run_id string, "
    "creation_timestamp timestamp, description string"
)


def run_training(
    spark: SparkSession,
    observations: DataFrame,
    series: Series,
    root: str,
    model_name: str,
    run_id: str,
    kind: str = "ridge",
    config: FeatureConfig = FeatureConfig(),
    training: TrainingConfig = TrainingConfig(),
    tz: str | None = DEFAULT_ZONE,
    **params: Any,
) -> dict[str, Any]:
    """Train, evaluate, record the run, and register the model when it passes the gate.

    Metrics and versions are rows of Parquet tables under ``root``. A registered model that beats the
    Production model is recommended for promotion; the comparison always runs.
    """
    keys = [*series.keys, *series.tie]
    # An empty frame has all columns; which of the raw ones hold values is asked of the raw rows.
    probe = build_training_frame(observations.limit(0), series, config, tz)
    features = [c for c in numeric_columns(probe, config) if c not in keys]
    filled = set(model_features(observations, config, keys))
    raw = set(observations.columns)
    features = [f for f in features if f not in raw or f in filled]
    with temporary_tables(spark):
        prepared = prepare_data(observations, series, config, training, tz, features).persist()
        try:
            trained = train_model(prepared, kind, config.target, features, **params)
            rows = prefixed_metrics(trained.metrics, run_id).collect()
        finally:
            prepared.unpersist()
    metrics = {r["key"]: r["value"] for r in rows}
    scored = spark.createDataFrame(rows, "run_id string, key string, value double")
    append_table(scored, f"{root}/run_metrics")
    test = spark.createDataFrame(
        [(metrics.get("test_rmse"), metrics.get("test_r2"))], "rmse double, r2 double"
    )
    passed = register_gate(test, training).first()["meets_threshold"]
    result: dict[str, Any] = {
        "run_id": run_id,
        "metrics": metrics,
        "meets_threshold": passed,
        "version": None,
        "is_better": None,
        "model": trained.model,
    }
    if not passed:
        return result
    versions_path = f"{root}/model_versions"
    known = (
        spark.read.schema(VERSION_SCHEMA).parquet(versions_path)
        if exists(spark, versions_path)
        else spark.createDataFrame([], VERSION_SCHEMA)
    )
    candidate = spark.createDataFrame([(model_name, run_id)], "model_name string, run_id string")
    run_metrics = spark.read.parquet(f"{root}/run_metrics")
    better = compare_production(candidate, known, run_metrics).first()["is_better"]
    newest = known.where(F.col("model_name") == model_name).agg(F.max("version")).first()[0] or 0
    version = claim_version(spark, root, model_name, int(newest))
    save_version(trained.model, f"{root}/models", model_name, version)
    row = spark.createDataFrame(
        [(model_name, version, "None", run_id)],
        "model_name string, version bigint, stage string, run_id string",
    ).select(
        "*",
        F.current_timestamp().alias("creation_timestamp"),
        F.lit(f"{kind} model").alias("description"),
    )
    append_table(row, versions_path)
    result.update(version=version, is_better=better)
    return result


def claim_version(spark: SparkSession, root: str, model_name: str, newest: int) -> int:
    """The first version number after ``newest`` that no other run has claimed.

    A claim is a small file that only one run can create; whoever comes second takes the next number. The
    number of a run that died stays unused.
    """
    version = newest + 1
    while not write_once(spark, f"{root}/model_claims/{model_name}/{version}", str(version)):
        version += 1
    return version


def score_period(
    model: PipelineModel,
    observations: DataFrame,
    series: Series,
    config: FeatureConfig = FeatureConfig(),
    tz: str | None = DEFAULT_ZONE,
    metrics: Sequence[str] = DEFAULT_METRICS,
    **period: Any,
) -> tuple[DataFrame, DataFrame]:
    """Predictions and metrics of a saved model on new observations.

    The period is chosen as for ``prepare_data``, with 7 days by default.
    """
    if period:
        observations = in_period(
            observations, **{"days": SCORING_DAYS, "time_column": series.time} | period
        )
    features = model.stages[0].getInputCols()
    frame = build_training_frame(observations, series, config, tz)
    keep = list(dict.fromkeys([*series.keys, series.time]))
    matrix = feature_matrix(frame, config, keep=keep, features=features)
    predictions = model.transform(matrix).drop("features")
    return predictions, regression_metrics(predictions, config.target, "prediction", metrics)


def time_folds(df: DataFrame, time_column: str = "timestamp", folds: int = 5) -> DataFrame:
    """Expanding-window fold number: fold k trains on segments < k and validates on segment k.

    Segments hold equal shares of the time range and are found from its ends alone, so no sort of
    the whole table is needed.
    """
    t = F.unix_micros(F.col(time_column).cast("timestamp"))
    ends = df.agg(F.min(t).alias("a"), F.max(t).alias("b")).select(F.struct("a", "b")).scalar()
    share = F.try_divide((t - ends["a"]).cast("double"), (ends["b"] - ends["a"]).cast("double"))
    segment = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * (folds + 1)), F.lit(folds))
    return df.withColumn("segment", segment.cast("int"))

