"""Model versions and run metrics as tables.

``versions``: model_name, version (long), stage, run_id, creation_timestamp, description.
``run_metrics``: run_id, key, value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdrift.config import TrainingConfig
from sparkdrift.operators.frames import null_safe_join

# Stages and metrics for which smaller is better.
STAGES = ("Staging", "Production", "Archived", "None")
LOWER_IS_BETTER = ("rmse", "mse", "mae", "mape", "loss")


def latest_by_stage(versions: DataFrame) -> DataFrame:
    """Newest version per model and stage, compared as a number."""
    newest = F.max_by(F.struct("version", "run_id"), F.col("version"))
    return (
        versions.groupBy("model_name", "stage")
        .agg(newest.alias("newest"))
        .select("model_name", "stage", "newest.version", "newest.run_id")
    )


def model_info(versions: DataFrame, run_metrics: DataFrame) -> DataFrame:
    """Every version with its run metrics as a map; versions without metrics stay."""
    maps = run_metrics.groupBy("run_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("metrics")
    )
    return null_safe_join(versions, maps, ["run_id"], "left").orderBy(
        "model_name", F.col("version").desc()
    )


def list_models(versions: DataFrame) -> DataFrame:
    """Models with the newest version of each stage they have."""
    return (
        latest_by_stage(versions)
        .groupBy("model_name")
        .agg(
            F.count(F.lit(1)).alias("n_versions"),
            F.map_from_entries(
                F.array_sort(F.collect_list(F.struct("stage", "version")))
            ).alias("latest_versions"),
        )
    )


def lower_is_better(key: Column) -> Column:
    """Decided by the last word of the name, so prefixed names such as test_rmse are recognised."""
    name = F.lower(key)
    return F.element_at(F.split(name, "_"), -1).isin(*LOWER_IS_BETTER) | name.contains("error")


def compare_versions(
    versions: DataFrame,
    run_metrics: DataFrame,
    version_a: int,
    version_b: int,
    metrics: Sequence[str] | None = None,
) -> DataFrame:
    """Metrics common to two versions of each model: difference B - A and the better version."""

    def side(version: int, name: str) -> DataFrame:
        chosen = versions.where(F.col("version") == version).select("model_name", "run_id")
        scored = null_safe_join(chosen, run_metrics, ["run_id"])
        return scored.select("model_name", "key", F.col("value").alias(name))

    both = side(version_a, "value_a").join(side(version_b, "value_b"), ["model_name", "key"])
    if metrics is not None:
        both = both.where(F.col("key").isin(*metrics))
    diff = F.col("value_b") - F.col("value_a")
    b_wins = F.when(lower_is_better(F.col("key")), diff < 0).otherwise(diff > 0)
    return both.select(
        "model_name",
        "key",
        "value_a",
        "value_b",
        diff.alias("difference"),
        F.when(b_wins, version_b).otherwise(version_a).cast("long").alias("better_version"),
    )


def register_gate(metrics: DataFrame, config: TrainingConfig = TrainingConfig()) -> DataFrame:
    """Add ``meets_threshold``; a missing rmse fails, a missing r2 counts as 0."""
    rmse = F.coalesce(F.col("rmse"), F.lit(float("inf")))
    r2 = F.coalesce(F.col("r2"), F.lit(0.0))
    return metrics.withColumn("meets_threshold", (rmse <= config.max_rmse) & (r2 >= config.min_r2))


def metric_of(run_metrics: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """First available of several metric keys per run."""
    rank = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("key"))
    return (
        run_metrics.where(F.col("key").isin(*keys))
        .groupBy("run_id")
        .agg(F.min_by("value", rank).alias(name))
    )


def compare_production(
    candidates: DataFrame, versions: DataFrame, run_metrics: DataFrame
) -> DataFrame:
    """Is each candidate (model_name, run_id) better than its model's Production version?

    RMSE must be strictly lower. Without a Production model or its metrics the candidate wins, and
    ``reason`` says so. A candidate that is the Production run itself is equal to it, also where metrics
    are computed when read and a second reading adds in another order.
    """
    rmse_keys = ("test_rmse", "rmse")
    newest = latest_by_stage(versions).where(F.col("stage") == "Production")
    prod_runs = newest.select("model_name", F.col("run_id").alias("prod_run_id"))
    prod = null_safe_join(
        prod_runs,
        metric_of(run_metrics, rmse_keys, "production_rmse").withColumnRenamed(
            "run_id", "prod_run_id"
        ),
        ["prod_run_id"],
        "left",
    )
    mine = null_safe_join(
        candidates, metric_of(run_metrics, rmse_keys, "new_rmse"), ["run_id"], "left"
    )
    joined = null_safe_join(mine, prod, ["model_name"], "left")
    new = F.coalesce("new_rmse", F.lit(float("inf")))
    itself = F.col("run_id") == F.col("prod_run_id")
    production = F.when(itself, F.col("new_rmse")).otherwise(F.col("production_rmse"))
    reason = (
        F.when(F.col("prod_run_id").isNull(), "no production model")
        .when(production.isNull(), "no production metrics")
        .otherwise("compared")
    )
    return joined.select(
        *candidates.columns,
        "new_rmse",
        production.alias("production_rmse"),
        F.when(reason == "compared", new < production).otherwise(True).alias("is_better"),
        reason.alias("reason"),
    )


def promote_model(
    versions: DataFrame,
    promotions: DataFrame,
    stage: str,
) -> DataFrame:
    """New version table after moving ``promotions`` (model_name, version) to ``stage``.

    Promotion to Production archives the versions that held it.
    """
    if stage not in STAGES:
        raise ValueError(f"invalid stage '{stage}', must be one of {list(STAGES)}")
    chosen = promotions.select("model_name", F.col("version").alias("__promoted"))
    joined = null_safe_join(versions, chosen.dropDuplicates(["model_name"]), ["model_name"], "left")
    picked = F.col("version").eqNullSafe(F.col("__promoted"))
    moved = F.when(picked, F.lit(stage))
    if stage == "Production":
        moved = moved.when(
            F.col("__promoted").isNotNull() & (F.col("stage") == "Production"), "Archived"
        )
    return joined.select(
        *[
            moved.otherwise(F.col("stage")).alias("stage") if c == "stage" else F.col(c)
            for c in versions.columns
        ]
    )
