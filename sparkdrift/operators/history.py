"""Drift runs over time as long metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkdrift.config import DriftConfig
from sparkdrift.functions.text import clean_metric_name, sanitize_metric_name
from sparkdrift.functions.timeparts import epoch_s

# Per-feature metrics a drift run records.
FEATURE_METRICS = (
    "psi",
    "ks_statistic",
    "ks_p_value",
    "js_divergence",
    "wasserstein",
    "mean_shift",
)


def feature_metrics(results: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Six metrics per feature as ``(keys..., key, feature_name, metric, display_name, value)``.

    ``key`` is the cleaned name, whole, and the metric. Where several features of a run clean to the same
    name, each keeps its raw one, so that no two share a key. ``display_name`` is the cut spelling.
    """
    names = [m for m in FEATURE_METRICS if m in results.columns]
    cleaned = clean_metric_name(F.col("feature_name"))
    # One run has one row per feature: the window holds the features of a run that read alike.
    alike = W.partitionBy(*keys, cleaned)
    shared = F.min("feature_name").over(alike) != F.max("feature_name").over(alike)
    stem = F.when(shared, F.col("feature_name")).otherwise(cleaned)
    long = results.select(*keys, "feature_name", stem.alias("__stem"), *names).unpivot(
        [*keys, "feature_name", "__stem"], names, "metric", "value"
    )
    shown = F.concat(sanitize_metric_name(F.col("feature_name")), F.lit("_"), F.col("metric"))
    return long.select(
        *keys,
        metric_key(F.col("__stem"), F.col("metric")).alias("key"),
        "feature_name",
        "metric",
        shown.alias("display_name"),
        "value",
    )


def metric_key(feature: Column, metric: Column) -> Column:
    return F.concat(feature, F.lit("_"), metric)


def overall_metrics(report: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Score, number of drifted features and their share."""
    wide = report.select(
        *keys,
        F.col("overall_drift_score").cast("double"),
        F.col("n_features_drifted").cast("double"),
        F.try_divide(
            F.col("n_features_drifted").cast("double"), F.col("n_features_total").cast("double")
        ).alias("drift_ratio"),
    )
    long = wide.unpivot(
        list(keys), ["overall_drift_score", "n_features_drifted", "drift_ratio"], "metric", "value"
    )
    return long.select(
        *keys,
        F.col("metric").alias("key"),
        F.lit(None).cast("string").alias("feature_name"),
        "metric",
        F.col("metric").alias("display_name"),
        "value",
    )


def drift_run_metrics(
    report: DataFrame, results: DataFrame, keys: Sequence[str] = ("run_id",)
) -> DataFrame:
    return overall_metrics(report, keys).unionByName(feature_metrics(results, keys))


def run_params(report: DataFrame, run_id: str = "run_id") -> DataFrame:
    """Parameters and tags of a drift run, one row per run."""
    hours = F.floor(
        (epoch_s(F.col("current_window_end")) - epoch_s(F.col("current_window_start"))) / 3600
    )
    return report.select(
        run_id,
        "reference_name",
        hours.cast("long").alias("current_window_hours"),
        F.col("n_features_total").alias("n_features_monitored"),
        "reference_samples",
        "current_samples",
        F.lower(F.col("drift_detected").cast("string")).alias("drift_detected"),
        "overall_severity",
    )


def recent(runs: DataFrame, n: int, time_column: str, tie: Sequence[str] = ()) -> DataFrame:
    """Newest ``n`` rows: a bounded top-k, no full sort."""
    return runs.orderBy(F.col(time_column).desc(), *tie).limit(n)


def drift_history(
    runs: DataFrame,
    run_metrics: DataFrame,
    metrics: Sequence[str],
    n_runs: int = 30,
    model_name: str | None = None,
) -> DataFrame:
    """Newest runs with the wanted metrics as columns.

    The metric names are given, so pivoting needs no extra pass to find them.
    """
    chosen = runs if model_name is None else runs.where(F.col("model_name") == model_name)
    newest = recent(chosen, n_runs, "timestamp", ["run_id"])
    wide = (
        run_metrics.where(F.col("key").isin(*metrics))
        .join(newest.select("run_id"), "run_id", "left_semi")
        .groupBy("run_id")
        .pivot("key", list(metrics))
        .agg(F.max("value"))
    )
    return newest.join(wide, "run_id", "left")


def threshold_band(psi: Column, config: DriftConfig = DriftConfig()) -> Column:
    """Region of a timeline plot a PSI value falls into."""
    return (
        F.when(psi < config.psi["low"], "none")
        .when(psi < config.psi["moderate"], "low")
        .when(psi < config.psi["significant"], "moderate")
        .when(psi < config.psi["severe"], "significant")
        .otherwise("severe")
    )


def drift_timeline(
    runs: DataFrame,
    run_metrics: DataFrame,
    feature: str,
    n_runs: int = 30,
    config: DriftConfig = DriftConfig(),
) -> DataFrame:
    """PSI of one feature over the newest runs, oldest first, with its threshold band.

    Rows are found by the feature's name where the table has it, else by the cleaned key.
    """
    if "feature_name" in run_metrics.columns:
        wanted = (F.col("feature_name") == feature) & (F.col("metric") == "psi")
    else:
        wanted = F.col("key") == metric_key(clean_metric_name(F.lit(feature)), F.lit("psi"))
    psi = run_metrics.where(wanted).select("run_id", F.col("value").alias("psi"))
    newest = recent(runs, n_runs, "timestamp", ["run_id"])
    return (
        newest.join(psi, "run_id")
        .select("run_id", "timestamp", "psi", threshold_band(F.col("psi"), config).alias("band"))
        .orderBy("timestamp")
    )


def drift_heatmap(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Metrics capped at 1 for display."""
    one = F.lit(1.0)
    return results.select(
        *keys,
        "feature_name",
        F.least("psi", one).alias("psi"),
        F.col("ks_statistic"),
        F.least("js_divergence", one).alias("js_divergence"),
    )


def runs_summary(runs: DataFrame, run_metrics: DataFrame) -> DataFrame:
    """Number of runs, total stored records and mean quality."""

    def value(name: str) -> Column:
        return F.when(F.col("key") == name, F.col("value"))

    joined = runs.select("run_id").join(run_metrics, "run_id", "left")
    return joined.agg(
        F.count_distinct("run_id").alias("n_runs"),
        F.sum(value("records_stored")).alias("total_stored"),
        F.avg(value("quality_score")).alias("mean_quality"),
    )


def drift_metrics_long(
    results: DataFrame,
    report: DataFrame,
    model_name: str,
    model_version: str,
    config: DriftConfig = DriftConfig(),
) -> DataFrame:
    """Rows for a metric table: one per feature and statistic with its threshold and verdict."""
    head = report.select(
        F.struct(
            F.col("current_window_start").alias("s"), F.col("current_window_end").alias("e")
        )
    ).scalar()
    limits = {
        "psi": config.psi["moderate"],
        "js_divergence": config.js["moderate"],
        "ks_p_value": config.ks_p_value,
        "ks_statistic": None,
        "wasserstein": None,
    }
    rows = []
    for name, limit in limits.items():
        value = F.col(name)
        hit = F.lit(False)
        if limit is not None:
            hit = value < limit if name == "ks_p_value" else value >= limit
        rows.append(
            F.struct(
                F.concat(F.col("feature_name"), F.lit("_" + name)).alias("metric_type"),
                value.cast("double").alias("metric_value"),
                F.lit(limit).cast("double").alias("threshold_value"),
                hit.alias("is_shift_detected"),
            )
        )
    return results.select(
        F.lit(model_name).alias("model_name"),
        F.lit(model_version).alias("model_version"),
        F.inline(F.array(*rows)),
    ).select("*", head["s"].alias("window_start"), head["e"].alias("window_end"))
