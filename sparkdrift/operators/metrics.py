"""Regression metrics, per-period metrics, residual reports and plot data."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkdrift.functions.numeric import bin_edge, bin_index
from sparkdrift.functions.timeparts import period_start
from sparkdrift.operators.distribution import exact_quantiles, to_long
from sparkdrift.operators.frames import null_safe_join

# Smallest divisor of the percentage error: the double-precision machine epsilon.
TINY = 2.220446049250313e-16


def _mse(y: Column, p: Column) -> Column:
    return F.avg((y - p) * (y - p))


def _r2(y: Column, p: Column) -> Column:
    """1 - SSE/SST; a constant target scores 1 when met exactly, else 0; undefined below 2 rows."""
    n = F.count(y)
    sse = F.sum((y - p) * (y - p))
    sst = F.var_pop(y) * n
    return F.when(
        n >= 2,
        F.when(sst > 0, 1 - F.try_divide(sse, sst)).otherwise(F.when(sse == 0, 1.0).otherwise(0.0)),
    )


METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "rmse": lambda y, p: F.sqrt(_mse(y, p)),
    "mse": _mse,
    "mae": lambda y, p: F.avg(F.abs(y - p)),
    "r2": _r2,
    "mape": lambda y, p: F.avg(F.abs(y - p) / F.greatest(F.abs(y), F.lit(TINY))),
}
DEFAULT_METRICS = ("rmse", "mae", "r2", "mape")


def check_metrics(names: Sequence[str]) -> None:
    unknown = sorted(set(names) - set(METRICS))
    if unknown:
        raise ValueError(f"unknown metrics: {unknown}, available: {sorted(METRICS)}")


def _pairs(df: DataFrame, y: str, prediction: str, keep: Sequence[Column]) -> DataFrame:
    return df.select(
        *keep, F.col(y).cast("double").alias("y"), F.col(prediction).cast("double").alias("p")
    )


def _metric_columns(names: Sequence[str]) -> list[Column]:
    return [METRICS[m](F.col("y"), F.col("p")).alias(m) for m in names]


def regression_metrics(
    df: DataFrame,
    y: str,
    prediction: str,
    metrics: Sequence[str] = DEFAULT_METRICS,
    keys: Sequence[str] = (),
) -> DataFrame:
    """All metrics from one aggregation pass, per key or as one row."""
    check_metrics(metrics)
    pairs = _pairs(df, y, prediction, [F.col(k) for k in keys])
    return pairs.groupBy(*keys).agg(F.count("y").alias("n_samples"), *_metric_columns(metrics))


def metrics_by_period(
    df: DataFrame,
    y: str,
    prediction: str,
    time_column: str,
    freq: str = "D",
    metrics: Sequence[str] = DEFAULT_METRICS,
) -> DataFrame:
    """Metrics per hour, day or week; periods with one row are left out."""
    check_metrics(metrics)
    residual = F.col("y") - F.col("p")
    pairs = _pairs(df, y, prediction, [period_start(F.col(time_column), freq).alias("period")])
    return (
        pairs.groupBy("period")
        .agg(
            F.count(F.lit(1)).alias("n_samples"),
            F.avg(residual).alias("mean_residual"),
            F.stddev_samp(residual).alias("std_residual"),
            *_metric_columns(metrics),
        )
        .where(F.col("n_samples") >= 2)
    )


def residual_report(
    df: DataFrame, y: str, prediction: str, metrics: Sequence[str] = DEFAULT_METRICS
) -> DataFrame:
    """Metrics, residual moments (population form) and absolute-error percentiles, one row."""
    check_metrics(metrics)
    pairs = _pairs(df, y, prediction, [])
    residual = F.col("y") - F.col("p")
    stats = pairs.agg(
        F.count(F.lit(1)).alias("n_samples"),
        *_metric_columns(metrics),
        F.avg(residual).alias("residual_mean"),
        F.stddev_pop(residual).alias("residual_std"),
        F.min(residual).alias("residual_min"),
        F.max(residual).alias("residual_max"),
        F.skewness(residual).alias("residual_skewness"),
        F.kurtosis(residual).alias("residual_kurtosis"),
    )
    errors = to_long(pairs.select(F.abs(residual).alias("error")), ["error"])
    # Reported percentiles.
    probs = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    tail = exact_quantiles(errors, list(probs.values()))
    named = tail.select(*[F.col("quantiles")[i].alias(n) for i, n in enumerate(probs)])
    return null_safe_join(stats, named, [], "left")


def residual_histogram(df: DataFrame, y: str, prediction: str, bins: int = 50) -> DataFrame:
    """Equal-width residual bins; every bin is present."""
    residuals = _pairs(df, y, prediction, []).select((F.col("y") - F.col("p")).alias("r"))
    limits = residuals.agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    at = limits.select(F.struct("lo", "hi")).scalar()
    counted = (
        residuals.where(F.col("r").isNotNull())
        .select(bin_index(F.col("r"), at["lo"], at["hi"], bins).alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    grid = limits.where(F.col("lo").isNotNull()).select(
        "lo",
        "hi",
        F.explode(
            F.sequence(F.lit(0), F.when(F.col("hi") <= F.col("lo"), 0).otherwise(bins - 1))
        ).alias("bin"),
    )
    return null_safe_join(grid, counted, ["bin"], "left").select(
        "bin",
        bin_edge(F.col("bin"), F.col("lo"), F.col("hi"), bins).alias("bin_lo"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def qq_points(df: DataFrame, y: str, prediction: str, points: int = 99) -> DataFrame:
    """Residual quantiles against normal quantiles on an even probability grid."""
    probs = [i / (points + 1) for i in range(1, points + 1)]
    normal = NormalDist()
    residuals = _pairs(df, y, prediction, []).select((F.col("y") - F.col("p")).alias("r"))
    found = exact_quantiles(to_long(residuals, ["r"]), probs)
    expected = F.expr("array(" + ", ".join(f"{normal.inv_cdf(p)!r}D" for p in probs) + ")")
    return found.select(F.posexplode("quantiles").alias("i", "residual_quantile")).select(
        (F.col("i") + 1).alias("point"), expected[F.col("i")].alias("normal_quantile"), "residual_quantile"
    )


def top_importance(importance: DataFrame, n: int = 20, keys: Sequence[str] = ()) -> DataFrame:
    """Largest absolute importances with their rank; ties go by feature name.

    Without keys this is a bounded top-k per partition followed by one merge.
    """
    size = F.abs("importance").desc()
    if not keys:
        return importance.orderBy(size, "feature").limit(n)
    # Spark prunes each partition to its own top n before shuffling for this pattern.
    order = W.partitionBy(*keys).orderBy(size, "feature")
    return importance.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
