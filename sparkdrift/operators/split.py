"""Feature assembly, the model matrix and the split by time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdrift.config import FeatureConfig
from sparkdrift.functions.timeparts import epoch_us
from sparkdrift.operators.frames import require_columns
from sparkdrift.operators.transform import DEFAULT_ZONE, add_calendar
from sparkdrift.operators.windows import (
    Series,
    Target,
    filled_features,
)


def feature_names(config: FeatureConfig = FeatureConfig()) -> list[str]:
    lags = [f"{c}_lag_{n}h" for c in config.lag_columns for n in config.lags]
    rolling = [
        f"{c}_rolling_{stat}_{n}h"
        for c in config.rolling_columns
        for n in config.windows
        for stat in ("mean", "std", "min", "max")
    ]
    return [*config.measures, *config.temporal, *config.extra_temporal, *lags, *rolling]


def build_features(
    df: DataFrame,
    series: Series,
    config: FeatureConfig = FeatureConfig(),
    tz: str | None = DEFAULT_ZONE,
    keep_position: bool = False,
) -> DataFrame:
    """Calendar, lag and rolling features of the unfilled measures, then forward fill."""
    return _features(df, series, config, tz, None, keep_position)


def _features(
    df: DataFrame, series: Series, config: FeatureConfig, tz: str | None, target: Target | None, keep_position: bool = False
) -> DataFrame:
    """All features, and the target if one is asked for, from one cut of the rows into chunks."""

    def fillable(widened: DataFrame) -> list[str]:
        return [c for c in numeric_columns(widened, config) if c not in series.keys and c not in series.tie]

    return filled_features(
        add_calendar(df, series.time, tz),
        series,
        [c for c in config.lag_columns if c in df.columns],
        config.lags,
        [c for c in config.rolling_columns if c in df.columns],
        config.windows,
        fillable,
        target,
        keep_position,
    )


def build_training_frame(
    df: DataFrame,
    series: Series,
    config: FeatureConfig = FeatureConfig(),
    tz: str | None = DEFAULT_ZONE,
) -> DataFrame:
    """Features plus the look-ahead target on the filled measure; incomplete rows are dropped."""
    require_columns(df, [config.target_source])
    return _features(df, series, config, tz, Target(config.target_source, config.target, config.horizon))


def numeric_columns(df: DataFrame, config: FeatureConfig = FeatureConfig()) -> list[str]:
    """Numeric columns that may serve as features."""
    banned = {*config.excluded, config.target}
    return [
        f.name
        for f in df.schema
        if f.name not in banned
        and isinstance(f.dataType, T.NumericType)
        and not f.name.startswith("__")
    ]


def non_empty_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with at least one value. Runs one aggregation: the model schema depends on it."""
    if not columns:
        return []
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    return [c for c in columns if counts[c] > 0]


def feature_matrix(
    df: DataFrame,
    config: FeatureConfig = FeatureConfig(),
    keep: Sequence[str] = (),
    features: Sequence[str] | None = None,
) -> DataFrame:
    """Features and target without incomplete rows; ``keep`` carries identifying columns along.

    Columns without any value are left out first, else they would drop every row. Passing
    ``features`` skips that check.
    """
    require_columns(df, [config.target])
    chosen = (
        non_empty_columns(df, [c for c in numeric_columns(df, config) if c not in keep])
        if features is None
        else list(features)
    )
    return df.select(*keep, *chosen, config.target).dropna(subset=[*chosen, config.target])


DAY_US = 86_400_000_000


def _cut_points(df: DataFrame, time_column: str, test_days: int, val_days: int) -> Column:
    """Start of the validation and test periods in epoch microseconds, as a scalar subquery."""
    needed = test_days + val_days + 1
    first, last = F.col("first"), F.col("last")
    days = F.floor((last - first) / DAY_US)
    too_short = F.format_string(
        f"insufficient data for split: have %d days, need at least {needed}", days
    )
    test = F.when(days < needed, F.raise_error(too_short).cast("long")).otherwise(
        last - test_days * DAY_US
    )
    return (
        df.agg(
            epoch_us(F.min(time_column)).alias("first"), epoch_us(F.max(time_column)).alias("last")
        )
        .select(
            F.struct(test.alias("test"), (last - (test_days + val_days) * DAY_US).alias("val"))
        )
        .scalar()
    )


def temporal_split(
    df: DataFrame, time_column: str = "timestamp", test_days: int = 7, validation_days: int = 3
) -> DataFrame:
    """Label rows train / val / test by time, the newest days being the test set.

    Too short a time range fails at run time.
    """
    require_columns(df, [time_column])
    cuts = _cut_points(df, time_column, test_days, validation_days)
    t = epoch_us(F.col(time_column))
    label = (
        F.when(t >= cuts["test"], "test").when(t >= cuts["val"], "val").otherwise("train")
    )
    return df.withColumn("split", label)


def split_info(labelled: DataFrame, time_column: str = "timestamp") -> DataFrame:
    """Sample count and date range per split."""
    return labelled.groupBy("split").agg(
        F.count(F.lit(1)).alias("samples"),
        F.min(time_column).alias("start"),
        F.max(time_column).alias("end"),
    )
