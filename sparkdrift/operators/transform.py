"""Observation rows: storage layout, UTC, rounding, calendar features."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdrift.functions.timeparts import (
    cycle,
    dst_affected,
    ensure_utc,
    local_wall_clock,
    season,
    weekday,
)
from sparkdrift.operators.frames import require_columns

# Internal name -> storage name, and digits kept in storage.
STORAGE_NAMES = {
    "temperature": "temperature_2m",
    "humidity": "relative_humidity_2m",
    "wind_speed": "wind_speed_10m",
    "pressure": "surface_pressure",
}
STORAGE_DIGITS = {
    "temperature_2m": 2,
    "relative_humidity_2m": 1,
    "precipitation": 2,
    "wind_speed_10m": 2,
    "surface_pressure": 2,
    "latitude": 6,
    "longitude": 6,
}
RAW_COLUMNS = (
    "temperature_2m",
    "relative_humidity_2m",
    "precipitation",
    "wind_speed_10m",
    "surface_pressure",
)
DEFAULT_ZONE = "America/New_York"


def rename_existing(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def to_internal_names(df: DataFrame, names: Mapping[str, str] = STORAGE_NAMES) -> DataFrame:
    """Storage names back to internal names."""
    return rename_existing(df, {b: a for a, b in names.items()})


def resolve_column(df: DataFrame, name: str) -> str | None:
    """The column itself, or its short spelling without height suffix and qualifier."""
    for candidate in (name, name.replace("_2m", "").replace("relative_", "")):
        if candidate in df.columns:
            return candidate
    return None


def utc_time(df: DataFrame, time_column: str, tz: str = DEFAULT_ZONE) -> Column:
    """Zone-less times are read as wall clock of ``tz``; instants stay as they are."""
    if isinstance(df.schema[time_column].dataType, T.TimestampNTZType):
        return ensure_utc(F.col(time_column), tz)
    return F.col(time_column)


def utc_with_flag(df: DataFrame, time_column: str, tz: str = DEFAULT_ZONE, dst: str = "spark") -> DataFrame:
    """Replace a zone-less time by its UTC instant.

    ``dst='spark'`` keeps Spark's reading of skipped and repeated hours and flags those rows;
    ``dst='raise'`` fails on them.
    """
    if dst not in ("spark", "raise"):
        raise ValueError("dst must be 'spark' or 'raise'")
    affected = dst_affected(F.col(time_column), tz)
    flagged = df.withColumn("dst_affected", affected)
    utc = ensure_utc(F.col(time_column), tz)
    if dst == "raise":
        problem = F.concat(F.lit("skipped or repeated local hour: "), F.col(time_column).cast("string"))
        utc = F.when(affected, F.raise_error(problem).cast("timestamp")).otherwise(utc)
    return flagged.withColumn(time_column, utc)


def round_measures(df: DataFrame, digits: Mapping[str, int] = STORAGE_DIGITS) -> DataFrame:
    """Half-even rounding of the scaled double, the convention of array libraries; decimals are rounded
    as they are, so their halves stay halves."""

    def rounded(c: str, n: int) -> Column:
        if isinstance(df.schema[c].dataType, T.DecimalType):
            return F.bround(c, n).cast("double")
        scale = float(10**n)
        return F.rint(F.col(c).cast("double") * scale) / scale

    return df.withColumns({c: rounded(c, n) for c, n in digits.items() if c in df.columns})


def to_storage(
    df: DataFrame,
    source: str = "api",
    batch_id: str | None = None,
    tz: str = DEFAULT_ZONE,
    time_column: str = "timestamp",
    now: Column | None = None,
) -> DataFrame:
    """Storage layout: names, UTC, rounding, provenance columns and the rounded values as JSON.

    Without ``batch_id`` the call makes one for all its rows.
    """
    clock = F.current_timestamp() if now is None else now
    renamed = rename_existing(df, STORAGE_NAMES)
    if time_column in renamed.columns:
        renamed = renamed.withColumn(time_column, utc_time(renamed, time_column, tz))
    rounded = round_measures(renamed)
    present = [c for c in RAW_COLUMNS if c in rounded.columns]
    batch = F.lit(str(uuid.uuid4()) if batch_id is None else batch_id)
    added = {
        "ingestion_timestamp": clock,
        "data_source": F.lit(source),
        "batch_id": batch,
        "created_at": clock,
        "updated_at": clock,
    }
    if present:
        added["raw_data"] = F.to_json(F.struct(*present), {"ignoreNullFields": "false"})
    return rounded.withColumns(added)


def calendar_columns(ts: Column) -> dict[str, Column]:
    """Features derived from a wall clock; flags as 0/1 integers."""
    hour, day, month = F.hour(ts), weekday(ts), F.month(ts)
    hour_sin, hour_cos = cycle(hour, 24)
    day_sin, day_cos = cycle(day, 7)
    month_sin, month_cos = cycle(month - 1, 12)
    return {
        "hour_of_day": hour,
        "day_of_week": day,
        "day_of_year": F.dayofyear(ts),
        "month": month,
        "is_weekend": (day >= 5).cast("int"),
        "hour_sin": hour_sin,
        "hour_cos": hour_cos,
        "day_sin": day_sin,
        "day_cos": day_cos,
        "month_sin": month_sin,
        "month_cos": month_cos,
    }


def _wall_clock(df: DataFrame, time_column: str, tz: str | None) -> Column:
    """Instants are shown in ``tz``; zone-less times are taken as they are."""
    naive = isinstance(df.schema[time_column].dataType, T.TimestampNTZType)
    return F.col(time_column) if naive else local_wall_clock(F.col(time_column), tz)


def add_calendar(df: DataFrame, time_column: str = "timestamp", tz: str | None = DEFAULT_ZONE) -> DataFrame:
    """Calendar features for models."""
    require_columns(df, [time_column])
    return df.withColumns(calendar_columns(_wall_clock(df, time_column, tz)))


def add_temporal_features(
    df: DataFrame, time_column: str = "timestamp", tz: str | None = DEFAULT_ZONE
) -> DataFrame:
    """Calendar features for exploration: boolean weekend flag and season, no month cycle."""
    require_columns(df, [time_column])
    columns = calendar_columns(_wall_clock(df, time_column, tz))
    columns["is_weekend"] = columns["day_of_week"] >= 5
    columns["season"] = season(columns["month"])
    for name in ("month_sin", "month_cos"):
        del columns[name]
    return df.withColumns(columns)


def wanted_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Resolvable columns of a request; the others are skipped."""
    found = [resolve_column(df, n) for n in names]
    return [f for f in found if f is not None]
