"""Hourly JSON payloads: checks and parsing.

A payload is one JSON document per row: an object ``hourly`` with parallel arrays, ``time`` and one
per variable.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdrift.functions.timeparts import require_utc

# Payload variables and their internal names.
VARIABLE_NAMES = {
    "temperature_2m": "temperature",
    "relative_humidity_2m": "humidity",
    "precipitation": "precipitation",
    "wind_speed_10m": "wind_speed",
    "pressure_msl": "pressure",
}
LOCATION_COLUMNS = ("location_name", "latitude", "longitude")


def hourly_schema(variables: Sequence[str] = tuple(VARIABLE_NAMES)) -> T.StructType:
    arrays = [T.StructField(v, T.ArrayType(T.DoubleType())) for v in variables]
    hourly = T.StructType([T.StructField("time", T.ArrayType(T.StringType())), *arrays])
    return T.StructType([T.StructField("hourly", hourly)])


def reject_reason(json: Column, variables: Sequence[str] = tuple(VARIABLE_NAMES)) -> Column:
    """Why a payload is unusable, or NULL."""
    hourly = F.from_json(json, hourly_schema(variables))["hourly"]
    keys = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    none_present = F.lit(True)
    wrong_length = F.lit(False)
    for v in variables:
        none_present = none_present & hourly[v].isNull()
        wrong_length = wrong_length | F.coalesce(
            F.size(hourly[v]) != F.size(hourly["time"]), F.lit(False)
        )
    return (
        F.when(F.array_contains(keys, "error"), "error response")
        .when(hourly.isNull(), "missing hourly data")
        .when(hourly["time"].isNull(), "missing time axis")
        .when(none_present, "no known variable")
        .when(wrong_length, "array length mismatch")
    )


def validate_payload(
    df: DataFrame, json_column: str, variables: Sequence[str] = tuple(VARIABLE_NAMES)
) -> DataFrame:
    """Add ``reject_reason``; NULL marks a usable payload."""
    return df.withColumn("reject_reason", reject_reason(F.col(json_column), variables))


def split_payloads(
    df: DataFrame, json_column: str, variables: Sequence[str] = tuple(VARIABLE_NAMES)
) -> tuple[DataFrame, DataFrame]:
    """(usable, quarantined) payloads."""
    checked = validate_payload(df, json_column, variables)
    bad = F.col("reject_reason").isNotNull()
    return checked.where(~bad).drop("reject_reason"), checked.where(bad)


def parse_hourly_payload(
    df: DataFrame,
    json_column: str,
    variables: Mapping[str, str] = VARIABLE_NAMES,
    keep: Sequence[str] = LOCATION_COLUMNS,
    position: str | None = None,
) -> DataFrame:
    """One row per hour: time, the kept columns of the payload row, then the renamed variables.

    A variable the payload lacks comes out as NULL. Times are UTC, and so must
    the session's zone be.
    ``position`` names a column for the place in the payload's arrays.
    """
    require_utc(df.sparkSession)
    hourly = F.from_json(F.col(json_column), hourly_schema(tuple(variables)))["hourly"]
    parsed = df.select(*[c for c in keep if c in df.columns], hourly.alias("h"))
    times = F.coalesce(F.col("h.time"), F.array().cast("array<string>"))
    series = [
        F.coalesce(F.col(f"h.{v}"), F.array().cast("array<double>")).alias(v) for v in variables
    ]
    kept = [c for c in parsed.columns if c != "h"]
    zipped = F.arrays_zip(times.alias("time"), *series)
    rows = parsed.select(*kept, F.posexplode(zipped).alias("__position", "__row"))
    rows = rows.select(*kept, "__position", "__row.*")
    return rows.select(
        F.col("time").cast("timestamp").alias("timestamp"),
        *kept,
        *([F.col("__position").alias(position)] if position else []),
        *[F.col(v).alias(name) for v, name in variables.items()],
    )


def to_payload(
    df: DataFrame, keys: Sequence[str], time_column: str, variables: Mapping[str, str]
) -> DataFrame:
    """Inverse of parsing: pack the rows of each key group into one payload document.

    ``variables`` maps row columns to payload variables. The keys must bound a group, such as one
    location and day.
    """
    stamp = F.date_format(F.col(time_column), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    packed = F.array_sort(
        F.collect_list(F.struct(stamp.alias("time"), *[F.col(c).alias(v) for c, v in variables.items()]))
    )
    arrays = F.struct(
        F.col("rows.time").alias("time"), *[F.col(f"rows.{v}").alias(v) for v in variables.values()]
    )
    return (
        df.groupBy(*keys)
        .agg(packed.alias("rows"))
        .select(*keys, F.to_json(F.struct(arrays.alias("hourly"))).alias("payload"))
    )
