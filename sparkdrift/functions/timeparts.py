"""Calendar expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SEASON_OF_MONTH = {
    # Northern-hemisphere season per calendar month.
    1: "winter", 2: "winter", 3: "spring", 4: "spring", 5: "spring", 6: "summer",
    7: "summer", 8: "summer", 9: "fall", 10: "fall", 11: "fall", 12: "winter",
}


def epoch_us(ts: Column) -> Column:
    """Microseconds since the epoch; the session time zone is expected to be UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def epoch_s(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def hours_between(later: Column, earlier: Column) -> Column:
    return (epoch_us(later) - epoch_us(earlier)) / F.lit(3_600_000_000.0)


def local_wall_clock(ts: Column, tz: str | None) -> Column:
    """Instant -> wall clock of ``tz``; a None zone leaves the value as it is."""
    return ts if tz is None else F.from_utc_timestamp(ts.cast("timestamp"), tz)


def ensure_utc(ts: Column, tz: str) -> Column:
    """Naive wall clock of ``tz`` -> UTC instant."""
    return F.to_utc_timestamp(ts.cast("timestamp"), tz)


def dst_affected(ts: Column, tz: str) -> Column:
    """True for wall-clock times that do not exist in ``tz`` or occur twice there."""
    naive = ts.cast("timestamp")
    utc = F.to_utc_timestamp(naive, tz)
    missing = F.from_utc_timestamp(utc, tz) != naive
    hour = F.expr("INTERVAL 1 HOUR")
    # In the repeated hour the instant one hour later shows the same wall clock.
    repeated = (F.from_utc_timestamp(utc + hour, tz) == naive) | (
        F.from_utc_timestamp(utc - hour, tz) == naive
    )
    return missing | repeated


def require_utc(spark: SparkSession) -> None:
    """Refuse a session in which zone-less texts and dates would not be read as UTC."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"the session time zone is {zone}; set spark.sql.session.timeZone to UTC")


def weekday(ts: Column) -> Column:
    """Monday = 0 .. Sunday = 6."""
    return F.weekday(ts)


def season(month: Column) -> Column:
    expr = None
    for number, name in SEASON_OF_MONTH.items():
        expr = F.when(month == number, name) if expr is None else expr.when(month == number, name)
    return expr


def cycle(position: Column, period: int) -> tuple[Column, Column]:
    """(sin, cos) of a position on a cycle of the given length."""
    angle = F.lit(2.0 * math.pi) * position / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


TRUNC_UNIT = {"H": "hour", "D": "day", "W": "week"}


def period_start(ts: Column, freq: str) -> Column:
    """Start of the hour, day or Monday-based week that holds ``ts``."""
    if freq not in TRUNC_UNIT:
        raise ValueError(f"unknown period '{freq}', expected one of {sorted(TRUNC_UNIT)}")
    return F.date_trunc(TRUNC_UNIT[freq], ts)
