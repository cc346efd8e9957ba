"""Time-series features, splits and model matrices."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from contract.registry import query
from contract.views import (
    DENSE_SQL,
    MEASURES,
    OBS_FEATURES,
    OBS_SQL,
    SERIES,
    events,
    obs,
    obs_dense,
    table,
)
from sparkdrift.config import TrainingConfig
from sparkdrift.operators import windows as W
from sparkdrift.operators.split import (
    build_training_frame,
    feature_matrix,
    split_info,
    temporal_split,
)
from sparkdrift.operators.transform import add_calendar, add_temporal_features, to_storage
from sparkdrift.functions.timeparts import ensure_utc
from sparkdrift.plans.training import prepare_data, time_folds

EVENT_SERIES = W.Series(("event_type",), "ts", ("event_id",))
TRAINING = TrainingConfig(test_days=5, validation_days=3)

_W = "PARTITION BY event_type ORDER BY hour"


@query(
    "densify_hourly",
    "event_type:s hour:t avg_value:f6 max_value:f6 n_events:f1",
    f"WITH {DENSE_SQL} SELECT * FROM dense",
)
def _(spark, sf):
    return obs_dense(spark, sf)


@query(
    "lag_features",
    "event_id:i value_lag_1h:f6 value_lag_6h:f6 value_lag_24h:f6",
    """SELECT event_id, lag(value, 1) OVER w AS value_lag_1h, lag(value, 6) OVER w AS value_lag_6h,
  lag(value, 24) OVER w AS value_lag_24h
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""",
)
def _(spark, sf):
    return W.add_lags(events(spark, sf), ["value"], EVENT_SERIES)


def _rolling_sql(c: str, size: int, window: str) -> str:
    frame = f"({window} ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW)"
    return ", ".join(
        f"{f}({c}) OVER {frame} AS {c}_rolling_{n}_{size}h"
        for f, n in (("avg", "mean"), ("stddev_samp", "std"), ("min", "min"), ("max", "max"))
    )


_EW = "PARTITION BY event_type ORDER BY ts, event_id"


@query(
    "rolling_features",
    "event_id:i "
    + " ".join(f"value_rolling_{s}_{n}h:f6" for n in (6, 24) for s in ("mean", "std", "min", "max")),
    f"SELECT event_id, {_rolling_sql('value', 6, _EW)}, {_rolling_sql('value', 24, _EW)} FROM events",
)
def _(spark, sf):
    return W.add_rolling(events(spark, sf), ["value"], EVENT_SERIES)


def _future_sql(c: str, h: int, need: int, window: str = _EW) -> str:
    frame = f"({window} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    return f"CASE WHEN count(*) OVER {frame} >= {need} THEN max({c}) OVER {frame} END"


@query(
    "future_max_strict",
    "event_id:i target:f6",
    f"""SELECT * FROM (SELECT event_id, {_future_sql("value", 24, 12)} AS target FROM events)
WHERE target IS NOT NULL""",
)
def _(spark, sf):
    return W.future_max(events(spark, sf), "value", EVENT_SERIES)


@query(
    "future_max_lenient",
    "event_id:i next_day_max_temp:f6",
    f"SELECT event_id, {_future_sql('value', 24, 1)} AS next_day_max_temp FROM events",
)
def _(spark, sf):
    return W.future_max_lenient(events(spark, sf), "value", EVENT_SERIES)


@query(
    "ffill_features",
    "event_type:s hour:t avg_value:f6 max_value:f6",
    f"""WITH {DENSE_SQL}
SELECT event_type, hour, last_value(avg_value IGNORE NULLS) OVER w AS avg_value,
  last_value(max_value IGNORE NULLS) OVER w AS max_value
FROM dense WINDOW w AS ({_W} ROWS UNBOUNDED PRECEDING)""",
)
def _(spark, sf):
    return W.fill_features(obs_dense(spark, sf), ["avg_value", "max_value"], SERIES)


_CALENDAR_SQL = """extract(hour FROM {t}) AS hour_of_day, isodow({t}) - 1 AS day_of_week,
  dayofyear({t}) AS day_of_year, extract(month FROM {t}) AS month"""


@query(
    "temporal_features",
    "event_id:i hour_of_day:i day_of_week:i day_of_year:i month:i is_weekend:b season:s",
    f"""SELECT *, day_of_week >= 5 AS is_weekend,
  CASE WHEN month IN (12, 1, 2) THEN 'winter' WHEN month IN (3, 4, 5) THEN 'spring'
       WHEN month IN (6, 7, 8) THEN 'summer' ELSE 'fall' END AS season
FROM (SELECT event_id, {_CALENDAR_SQL.format(t="ts")} FROM events)""",
)
def _(spark, sf):
    return add_temporal_features(events(spark, sf), "ts")


@query(
    "temporal_features_orders",
    "o_orderkey:i day_of_week:i day_of_year:i month:i is_weekend:b season:s",
    f"""SELECT *, day_of_week >= 5 AS is_weekend,
  CASE WHEN month IN (12, 1, 2) THEN 'winter' WHEN month IN (3, 4, 5) THEN 'spring'
       WHEN month IN (6, 7, 8) THEN 'summer' ELSE 'fall' END AS season
FROM (SELECT o_orderkey, {_CALENDAR_SQL.format(t="o_orderdate")} FROM orders)""",
)
def _(spark, sf):
    return add_temporal_features(table(spark, sf, "orders"), "o_orderdate")


@query(
    "cyclical_features",
    "event_id:i is_weekend:i hour_sin:f6 hour_cos:f6 day_sin:f6 day_cos:f6 month_sin:f6 month_cos:f6",
    f"""SELECT event_id, CAST(day_of_week >= 5 AS INTEGER) AS is_weekend,
  sin(2 * pi() * hour_of_day / 24) AS hour_sin, cos(2 * pi() * hour_of_day / 24) AS hour_cos,
  sin(2 * pi() * day_of_week / 7) AS day_sin, cos(2 * pi() * day_of_week / 7) AS day_cos,
  sin(2 * pi() * (month - 1) / 12) AS month_sin, cos(2 * pi() * (month - 1) / 12) AS month_cos
FROM (SELECT event_id, {_CALENDAR_SQL.format(t="ts")} FROM events)""",
)
def _(spark, sf):
    return add_calendar(events(spark, sf), "ts")


# Daylight saving in New York for the years of the orders table: from the first Sunday of April to the
# last Sunday of October, two o'clock in the morning.
_DST_SQL = """CASE WHEN o_orderdate > april AND o_orderdate <= october THEN 4 ELSE 5 END"""


@query(
    "ensure_utc",
    "o_orderkey:i utc:t",
    f"""SELECT o_orderkey, o_orderdate + to_hours({_DST_SQL}) AS utc FROM (
  SELECT *, a + to_days(CAST((7 - isodow(a)) % 7 AS INTEGER)) AS april,
         o - to_days(CAST(isodow(o) % 7 AS INTEGER)) AS october FROM (
    SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS o_orderdate,
           CAST(make_date(year(o_orderdate), 4, 1) AS TIMESTAMP) AS a,
           CAST(make_date(year(o_orderdate), 10, 31) AS TIMESTAMP) AS o FROM orders))""",
)
def _(spark, sf):
    utc = ensure_utc(F.col("o_orderdate"), "America/New_York")
    return table(spark, sf, "orders").select("o_orderkey", utc.alias("utc"))


@query(
    "to_storage",
    "location_name:s timestamp:t temperature_2m:f2 relative_humidity_2m:f1 surface_pressure:f2 "
    "data_source:s batch_id:s raw_data:s",
    f"""WITH obs AS ({OBS_SQL}),
r AS (SELECT event_type AS location_name, hour AS timestamp,
        round_even(max_value * 0.1 * 100, 0) / 100 AS temperature_2m,
        round_even(n_events * 1.37 * 10, 0) / 10 AS relative_humidity_2m,
        CASE WHEN n_events > 1 THEN round_even(max_value * 3.3 * 100, 0) / 100 END AS surface_pressure
      FROM obs)
SELECT *, 'events' AS data_source, 'b1' AS batch_id,
  '{{"temperature_2m":' || CAST(temperature_2m AS VARCHAR) || ',"relative_humidity_2m":'
   || CAST(relative_humidity_2m AS VARCHAR) || ',"surface_pressure":'
   || coalesce(CAST(surface_pressure AS VARCHAR), 'null') || '}}' AS raw_data FROM r""",
)
def _(spark, sf):
    rows = obs(spark, sf).select(
        F.col("event_type").alias("location_name"),
        F.col("hour").alias("timestamp"),
        (F.col("max_value") * 0.1).alias("temperature"),
        (F.col("n_events") * F.lit(Decimal("1.37"))).alias("humidity"),
        F.when(F.col("n_events") > 1, F.col("max_value") * 3.3).alias("pressure"),
    )
    return to_storage(rows, "events", "b1", tz="UTC")


# ------------------------------------------------------------------------- composed feature building

_LAGS = ", ".join(
    f"lag({c}, {n}) OVER w AS {c}_lag_{n}h" for c in ("avg_value", "max_value") for n in (1, 6, 24)
)
_LAG_NAMES = [f"{c}_lag_{n}h" for c in ("avg_value", "max_value") for n in (1, 6, 24)]
_ROLL_NAMES = [f"max_value_rolling_{s}_{n}h" for n in (6, 24) for s in ("mean", "std", "min", "max")]
_CAL_NAMES = [
    "hour_of_day", "day_of_week", "day_of_year", "month", "is_weekend", "hour_sin", "hour_cos",
    "day_sin", "day_cos", "month_sin", "month_cos",
]


def _filled(name: str) -> str:
    source = f"coalesce({name}, 0)" if "_rolling_std_" in name else name
    return f"last_value({source} IGNORE NULLS) OVER w AS {name}"


_FEATURES_SQL = f"""{DENSE_SQL},
raw AS (
  SELECT *, {_LAGS}, {_rolling_sql("max_value", 6, _W)}, {_rolling_sql("max_value", 24, _W)}
  FROM dense WINDOW w AS ({_W})),
filled AS (
  SELECT event_type, hour, {", ".join(_filled(c) for c in [*MEASURES, *_LAG_NAMES, *_ROLL_NAMES])}
  FROM raw WINDOW w AS ({_W} ROWS UNBOUNDED PRECEDING)),
cal AS (
  SELECT *, CAST(day_of_week >= 5 AS INTEGER) AS is_weekend,
    sin(2 * pi() * hour_of_day / 24) AS hour_sin, cos(2 * pi() * hour_of_day / 24) AS hour_cos,
    sin(2 * pi() * day_of_week / 7) AS day_sin, cos(2 * pi() * day_of_week / 7) AS day_cos,
    sin(2 * pi() * (month - 1) / 12) AS month_sin, cos(2 * pi() * (month - 1) / 12) AS month_cos
  FROM (SELECT *, {_CALENDAR_SQL.format(t="hour")} FROM filled)),
tgt AS (SELECT * FROM (SELECT *, {_future_sql("max_value", 24, 12, _W)} AS target FROM cal)
        WHERE target IS NOT NULL)"""


@query(
    "feature_build",
    "event_type:s hour:t "
    + " ".join(f"{c}:f7" for c in [*MEASURES, *_LAG_NAMES, *_ROLL_NAMES, *_CAL_NAMES, "target"]),
    f"WITH {_FEATURES_SQL} SELECT * FROM tgt",
)
def _(spark, sf):
    return build_training_frame(obs_dense(spark, sf), SERIES, OBS_FEATURES, None)


_ALL = [*MEASURES, *_CAL_NAMES, *_LAG_NAMES, *_ROLL_NAMES]
_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in [*_LAG_NAMES, *_ROLL_NAMES, *MEASURES])


@query(
    "feature_matrix",
    "event_type:s hour:t target:f6 " + " ".join(f"{c}:f7" for c in _ALL),
    f"WITH {_FEATURES_SQL} SELECT * FROM tgt WHERE {_COMPLETE}",
)
def _(spark, sf):
    dense = obs_dense(spark, sf).withColumn("wind_direction", F.lit(None).cast("double"))
    frame = build_training_frame(dense, SERIES, OBS_FEATURES, None)
    return feature_matrix(frame, OBS_FEATURES, keep=["event_type", "hour"])


_SPLIT_SQL = """CASE WHEN {t} >= mx - INTERVAL 5 DAYS THEN 'test'
  WHEN {t} >= mx - INTERVAL 8 DAYS THEN 'val' ELSE 'train' END"""


@query(
    "temporal_split",
    "split:s samples:i start:t end:t",
    f"""SELECT split, count(*) AS samples, min(ts) AS start, max(ts) AS "end" FROM (
  SELECT ts, {_SPLIT_SQL.format(t="ts")} AS split FROM events, (SELECT max(ts) AS mx FROM events))
GROUP BY split""",
)
def _(spark, sf):
    return split_info(temporal_split(events(spark, sf), "ts", 5, 3), "ts")


@query(
    "training_set",
    "event_type:s hour:t split:s target:f6 avg_value:f6 max_value_lag_24h:f6 "
    "max_value_rolling_std_6h:f6",
    f"""WITH {_FEATURES_SQL}
SELECT *, {_SPLIT_SQL.format(t="hour")} AS split FROM tgt, (SELECT max(hour) AS mx FROM tgt)
WHERE {_COMPLETE}""",
)
def _(spark, sf):
    return prepare_data(obs_dense(spark, sf), SERIES, OBS_FEATURES, TRAINING, None, _ALL)


@query(
    "time_folds",
    "segment:i n:i start:t end:t",
    """SELECT segment, count(*) AS n, min(ts) AS start, max(ts) AS "end" FROM (
  SELECT ts, least(floor((epoch_us(ts) - a) / CAST(b - a AS DOUBLE) * 6), 5) AS segment
  FROM events, (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM events))
GROUP BY segment""",
)
def _(spark, sf):
    return (
        time_folds(events(spark, sf), "ts", 5)
        .groupBy("segment")
        .agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("start"), F.max("ts").alias("end"))
    )


@query(
    "features_single_series",
    "event_id:i value_lag_1h:f6 value_rolling_mean_6h:f6",
    """SELECT event_id, lag(value) OVER (ORDER BY ts, event_id) AS value_lag_1h,
  avg(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS value_rolling_mean_6h
FROM events""",
)
def _(spark, sf):
    # One series over the whole table, in chunks small enough that borrowing rows matters.
    series = W.Series((), "ts", ("event_id",), chunk_rows=1_000)
    return W.add_lags_and_rolling(events(spark, sf), series, ["value"], [1], ["value"], [6])
