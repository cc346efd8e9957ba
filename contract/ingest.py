"""Payloads, the keyed table, logs and ingestion jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract.registry import query
from contract.views import (
    CUT,
    EVENT_CUT,
    IS_REF_SQL,
    OBS_SQL,
    at,
    current_side,
    events,
    lineitem,
    obs,
    reference_side,
    shared_dir,
    table,
)
from sparkdrift.functions.text import (
    dataset_metric_name,
    importance_metric_name,
    sanitize_metric_name,
)
from sparkdrift.operators.history import runs_summary
from sparkdrift.operators.transform import to_storage
from sparkdrift.plans import ingest as I
from sparkdrift.sources import table as S
from sparkdrift.sources.payload import parse_hourly_payload, to_payload, validate_payload
from sparkdrift.sources.runs import log_rows, recent_runs

# Events per payload document; ids are unique, so a payload can never grow beyond it.
PER_PAYLOAD = 48
VARIABLES = {"value": "temperature_2m", "user_id": "relative_humidity_2m"}


def _payloads(spark, sf):
    tagged = events(spark, sf).withColumn(
        "payload_id", F.floor(F.col("event_id") / PER_PAYLOAD).cast("long")
    )
    return to_payload(tagged, ["payload_id"], "ts", VARIABLES)


@query(
    "parse_payload",
    "payload_id:i timestamp:t temperature:f6 humidity:f6 precipitation:f6",
    f"""SELECT event_id // {PER_PAYLOAD} AS payload_id, ts AS timestamp, value AS temperature,
  user_id AS humidity, CAST(NULL AS DOUBLE) AS precipitation FROM events""",
)
def _(spark, sf):
    return parse_hourly_payload(_payloads(spark, sf), "payload", keep=["payload_id"])


def _broken(spark, sf):
    """Payloads damaged in one of five ways, by their id."""
    p, kind = F.col("payload"), F.col("payload_id") % 7
    damaged = (
        F.when(kind == 0, F.lit('{"error":true,"reason":"no such station"}'))
        .when(kind == 1, F.lit('{"latitude":1.5}'))
        .when(kind == 2, F.replace(p, F.lit('"time":'), F.lit('"clock":')))
        .when(
            kind == 3,
            F.replace(
                F.replace(p, F.lit("temperature_2m"), F.lit("a")),
                F.lit("relative_humidity_2m"),
                F.lit("b"),
            ),
        )
        .when(kind == 4, F.replace(p, F.lit('"temperature_2m":['), F.lit('"temperature_2m":[0.5,')))
        .otherwise(p)
    )
    return _payloads(spark, sf).withColumn("payload", damaged)


@query(
    "payload_rejects",
    "payload_id:i reject_reason:s",
    f"""SELECT DISTINCT event_id // {PER_PAYLOAD} AS payload_id,
  CASE (event_id // {PER_PAYLOAD}) % 7 WHEN 0 THEN 'error response' WHEN 1 THEN 'missing hourly data'
    WHEN 2 THEN 'missing time axis' WHEN 3 THEN 'no known variable'
    WHEN 4 THEN 'array length mismatch' END AS reject_reason FROM events""",
)
def _(spark, sf):
    return validate_payload(_broken(spark, sf), "payload")


@query(
    "route_source",
    "o_orderkey:i source:s",
    f"""SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '{CUT}' - INTERVAL 5 DAYS THEN 'archive'
  ELSE 'recent' END AS source FROM orders""",
)
def _(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", S.route_source(F.col("o_orderdate"), at(CUT)).alias("source")
    )


@query(
    "latest_hours",
    "event_id:i ts:t value:f6",
    "SELECT event_id, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 48 HOURS",
)
def _(spark, sf):
    return S.latest_hours(events(spark, sf), 48, at("2024-01-20 00:00:00"), "ts")


@query(
    "scan_timerange",
    "event_id:i ts:t value:f6",
    """SELECT event_id, ts, value FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12' AND event_type = 'click'""",
)
def _(spark, sf):
    return S.scan_timerange(
        events(spark, sf), "2024-01-05 00:00:00", "2024-01-12 00:00:00", "ts", "click", "event_type"
    )


@query(
    "prepare_period",
    "event_id:i ts:t value:f6",
    """SELECT event_id, ts, value FROM events WHERE event_type = 'click'
  AND ts >= (SELECT max(ts) - INTERVAL 7 DAYS FROM events WHERE event_type = 'click')""",
)
def _(spark, sf):
    return S.in_period(
        events(spark, sf), 7, time_column="ts", location="click", location_column="event_type"
    )


@query(
    "latest_ts", "latest_timestamp:t", "SELECT max(ts) AS latest_timestamp FROM events"
)
def _(spark, sf):
    return S.latest_timestamp(events(spark, sf), "ts")


@query(
    "record_count",
    "scope:s record_count:i",
    """SELECT 'all' AS scope, count(*) AS record_count FROM lineitem
UNION ALL SELECT 'R', count(*) FILTER (WHERE l_returnflag = 'R') FROM lineitem""",
)
def _(spark, sf):
    li = lineitem(spark, sf)
    everything = S.record_count(li).withColumn("scope", F.lit("all"))
    return everything.unionByName(
        S.record_count(li, "R", "l_returnflag").withColumn("scope", F.lit("R"))
    )


@query(
    "latest_rows",
    "event_id:i ts:t event_type:s",
    "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id LIMIT 3",
)
def _(spark, sf):
    return S.latest_rows(events(spark, sf), 3, "ts", ["event_id"])


# ------------------------------------------------------------------------------------- keyed table

LI_KEY = ["l_orderkey", "l_linenumber"]
LI_UPDATED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LI_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", *LI_UPDATED]
_ORDER_SQL = ", ".join(LI_ORDER)


def _li_columns(df):
    return df.select(*LI_KEY, *LI_ORDER, "l_returnflag")


@query(
    "append_conflicts",
    "l_orderkey:i l_linenumber:i incoming_rows:i in_table:b",
    f"""WITH inc AS (SELECT l_orderkey, l_linenumber, count(*) AS incoming_rows FROM lineitem
  WHERE NOT ({IS_REF_SQL}) GROUP BY ALL),
ref AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE {IS_REF_SQL})
SELECT inc.*, ref.l_orderkey IS NOT NULL AS in_table FROM inc LEFT JOIN ref
  ON ref.l_orderkey = inc.l_orderkey AND ref.l_linenumber = inc.l_linenumber
WHERE incoming_rows > 1 OR ref.l_orderkey IS NOT NULL""",
)
def _(spark, sf):
    li = lineitem(spark, sf)
    return S.append_conflicts(reference_side(li), current_side(li), LI_KEY)


@query(
    "upsert_latest",
    "l_orderkey:i l_linenumber:i l_quantity:f2 l_extendedprice:f2 l_discount:f2 l_tax:f2 "
    "l_suppkey:i l_shipdate:t l_returnflag:s",
    f"""WITH r AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_ORDER_SQL}) AS first_no,
    count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem)
SELECT a.l_orderkey, a.l_linenumber, b.l_quantity, b.l_extendedprice, b.l_discount, b.l_tax,
  a.l_suppkey, a.l_shipdate, a.l_returnflag
FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber
WHERE a.first_no = 1 AND b.first_no = b.n""",
)
def _(spark, sf):
    li = _li_columns(lineitem(spark, sf))
    stored = S.merge_rows(None, reference_side(li), LI_KEY, LI_UPDATED, LI_ORDER)
    return S.merge_rows(stored, current_side(li), LI_KEY, LI_UPDATED, LI_ORDER)


@query(
    "upsert_new_rows",
    "l_orderkey:i l_linenumber:i l_suppkey:i l_quantity:f2",
    f"""SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity FROM lineitem a
WHERE NOT ({IS_REF_SQL}) AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey
  AND b.l_linenumber = a.l_linenumber AND b.l_shipdate < TIMESTAMP '{CUT}')""",
)
def _(spark, sf):
    li = lineitem(spark, sf)
    return S.new_rows(reference_side(li), current_side(li), LI_KEY)


# The stand-in measures are counts and maxima of events; neither is bounded as weather is.
STAND_IN_TYPES = S.DECIMALS | {"temperature_2m": (18, 2), "precipitation": (18, 2)}


def _storage_frame(spark, sf, *counted):
    """Observations as stored; their humidity stays a percentage, however many events an hour holds."""
    rows = obs(spark, sf).select(
        *[F.col("n_events").cast("double").alias(c) for c in counted],
        F.lit(40.5).alias("latitude"),
        (F.ascii("event_type") * 1.0).alias("longitude"),
        F.col("hour").alias("timestamp"),
        (F.col("max_value") / 10).alias("temperature"),
        (F.col("n_events") % 100).cast("double").alias("humidity"),
        F.col("event_type").alias("unknown_column"),
    )
    return to_storage(rows, "events", "b7", tz="UTC", now=F.lit("2024-02-01").cast("timestamp"))


@query(
    "prepare_rows",
    "location_name:s latitude:f6 longitude:f6 timestamp:t temperature_2m:f2 batch_id:s "
    "data_source:s created_at:t",
    f"""WITH obs AS ({OBS_SQL})
SELECT 'Unknown' AS location_name, 40.5 AS latitude, ascii(event_type) AS longitude, hour AS timestamp,
  round_even(max_value / 10 * 100, 0) / 100 AS temperature_2m, 'b7' AS batch_id,
  'events' AS data_source, TIMESTAMP '2024-02-01' AS created_at FROM obs""",
)
def _(spark, sf):
    return S.prepare_rows(_storage_frame(spark, sf), "b8").drop("id")


@query(
    "table_roundtrip",
    "dt:s n:i total:f2 newest:t",
    f"""WITH obs AS ({OBS_SQL})
SELECT strftime(hour, '%Y-%m-%d') AS dt, count(*) AS n,
  sum(CASE WHEN hour >= TIMESTAMP '2024-01-16'
    THEN round_even((round_even(max_value / 10 * 100, 0) / 100 + 1) * 100, 0) / 100
    ELSE round_even(max_value / 10 * 100, 0) / 100 END) AS total, max(hour) AS newest
FROM obs GROUP BY 1""",
)
def _(spark, sf):
    # Store everything, then deliver the second half again with corrected values.
    path = shared_dir(spark)
    rows = S.prepare_rows(_storage_frame(spark, sf), "b7")
    S.upsert(spark, path, rows, decimals=STAND_IN_TYPES)
    later = rows.where(F.col("timestamp") >= "2024-01-16").withColumns(
        {
            "temperature_2m": F.rint((F.col("temperature_2m") + 1) * 100) / 100,
            "updated_at": F.col("updated_at") + F.expr("INTERVAL 1 DAY"),
        }
    )
    S.upsert(spark, path, later, decimals=STAND_IN_TYPES)
    return (
        S.from_table_types(spark.read.parquet(path))
        .groupBy(F.col("dt").cast("string").alias("dt"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("temperature_2m").alias("total"),
            F.max("timestamp").alias("newest"),
        )
    )


@query(
    "upsert_partial_columns",
    "latitude:f6 longitude:f6 timestamp:t temperature_2m:f2 precipitation:f2 location_name:s",
    f"""WITH obs AS ({OBS_SQL}),
kept AS (SELECT event_type, hour, round_even(max_value / 10 * 100, 0) / 100 AS t,
  round_even(n_events * 100, 0) / 100 AS p FROM obs)
SELECT 40.5 AS latitude, ascii(event_type) AS longitude, hour AS timestamp,
  CASE WHEN hour >= TIMESTAMP '{EVENT_CUT}' AND event_type = 'click' THEN t + 1 ELSE t END AS temperature_2m,
  CASE WHEN hour >= TIMESTAMP '{EVENT_CUT}' AND event_type = 'click' THEN NULL ELSE p END AS precipitation,
  'Unknown' AS location_name FROM kept""",
)
def _(spark, sf):
    # The second delivery lacks one measure and reaches only some rows of the dates that it touches.
    path = shared_dir(spark)
    rows = S.prepare_rows(_storage_frame(spark, sf, "precipitation"), "b7")
    S.upsert(spark, path, rows, decimals=STAND_IN_TYPES)
    chosen = (F.col("timestamp") >= EVENT_CUT) & (F.col("longitude") == ord("c"))
    later = rows.where(chosen).drop("precipitation")
    later = later.withColumns(
        {
            "temperature_2m": F.rint((F.col("temperature_2m") + 1) * 100) / 100,
            "updated_at": F.col("updated_at") + F.expr("INTERVAL 1 DAY"),
        }
    )
    S.upsert(spark, path, later, decimals=STAND_IN_TYPES)
    return S.from_table_types(spark.read.parquet(path))


@query(
    "upsert_batch_order",
    "longitude:f6 timestamp:t temperature_2m:f2",
    """SELECT ascii(event_type) AS longitude, date_trunc('hour', ts) AS timestamp,
  round_even(arg_max(value, event_id) / 10 * 100, 0) / 100 AS temperature_2m FROM events GROUP BY 1, 2""",
)
def _(spark, sf):
    # All events of an hour are one key of one batch; the last one to arrive stays.
    path = shared_dir(spark)
    rows = events(spark, sf).select(
        F.lit(40.5).alias("latitude"),
        (F.ascii("event_type") * 1.0).alias("longitude"),
        F.date_trunc("hour", "ts").alias("timestamp"),
        (F.col("value") / 10).alias("temperature"),
        "event_id",
    )
    stored = to_storage(rows, "events", "b7", tz="UTC", now=F.lit("2024-02-01").cast("timestamp"))
    rows = S.prepare_rows(stored, "b7", arrival=["event_id"])
    S.upsert(spark, path, rows, arrival=["event_id"], decimals=STAND_IN_TYPES)
    return S.from_table_types(spark.read.parquet(path))


# --------------------------------------------------------------------------------------------- runs


def _day_log(spark, sf):
    """One ingestion run per day and event type, graded by its share of plausible values."""
    value = F.col("value")
    runs = (
        events(spark, sf)
        .groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type")
        .agg(
            F.count(F.lit(1)).alias("records_fetched"),
            F.count_if(value.between(1, 200)).alias("records_stored"),
            F.max("ts").alias("created_at"),
        )
    )
    quality = F.round(F.col("records_stored") / F.col("records_fetched"), 4)
    return runs.select(
        F.concat("day", F.lit("-"), "event_type").alias("batch_id"),
        "records_fetched",
        "records_stored",
        quality.alias("quality_score"),
        F.when(quality >= 0.9, "success").otherwise("failed").alias("status"),
        "created_at",
    )


_LOG_SQL = """log AS (
  SELECT *, CASE WHEN quality_score >= 0.9 THEN 'success' ELSE 'failed' END AS status FROM (
    SELECT strftime(ts, '%Y-%m-%d') || '-' || event_type AS batch_id, count(*) AS records_fetched,
      count(*) FILTER (WHERE value BETWEEN 1 AND 200) AS records_stored,
      round(count(*) FILTER (WHERE value BETWEEN 1 AND 200) / CAST(count(*) AS DOUBLE), 4) AS quality_score,
      max(ts) AS created_at FROM events GROUP BY 1))"""


@query(
    "recent_runs",
    "batch_id:s created_at:t records_stored:i status:s",
    f"WITH {_LOG_SQL} SELECT * FROM log ORDER BY created_at DESC, batch_id LIMIT 5",
)
def _(spark, sf):
    return recent_runs(_day_log(spark, sf), 5)


@query(
    "backfill_summary",
    "total_batches:i successful_batches:i failed_batches:i total_records_fetched:i "
    "total_records_stored:i average_quality_score:f6",
    f"""WITH {_LOG_SQL}
SELECT count(*) AS total_batches, count(*) FILTER (WHERE status = 'success') AS successful_batches,
  count(*) FILTER (WHERE status <> 'success') AS failed_batches,
  sum(records_fetched) AS total_records_fetched, sum(records_stored) AS total_records_stored,
  avg(quality_score) AS average_quality_score FROM log""",
)
def _(spark, sf):
    return I.backfill_summary(_day_log(spark, sf))


@query(
    "ingestion_log",
    "batch_id:s records_count:i quality_score:f4 status:s error_message:s",
    f"""WITH {_LOG_SQL}
SELECT batch_id, records_stored AS records_count, quality_score, status,
  CAST(NULL AS VARCHAR) AS error_message FROM log""",
)
def _(spark, sf):
    return log_rows(_day_log(spark, sf).withColumnRenamed("records_stored", "records_count"))


@query(
    "runs_summary",
    "n_runs:i total_stored:f1 mean_quality:f6",
    f"""WITH {_LOG_SQL}
SELECT count(*) AS n_runs, sum(records_stored) AS total_stored, avg(quality_score) AS mean_quality
FROM log""",
)
def _(spark, sf):
    log = _day_log(spark, sf).withColumnRenamed("batch_id", "run_id")
    wide = log.select(
        "run_id", F.col("records_stored").cast("double").alias("records_stored"), "quality_score"
    )
    metrics = wide.unpivot(["run_id"], ["records_stored", "quality_score"], "key", "value")
    return runs_summary(log, metrics)


@query(
    "backfill_ranges",
    "event_type:s batch_no:i batch_start:s batch_end:s",
    """WITH b AS (SELECT event_type, CAST(min(ts) AS DATE) AS s, CAST(max(ts) AS DATE) AS e
           FROM events GROUP BY 1),
x AS (SELECT *, unnest(generate_series(0, CAST(floor((e - s) / 7) AS BIGINT))) AS batch_no FROM b)
SELECT event_type, batch_no, strftime(s + CAST(batch_no * 7 AS INTEGER), '%Y-%m-%d') AS batch_start,
  strftime(least(s + CAST(batch_no * 7 + 6 AS INTEGER), e), '%Y-%m-%d') AS batch_end FROM x""",
)
def _(spark, sf):
    bounds = (
        events(spark, sf)
        .groupBy("event_type")
        .agg(F.min("ts").cast("date").alias("start_date"), F.max("ts").cast("date").alias("end_date"))
    )
    found = I.backfill_ranges(bounds, 7)
    return found.withColumns({c: F.col(c).cast("string") for c in ("batch_start", "batch_end")})


@query(
    "incremental_start",
    "latest_timestamp:t start_date:s",
    """SELECT max(ts) AS latest_timestamp,
  strftime(max(ts) - INTERVAL 1 HOUR, '%Y-%m-%d') AS start_date FROM events""",
)
def _(spark, sf):
    now = F.lit("2024-02-01").cast("timestamp")
    start = I.incremental_start(events(spark, sf), now, 24, "ts")
    return start.withColumn("start_date", F.col("start_date").cast("string"))


@query(
    "sanitize_name",
    "event_id:i metric_name:s dataset_name:s importance_name:s",
    """SELECT event_id, substr(translate(n, ' -.', '___'), 1, 50) AS metric_name,
  substr(replace(n, '_', '-'), 1, 20) AS dataset_name, substr(replace(n, '_', '-'), 1, 30) AS importance_name
FROM (SELECT event_id, event_type || '-rate.of ' || props || '_' || props || '_' || props || props || props
        AS n FROM events)""",
)
def _(spark, sf):
    p = F.col("props")
    name = F.concat("event_type", F.lit("-rate.of "), p, F.lit("_"), p, F.lit("_"), p, p, p)
    return events(spark, sf).select(
        "event_id",
        sanitize_metric_name(name).alias("metric_name"),
        dataset_metric_name(name).alias("dataset_name"),
        importance_metric_name(name).alias("importance_name"),
    )


@query("ingest_historical", "batch_id:s records_count:i quality_score:f4 status:s error_message:s")
def _(spark, sf):
    root = shared_dir(spark)
    located = _broken(spark, sf).select(
        F.concat(F.lit("b"), (F.col("payload_id") % 9).cast("string")).alias("batch_id"),
        F.lit("station").alias("location_name"),
        F.lit(40.5).alias("latitude"),
        F.lit(-74.25).alias("longitude"),
        "payload_id",
        "payload",
    )
    return I.ingest_payloads(
        spark, located, f"{root}/observations", f"{root}/ingestion_log", arrival=["payload_id"]
    )
