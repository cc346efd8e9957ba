"""Ingestion over two landing areas, batches that can't be stored, and streams run to their end."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contract.registry import query
from contract.views import EVENT_CUT, OBS_SQL, PSI_TERM_SQL, at, events, obs, shared_dir
from sparkdrift.operators.reference import create_profile
from sparkdrift.plans import ingest as I
from sparkdrift.sources import table as S
from sparkdrift.sources.payload import to_payload
from sparkdrift.sources.snapshots import SnapshotTable
from sparkdrift.streaming import jobs as J

NOW = datetime(2024, 2, 1)
# Of even days the archive has the hours before noon; of every tenth day it has an error response only.
ARCHIVED_SQL = "day(hour) % 2 = 0 AND day(hour) % 10 <> 0 AND hour(hour) < 12"
HOURLY_SQL = f"""hourly AS (
  SELECT event_type AS location_name, hour, CAST(hour AS DATE) AS dt, floor(max_value) AS warm, n_events % 100 AS damp
  FROM ({OBS_SQL}))"""


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly rows of every event type, each type a location of its own."""
    code = F.crc32("event_type")
    return obs(spark, sf).select(
        F.col("event_type").alias("location_name"),
        (code % 80).cast("double").alias("latitude"),
        (F.floor(code / 80) % 170).cast("double").alias("longitude"),
        "hour",
        F.to_date("hour").alias("dt"),
        F.floor("max_value").cast("double").alias("warm"),
        (F.col("n_events") % 100).cast("double").alias("damp"),
    )


DOCUMENT = ["location_name", "latitude", "longitude", "dt"]
MEASURED = {"warm": "temperature_2m", "damp": "relative_humidity_2m"}


def landing(spark: SparkSession, sf: str, path: str, days: Column) -> None:
    """Payloads of the chosen days in both landing areas; the archive's values are one lower."""
    rows = hourly(spark, sf).where(days)
    day, noon = F.dayofmonth("dt"), F.hour("hour") < 12
    recent = to_payload(rows, DOCUMENT, "hour", MEASURED)
    halves = rows.where((day % 2 == 0) & (day % 10 != 0) & noon).withColumn("warm", F.col("warm") - 1)
    archive = to_payload(halves, DOCUMENT, "hour", MEASURED)
    broken = recent.where(day % 10 == 0).withColumn("payload", F.lit('{"error": true}'))
    both = recent.withColumn("source", F.lit("recent")).unionByName(
        archive.unionByName(broken).withColumn("source", F.lit("archive"))
    )
    tagged = both.withColumn("batch_id", F.concat_ws("-", "source", F.col("dt").cast("string")))
    tagged.write.mode("append").partitionBy("source", "dt").parquet(path)


@query(
    "read_range",
    "location_name:s dt:s source:s n_hours:i",
    f"""WITH {HOURLY_SQL},
halves AS (SELECT location_name, dt, count(*) AS n FROM hourly WHERE {ARCHIVED_SQL} GROUP BY ALL),
days AS (SELECT location_name, dt, count(*) AS n FROM hourly GROUP BY ALL)
SELECT location_name, strftime(dt, '%Y-%m-%d') AS dt, 'archive' AS source, n AS n_hours FROM halves
UNION ALL SELECT location_name, strftime(dt, '%Y-%m-%d'), 'archive', 0 FROM days WHERE day(dt) % 10 = 0
UNION ALL SELECT location_name, strftime(dt, '%Y-%m-%d'), 'recent', n FROM days ANTI JOIN halves USING (location_name, dt)""",
)
def _(spark, sf):
    path = f"{shared_dir(spark)}/landing"
    landing(spark, sf, path, F.lit(True))
    found = S.read_range(spark, path, "2023-12-01", "2024-12-31")
    times = F.from_json("payload", "hourly struct<time: array<string>>")["hourly"]["time"]
    return found.select(
        "location_name", F.col("dt").cast("string").alias("dt"), "source", F.coalesce(F.size(times), F.lit(0)).alias("n_hours")
    )


@query(
    "run_incremental",
    "location_name:s timestamp:t temperature_2m:f2 relative_humidity_2m:f2",
    f"""WITH {HOURLY_SQL}
SELECT location_name, hour AS timestamp, CASE WHEN {ARCHIVED_SQL} THEN warm - 1 ELSE warm END AS temperature_2m,
  damp AS relative_humidity_2m FROM hourly""",
)
def _(spark, sf):
    root = shared_dir(spark)
    early = F.col("dt") <= F.lit("2024-01-15").cast("date")
    where = f"{root}/landing", f"{root}/observations", f"{root}/log"
    landing(spark, sf, where[0], early)
    I.run_incremental(spark, *where, datetime(2024, 1, 16), hours=24 * 40, by_hour=True)
    landing(spark, sf, where[0], ~early)
    I.run_incremental(spark, *where, NOW, by_hour=True)
    return S.from_table_types(spark.read.parquet(where[1]))


WEEK_SQL = "'w' || (day(hour) - 1) // 7"


@query(
    "backfill_with_bad_batch",
    "batch_id:s status:s records_count:i error_message:s n_stored:i n_rejected:i",
    f"""WITH {HOURLY_SQL},
weeks AS (SELECT {WEEK_SQL} AS batch_id, count(*) AS n, count(*) FILTER (WHERE day(hour) = 17) AS twice
          FROM hourly GROUP BY ALL)
SELECT batch_id, CASE WHEN batch_id IN ('w1', 'w2') THEN 'failed' ELSE 'success' END AS status,
  n + twice AS records_count,
  CASE batch_id WHEN 'w1' THEN 'value out of range: temperature_2m' WHEN 'w2' THEN 'ambiguous key' END AS error_message,
  CASE WHEN batch_id IN ('w1', 'w2') THEN 0 ELSE n END AS n_stored,
  CASE WHEN batch_id IN ('w1', 'w2') THEN n + twice ELSE 0 END AS n_rejected FROM weeks""",
)
def _(spark, sf):
    root = shared_dir(spark)
    day = F.dayofmonth("dt")
    # A value that no column can hold on the 10th, and two values for every hour of the 17th.
    rows = hourly(spark, sf).withColumn("warm", F.when(day == 10, 5000.0).otherwise(F.col("warm")))
    again = rows.where(day == 17).withColumn("warm", F.col("warm") + 1)
    documents = to_payload(rows, DOCUMENT, "hour", MEASURED).unionByName(to_payload(again, DOCUMENT, "hour", MEASURED))
    week = F.concat(F.lit("w"), F.floor((day - 1) / 7).cast("string"))
    batches = documents.withColumn("batch_id", week)
    log = I.ingest_payloads(spark, batches, f"{root}/observations", f"{root}/log", arrival=["dt"])
    stored = spark.read.parquet(f"{root}/observations").groupBy("batch_id").agg(F.count("*").alias("n_stored"))
    rejects = spark.read.parquet(f"{root}/log_rejects").groupBy("batch_id").agg(F.count("*").alias("n_rejected"))
    joined = log.join(stored, "batch_id", "left").join(rejects, "batch_id", "left")
    return joined.fillna(0, ["n_stored", "n_rejected"])


# ------------------------------------------------------------------------------------------- streams


def observed(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("event_id", "event_type", F.col("ts").cast("timestamp").alias("timestamp"), "value")


def to_end(stream: DataFrame, out: str, mark: str) -> DataFrame:
    """What a stream delivers from the files that are there, written and read back."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", mark).outputMode("append")
    writer.trigger(availableNow=True).start(out).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


LATER_SQL = "event_id % 3 = 0"


@query(
    "stream_upsert",
    "event_type:s timestamp:t event_id:i value:f2 version:i",
    f"""WITH latest AS (
  SELECT event_type, date_trunc('hour', ts) AS timestamp, {LATER_SQL} AS later, max(event_id) AS event_id
  FROM events GROUP BY ALL),
last AS (SELECT event_type, timestamp, max_by(event_id, later) AS event_id FROM latest GROUP BY ALL)
SELECT event_type, timestamp, event_id, value, 2 AS version FROM last JOIN events USING (event_type, event_id)""",
)
def _(spark, sf):
    root = shared_dir(spark)
    rows = observed(spark, sf).withColumn("timestamp", F.date_trunc("hour", "timestamp"))
    # Two deliveries; the second run goes on from the checkpoint and overwrites what it delivers again.
    for wave in (F.col("event_id") % 3 != 0, F.col("event_id") % 3 == 0):
        rows.where(wave).write.mode("append").parquet(f"{root}/landing")
        stream = J.read_landed(spark, f"{root}/landing", rows.schema)
        J.upsert_stream(
            stream, f"{root}/table", f"{root}/mark", ["event_type", "timestamp"], ["event_id", "value"], ["event_id"], atomic=True
        ).awaitTermination()
    table = SnapshotTable(spark, f"{root}/table")
    return table.read().withColumn("version", F.lit(table.version()))


@query(
    "stream_overlap",
    "event_id:i event_type:s timestamp:t value:f2",
    "SELECT event_id, event_type, ts AS timestamp, value FROM events",
)
def _(spark, sf):
    root = shared_dir(spark)
    rows = observed(spark, sf)
    # Every delivery reaches back over the one before; here all of it comes twice.
    rows.unionByName(rows).write.parquet(f"{root}/landing")
    stream = J.read_landed(spark, f"{root}/landing", rows.schema)
    return to_end(J.drop_overlap(stream, ["event_id"]), f"{root}/out", f"{root}/mark")


GRID = [i / 10 for i in range(11)]
NOT_ABOVE_SQL = " + ".join(f"CAST(edges[{i}] <= value AS INTEGER)" for i in range(1, 12))


@query(
    "stream_window_psi",
    "feature:s window_end:t psi:f6",
    f"""WITH ref AS (SELECT value FROM events WHERE ts < TIMESTAMP '{EVENT_CUT}'),
e AS (SELECT quantile_cont(value, {GRID}) AS edges FROM ref),
placed AS (SELECT ts, ts < TIMESTAMP '{EVENT_CUT}' AS is_ref,
             least(greatest({NOT_ABOVE_SQL} - 1, 0), 9) AS bin FROM events, e),
stored AS (SELECT bin, count(*) AS n_ref FROM placed WHERE is_ref GROUP BY bin),
slides AS (SELECT date_trunc('day', ts) AS d, bin, count(*) AS n FROM placed WHERE NOT is_ref GROUP BY ALL),
counts AS (SELECT d + to_days(CAST(k AS INTEGER)) AS window_end, bin, sum(n) AS n_cur
           FROM slides, (SELECT unnest(generate_series(1, 7)) AS k)
           WHERE d + to_days(CAST(k AS INTEGER)) <= (SELECT date_trunc('day', max(ts) - INTERVAL 1 HOUR) FROM events)
           GROUP BY ALL),
ends AS (SELECT window_end, sum(n_cur) AS cur_n FROM counts GROUP BY window_end),
shares AS (SELECT window_end, n_ref / (SELECT sum(n_ref) FROM stored)::DOUBLE AS p, coalesce(n_cur, 0) / cur_n::DOUBLE AS q
           FROM ends CROSS JOIN stored LEFT JOIN counts USING (window_end, bin))
SELECT 'value' AS feature, window_end, sum({PSI_TERM_SQL}) AS psi FROM shares GROUP BY window_end""",
)
def _(spark, sf):
    root = shared_dir(spark)
    before = F.col("ts") < at(EVENT_CUT)
    create_profile(events(spark, sf).where(before), ["value"]).write.parquet(f"{root}/profile")
    profile = spark.read.parquet(f"{root}/profile")
    rows = observed(spark, sf).where(F.col("timestamp") >= F.lit(EVENT_CUT).cast("timestamp"))
    rows.write.parquet(f"{root}/landing")
    counts = J.window_bin_counts(J.read_landed(spark, f"{root}/landing", rows.schema), profile, ["value"])
    # Windows that the watermark has not passed stay open.
    written = to_end(counts, f"{root}/out", f"{root}/mark")
    return J.window_psi(written, profile).withColumn("window_end", F.col("window.end"))
