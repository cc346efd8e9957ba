"""Ingestion jobs: historical, incremental, backfill and re-checks."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdrift.config import QualityConfig
from sparkdrift.operators.frames import null_safe_join
from sparkdrift.operators.quality import validate
from sparkdrift.operators.transform import to_internal_names, to_storage
from sparkdrift.sources.payload import parse_hourly_payload, split_payloads
from sparkdrift.sources.runs import append_table, log_rows
from sparkdrift.sources.files import exists, scratch
from sparkdrift.sources.table import (
    DATE_FORMAT,
    DECIMALS,
    KEY,
    SOURCE_RANK,
    UPDATED_COLUMNS,
    ambiguous_rows,
    clean_measures,
    from_table_types,
    landed_range,
    prepare_rows,
    read_range,
    unfit_columns,
    upsert,
)


#: Column for a row's place in its payload.
POSITION = "payload_position"


def backfill_ranges(bounds: DataFrame, batch_days: int = 7) -> DataFrame:
    """Cut ``(start_date, end_date)`` rows into consecutive batches of at most ``batch_days`` days."""
    if batch_days < 1:
        raise ValueError("batch_days must be at least 1")
    first, last = F.col("start_date").cast("date"), F.col("end_date").cast("date")
    starts = F.sequence(first, last, F.expr(f"INTERVAL {int(batch_days)} DAYS"))
    kept = [c for c in bounds.columns if c not in ("start_date", "end_date")]
    return (
        bounds.where(first <= last)
        .select(*kept, last.alias("__last"), F.posexplode(starts).alias("batch_no", "batch_start"))
        .select(
            *kept,
            "batch_no",
            "batch_start",
            F.least(F.date_add("batch_start", batch_days - 1), F.col("__last")).alias("batch_end"),
        )
    )


def batch_number(day: Column, start: Column, batch_days: int) -> Column:
    """Backfill batch a day belongs to, counted from 0."""
    return F.floor(F.datediff(day, start) / batch_days).cast("int")


def incremental_start(
    observations: DataFrame, now: Column, hours: int = 24, time_column: str = "timestamp"
) -> DataFrame:
    """First day of the next incremental run: one hour before the newest row, else ``hours`` back."""
    newest = F.max(time_column).cast("timestamp") - F.expr("INTERVAL 1 HOUR")
    fallback = now - F.expr(f"INTERVAL {int(hours)} HOURS")
    return observations.agg(
        F.max(time_column).alias("latest_timestamp"),
        F.to_date(F.coalesce(newest, fallback)).alias("start_date"),
    )


def run_incremental(
    spark: SparkSession,
    landing_path: str,
    table_path: str,
    log_path: str,
    now: datetime,
    hours: int = 24,
    by_hour: bool = False,
    **ingest,
) -> DataFrame:
    """Ingest what landed since one hour before the newest stored row, up to ``now``; the log rows.

    Without stored rows the run reaches ``hours`` back. Rows that are delivered again overwrite themselves.
    Both landing areas are read. A usable archive payload stands for its location and day; ``by_hour``
    merges row by row instead: the archive's row of a location and hour wins, and hours that it lacks come
    from the recent payloads.
    """
    clock = F.lit(now).cast("timestamp")
    if exists(spark, table_path):
        start = incremental_start(spark.read.parquet(table_path), clock, hours).first()["start_date"]
    else:
        start = (now - timedelta(hours=hours)).date()
    first, last = start.strftime(DATE_FORMAT), max(start, now.date()).strftime(DATE_FORMAT)
    if by_hour:
        landed = landed_range(spark, landing_path, first, last)
        ingest["arrival"] = [SOURCE_RANK, *ingest.get("arrival", ())]
    else:
        landed = read_range(spark, landing_path, first, last, json_column=ingest.get("json_column", "payload"))
    return ingest_payloads(spark, landed, table_path, log_path, now=clock, **ingest)


def validate_batches(
    rows: DataFrame,
    batch_column: str,
    config: QualityConfig = QualityConfig(),
    series_keys: Sequence[str] = (),
) -> DataFrame:
    """Quality of every batch in one job: batches are data, not iterations."""
    return validate(rows, config, series_keys, [batch_column])


def backfill_summary(log: DataFrame) -> DataFrame:
    """Batches by outcome, totals and mean quality over all batches."""
    ok = F.col("status") == "success"
    return log.agg(
        F.count(F.lit(1)).alias("total_batches"),
        F.count_if(ok).alias("successful_batches"),
        F.count_if(~ok).alias("failed_batches"),
        F.coalesce(F.sum("records_fetched"), F.lit(0)).alias("total_records_fetched"),
        F.coalesce(F.sum("records_stored"), F.lit(0)).alias("total_records_stored"),
        F.coalesce(F.avg("quality_score"), F.lit(0.0)).alias("average_quality_score"),
    )


def recheck_quality(
    stored: DataFrame,
    config: QualityConfig = QualityConfig(),
    series_keys: Sequence[str] = (),
    keys: Sequence[str] = (),
) -> DataFrame:
    """Validate stored rows again under their internal names."""
    return validate(to_internal_names(from_table_types(stored)), config, series_keys, keys)


def ingest_payloads(
    spark: SparkSession,
    payloads: DataFrame,
    table_path: str,
    log_path: str,
    json_column: str = "payload",
    batch_column: str = "batch_id",
    source: str = "api",
    config: QualityConfig = QualityConfig(),
    now: Column | None = None,
    arrival: Sequence[str] = (),
    rejects_path: str | None = None,
) -> DataFrame:
    """Parse, grade, transform, upsert and log any number of batches; returns the log rows.

    Unusable payloads fail their batch only when nothing else of it is left; they never stop the
    others. Rows of poor quality are graded and stored all the same. ``arrival`` names payload columns
    (a landing time, a file, a number) that say which of two payloads came last; within a payload the
    last place in its arrays wins. A batch with a value that doesn't fit its column, or with a key for which
    different values arrive at the same place, is held back whole: it is logged as failed, its rows go to
    the table at ``rejects_path`` (by default beside the log), and the other batches are stored. Batches
    that deliver different values for one key at the same place are all held back. The parsed rows
    feed several consumers and lie in the shared folder in between.
    """
    clock = F.current_timestamp() if now is None else now
    started = spark.sql("select current_timestamp() as t").first()["t"]
    usable, rejected = split_payloads(payloads, json_column)
    parsed = clean_measures(
        parse_hourly_payload(
            usable,
            json_column,
            keep=[*dict.fromkeys([batch_column, "location_name", "latitude", "longitude", *arrival])],
            position=POSITION,
        )
    )
    places = [*arrival, POSITION]
    with scratch(parsed) as rows, scratch(_storage_rows(rows, batch_column, source, clock, places)) as shaped:
        quality = validate_batches(rows, batch_column, config)
        faults = batch_faults(shaped, places)
        good = null_safe_join(shaped, faults.select("batch_id"), ["batch_id"], "left_anti")
        upsert(spark, table_path, good, arrival=places)
        held = null_safe_join(shaped, faults, ["batch_id"])
        if not held.isEmpty():
            row = F.to_json(F.struct(*[c for c in shaped.columns if c not in ("id", "batch_id")]))
            rejects = held.select("batch_id", F.col("fault").alias("reason"), "timestamp", row.alias("row"), clock.alias("created_at"))
            append_table(rejects, rejects_path or f"{log_path.rstrip('/')}_rejects")
        bad = rejected.groupBy(batch_column).agg(
            F.array_join(F.array_sort(F.collect_set("reject_reason")), "; ").alias("error_message")
        )
        graded = payloads.select(batch_column).distinct()
        for part in (quality, bad, faults.withColumnRenamed("batch_id", batch_column)):
            graded = null_safe_join(graded, part, [batch_column], "left")
        total = F.coalesce("total_records", F.lit(0))
        done = F.col("fault").isNull() & (total > 0)
        nothing = F.when(total == 0, F.coalesce("error_message", F.lit("No data returned")))
        log = log_rows(
            graded.select(
                F.col(batch_column).alias("batch_id"),
                F.lit(started).alias("start_time"),
                F.current_timestamp().alias("end_time"),
                total.alias("records_count"),
                F.coalesce("quality_score", F.lit(0.0)).alias("quality_score"),
                F.when(done, "success").otherwise("failed").alias("status"),
                F.coalesce(nothing, F.col("fault"), F.col("error_message")).alias("error_message"),
            )
        )
        append_table(log, log_path)
    return spark.read.parquet(log_path)


def batch_faults(rows: DataFrame, places: Sequence[str]) -> DataFrame:
    """(batch_id, fault): batches that can't be stored, with the reasons."""
    unfit = rows.select("batch_id", F.explode(unfit_columns(rows)).alias("column")).distinct()
    key, updated = [*KEY], [c for c in UPDATED_COLUMNS if c in rows.columns]
    order = ["updated_at", *places]
    # Compared as they would be stored: values that only differ beyond the stored digits are the same.
    typed = rows.withColumns(
        {c: F.col(c).try_cast(T.DecimalType(*ps)) for c, ps in DECIMALS.items() if c in rows.columns and c not in key}
    )
    tied = ambiguous_rows(typed, key, updated, order).distinct()
    reasons = unfit.select("batch_id", F.concat(F.lit("value out of range: "), "column").alias("reason"))
    ambiguous = null_safe_join(rows, tied, key, "left_semi").select("batch_id").distinct()
    every = reasons.unionByName(ambiguous.withColumn("reason", F.lit("ambiguous key")))
    return every.groupBy("batch_id").agg(F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("fault"))


def _storage_rows(
    rows: DataFrame, batch_column: str, source: str, clock: Column, arrival: Sequence[str]
) -> DataFrame:
    """Storage layout that keeps each row's own batch id."""
    tagged = rows.withColumn("__batch", F.col(batch_column))
    shaped = to_storage(tagged, source, "", now=clock).withColumn("batch_id", F.col("__batch"))
    return prepare_rows(shaped, "", clock, arrival)
