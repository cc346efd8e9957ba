"""Payloads, storage layout, the keyed table and ingestion jobs."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sparkdrift.operators.transform import (
    add_temporal_features,
    resolve_column,
    to_internal_names,
    to_storage,
    utc_with_flag,
    wanted_columns,
)
from sparkdrift.plans import ingest as I
from sparkdrift.sources import runs as R
from sparkdrift.sources import table as S
from sparkdrift.sources.payload import parse_hourly_payload, split_payloads, validate_payload


def payload(hours=3, day="2024-03-01", **changes):
    hourly = {
        "time": [f"{day}T{h:02d}:00" for h in range(hours)],
        "temperature_2m": [10.005 + h for h in range(hours)],
        "relative_humidity_2m": [50 + h for h in range(hours)],
        "precipitation": [0.0] * hours,
        "wind_speed_10m": [5.5] * hours,
        "pressure_msl": [1013.2] * hours,
    }
    hourly.update(changes)
    return json.dumps({"hourly": {k: v for k, v in hourly.items() if v is not ...}})


def frame(spark, *documents):
    rows = [(f"b{i}", "Station", 38.9072, -77.0369, d) for i, d in enumerate(documents)]
    return spark.createDataFrame(
        rows, "batch_id string, location_name string, latitude double, longitude double, payload string"
    )


def test_reject_reasons(spark):
    df = frame(
        spark,
        payload(),
        '{"error": true, "reason": "x"}',
        "{}",
        '{"latitude": 1}',
        payload(time=...),
        json.dumps({"hourly": {"time": ["2024-01-01T00:00"]}}),
        payload(temperature_2m=[1.0]),
        payload(temperature_2m=..., precipitation=...),
    )
    got = [r["reject_reason"] for r in validate_payload(df, "payload").orderBy("batch_id").collect()]
    assert got == [
        None,
        "error response",
        "missing hourly data",
        "missing hourly data",
        "missing time axis",
        "no known variable",
        "array length mismatch",
        None,
    ]
    good, bad = split_payloads(df, "payload")
    assert (good.count(), bad.count()) == (2, 6)


def test_parse_keeps_order_nulls_and_absent_variables(spark):
    df = frame(spark, payload(2, temperature_2m=[1.5, None], precipitation=...))
    rows = parse_hourly_payload(df, "payload").orderBy("timestamp").collect()
    assert rows[0].asDict() == {
        "timestamp": datetime(2024, 3, 1),
        "location_name": "Station",
        "latitude": 38.9072,
        "longitude": -77.0369,
        "temperature": 1.5,
        "humidity": 50.0,
        "precipitation": None,
        "wind_speed": 5.5,
        "pressure": 1013.2,
    }
    assert rows[1]["temperature"] is None


def test_storage_layout(spark):
    parsed = parse_hourly_payload(frame(spark, payload(1)), "payload")
    row = to_storage(parsed, "api", "b1").first()
    assert row["temperature_2m"] == round(10.005, 2) and row["surface_pressure"] == 1013.2
    assert json.loads(row["raw_data"])["relative_humidity_2m"] == 50.0
    back = to_internal_names(to_storage(parsed, "api", "b1"))
    assert {"temperature", "humidity", "wind_speed", "pressure"} <= set(back.columns)


def test_daylight_saving_hours(spark):
    df = spark.createDataFrame(
        [("2024-03-10 02:30:00",), ("2024-11-03 01:30:00",), ("2024-07-01 00:00:00",)], "t string"
    ).select(F.to_timestamp_ntz(F.col("t")).alias("timestamp"))
    rows = utc_with_flag(df, "timestamp").collect()
    assert [r["dst_affected"] for r in rows] == [True, True, False]
    assert rows[2]["timestamp"] == datetime(2024, 7, 1, 4)
    with pytest.raises(Exception, match="skipped or repeated"):
        utc_with_flag(df, "timestamp", dst="raise").collect()


def test_calendar_uses_local_time_for_instants(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 6, 3),)], "timestamp timestamp")
    row = add_temporal_features(df).first()
    # 22:00 on Friday in New York.
    assert (row["hour_of_day"], row["day_of_week"], row["is_weekend"], row["season"]) == (22, 4, False, "winter")
    plain = add_temporal_features(df.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))).first()
    assert (plain["hour_of_day"], plain["is_weekend"]) == (3, True)


def test_column_fallback(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "temperature double, humidity double")
    assert resolve_column(df, "temperature_2m") == "temperature"
    assert wanted_columns(df, ["relative_humidity_2m", "pressure_msl"]) == ["humidity"]


def rows_of(spark, *values):
    return spark.createDataFrame(
        [(1.0, 2.0, datetime(2024, 1, d, h), t, s, b) for d, h, t, s, b in values],
        "latitude double, longitude double, timestamp timestamp, temperature_2m double, "
        "updated_at string, batch_id string",
    ).withColumn("updated_at", F.col("updated_at").cast("timestamp"))


def read(spark, path):
    stored = S.from_table_types(spark.read.parquet(path)).orderBy("timestamp").collect()
    return [(r["timestamp"].day, r["timestamp"].hour, r["temperature_2m"], r["batch_id"]) for r in stored]


def test_upsert_keeps_first_provenance_and_last_values(spark, tmp_path):
    path = str(tmp_path / "t")
    S.upsert(spark, path, rows_of(spark, (1, 0, 1.0, "2024-01-01", "a"), (1, 0, 2.0, "2024-01-02", "b"), (2, 0, 5.0, "2024-01-01", "a")))
    assert read(spark, path) == [(1, 0, 2.0, "a"), (2, 0, 5.0, "a")]
    S.upsert(spark, path, rows_of(spark, (1, 0, None, "2024-01-03", "c"), (1, 1, 7.0, "2024-01-03", "c")))
    assert read(spark, path) == [(1, 0, None, "a"), (1, 1, 7.0, "c"), (2, 0, 5.0, "a")]


def test_upsert_rewrites_only_touched_dates(spark, tmp_path):
    path = tmp_path / "t"
    S.upsert(spark, str(path), rows_of(spark, *[(d, 0, 1.0, "2024-01-01", "a") for d in range(1, 5)]))
    before = {str(p.relative_to(path)) for p in path.glob("dt=*/*.parquet")}
    S.upsert(spark, str(path), rows_of(spark, (2, 0, 9.0, "2024-01-02", "b")))
    after = {str(p.relative_to(path)) for p in path.glob("dt=*/*.parquet")}
    replaced = before - after
    assert len(before) == len(after) == 4 and {p.split("/")[0] for p in replaced} == {"dt=2024-01-02"}
    assert len(read(spark, str(path))) == 4


def test_append_refuses_duplicates(spark, tmp_path):
    path = str(tmp_path / "t")
    S.append(spark, path, rows_of(spark, (1, 0, 1.0, "2024-01-01", "a")))
    S.append(spark, path, rows_of(spark, (1, 1, 1.0, "2024-01-01", "a")))
    for bad in ([(1, 1, 2.0, "2024-01-01", "b")], [(3, 0, 1.0, "2024-01-01", "b")] * 2):
        with pytest.raises(S.DuplicateKeyError):
            S.append(spark, path, rows_of(spark, *bad))
    assert len(read(spark, path)) == 2


def test_overflow_of_a_stored_measure_fails(spark, tmp_path):
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE|cannot be represented"):
        S.upsert(spark, str(tmp_path / "t"), rows_of(spark, (1, 0, 12345.0, "2024-01-01", "a")))


def test_scan_prunes_and_pushes(spark, tmp_path):
    path = str(tmp_path / "t")
    S.upsert(spark, path, rows_of(spark, *[(d, h, 1.0, "2024-01-01", "a") for d in (1, 2, 3) for h in (0, 12)]))
    found = S.scan_timerange(spark.read.parquet(path), "2024-01-01 12:00:00", "2024-01-02 12:00:00")
    assert found.count() == 3
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in text and "GreaterThanOrEqual(timestamp" in text


def test_ranges_and_routes(spark):
    with pytest.raises(ValueError, match="before start"):
        S.parse_range("2024-02-01", "2024-01-01")
    with pytest.raises(ValueError):
        S.parse_range("2024/02/01", "2024-02-02")
    with pytest.raises(ValueError, match="positive"):
        S.latest_hours(spark.range(1), 0, F.current_timestamp())
    one = spark.createDataFrame([("2024-01-01", "2024-01-17"), ("2024-02-02", "2024-02-01")], "start_date string, end_date string")
    got = [(str(r["batch_start"]), str(r["batch_end"])) for r in I.backfill_ranges(one, 7).collect()]
    assert got == [("2024-01-01", "2024-01-07"), ("2024-01-08", "2024-01-14"), ("2024-01-15", "2024-01-17")]


def test_read_range_prunes_landing_area(spark, tmp_path):
    path = str(tmp_path / "landing")
    rows = [("archive", f"2024-01-0{d}", payload(2, f"2024-01-0{d}")) for d in (1, 2, 3)]
    rows.append(("recent", "2024-01-02", payload(1)))
    spark.createDataFrame(rows, "source string, dt string, payload string").withColumn(
        "dt", F.col("dt").cast("date")
    ).write.partitionBy("source", "dt").parquet(path)
    extra = [("recent", "2024-01-04", payload(n)) for n in (1, 2)]
    spark.createDataFrame(extra, "source string, dt string, payload string").withColumn(
        "dt", F.col("dt").cast("date")
    ).write.mode("append").partitionBy("source", "dt").parquet(path)
    # The range runs from archived days into recent ones; the archive wins where both have a day.
    got = S.read_range(spark, path, "2024-01-02", "2024-01-05").collect()
    assert sorted((str(r["dt"]), r["source"]) for r in got) == [
        ("2024-01-02", "archive"),
        ("2024-01-03", "archive"),
        ("2024-01-04", "recent"),
        ("2024-01-04", "recent"),
    ]
    table, log = str(tmp_path / "table"), str(tmp_path / "log")
    kept = {"arrival": ["dt"], "batch_column": "source"}
    located = spark.read.parquet(path).select(
        "source", "dt", "payload", F.lit("s").alias("location_name"), F.lit(1.0).alias("latitude"),
        F.lit(2.0).alias("longitude"),
    )
    landing = str(tmp_path / "located")
    located.where("dt < '2024-01-04'").write.partitionBy("source", "dt").parquet(landing)
    I.run_incremental(spark, landing, table, log, datetime(2024, 1, 3, 12), hours=36, **kept)
    assert spark.read.parquet(table).count() == 4
    I.run_incremental(spark, landing, table, log, datetime(2024, 1, 3, 13), **kept)
    assert spark.read.parquet(table).count() == 4


def test_unusable_archive_payloads_do_not_hide_recent_ones(spark, tmp_path):
    path, table, log = (str(tmp_path / x) for x in ("landing", "table", "log"))
    rows = [("archive", "a", '{"error": true}'), ("recent", "a", payload(2, "2024-01-02"))]
    rows += [("archive", "b", payload(3, "2024-01-02")), ("recent", "b", payload(1, "2024-01-02"))]
    landed = spark.createDataFrame(rows, "source string, location_name string, payload string").withColumns(
        {"dt": F.lit("2024-01-02").cast("date"), "longitude": F.lit(2.0)}
    )
    landed = landed.withColumn("latitude", F.when(F.col("location_name") == "a", 1.0).otherwise(3.0))
    landed.write.partitionBy("source", "dt").parquet(path)
    got = S.read_range(spark, path, "2024-01-02", "2024-01-02").select("location_name", "source").collect()
    assert sorted(map(tuple, got)) == [("a", "archive"), ("a", "recent"), ("b", "archive")]
    I.run_incremental(spark, path, table, log, datetime(2024, 1, 2, 12), hours=5, arrival=["dt"], batch_column="source")
    counts = spark.read.parquet(table).groupBy("location_name").count().collect()
    assert sorted(map(tuple, counts)) == [("a", 2), ("b", 3)]


def measures(spark, rows, columns="temperature_2m double"):
    schema = f"timestamp string, {columns}, updated_at string, place int"
    df = spark.createDataFrame(rows, schema).withColumns(
        {c: F.col(c).cast("timestamp") for c in ("timestamp", "updated_at")}
    )
    return df.withColumns({"latitude": F.lit(1.0), "longitude": F.lit(2.0)})


def test_upsert_keeps_columns_that_a_batch_lacks(spark, tmp_path):
    path = str(tmp_path / "t")
    first = [("2024-01-01 00:00", 1.0, 9.0, "2024-02-01", 0), ("2024-01-01 01:00", 2.0, 8.0, "2024-02-01", 0)]
    S.upsert(spark, path, measures(spark, first, "temperature_2m double, precipitation double").drop("place"))
    S.upsert(spark, path, measures(spark, [("2024-01-01 01:00", 5.0, "2024-02-02", 0)]).drop("place"))
    got = {r["timestamp"].hour: r for r in S.from_table_types(spark.read.parquet(path)).collect()}
    assert (got[0]["temperature_2m"], got[0]["precipitation"]) == (1.0, 9.0)
    assert (got[1]["temperature_2m"], got[1]["precipitation"]) == (5.0, None)
    late = measures(spark, [("2024-01-01 02:00", 7.0, "2024-02-03", 0)]).drop("place").withColumn("cloud_cover", F.lit(3.0))
    S.upsert(spark, path, late, updated=[*S.UPDATED_COLUMNS, "cloud_cover"])
    wide = spark.read.parquet(path)
    assert wide.count() == 3 and wide.where("cloud_cover is null").count() == 2


@pytest.mark.parametrize("parts", [1, 3, 5])
def test_the_last_row_of_a_batch_wins_however_it_is_dealt(spark, tmp_path, parts):
    path = str(tmp_path / "t")
    rows = [("2024-01-01 00:00", float(i), "2024-02-01", i) for i in range(6)]
    batch = measures(spark, rows).repartition(parts)
    with pytest.raises(S.AmbiguousOrderError):
        S.upsert(spark, path, batch)
    S.upsert(spark, path, batch, arrival=["place"])
    row = spark.read.parquet(path).first()
    assert float(row["temperature_2m"]) == 5.0 and "place" not in row.asDict()


def test_other_session_zones_are_refused(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        with pytest.raises(ValueError, match="UTC"):
            S.upsert(spark, str(tmp_path / "t"), measures(spark, [("2024-01-01 00:00", 1.0, "2024-02-01", 0)]))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_ingestion_is_idempotent_and_keeps_going(spark, tmp_path):
    table, log = str(tmp_path / "table"), str(tmp_path / "log")
    documents = frame(
        spark, payload(24), '{"error": true}', payload(24, "2024-03-02", temperature_2m=[500.0] * 24)
    )
    for _ in range(2):
        I.ingest_payloads(spark, documents, table, log, now=F.lit("2024-04-01").cast("timestamp"))
    assert spark.read.parquet(table).count() == 48
    rows = {r["batch_id"]: r for r in spark.read.parquet(log).dropDuplicates(["batch_id"]).collect()}
    assert rows["b0"]["status"] == "success" and float(rows["b0"]["quality_score"]) == 1.0
    assert rows["b1"]["status"] == "failed" and rows["b1"]["error_message"] == "error response"
    # Implausible rows are graded and stored all the same.
    assert rows["b2"]["status"] == "success" and float(rows["b2"]["quality_score"]) == pytest.approx(0.92)
    assert {r["batch_id"] for r in spark.read.parquet(table).select("batch_id").distinct().collect()} == {"b0", "b2"}
    start = I.incremental_start(spark.read.parquet(table), F.current_timestamp()).first()
    assert str(start["start_date"]) == "2024-03-02"
    empty = I.incremental_start(spark.read.parquet(table).limit(0), F.lit("2024-05-05 12:00").cast("timestamp")).first()
    assert str(empty["start_date"]) == "2024-05-04"


def test_logging_never_raises(spark, tmp_path):
    path = str(tmp_path / "log")
    assert R.log_ingestion(spark, path, "b", {"records_count": 5, "quality_score": 0.5, "status": "success"})
    row = R.recent_runs(spark.read.parquet(path)).first()
    assert row["records_count"] == 5 and json.loads(row["metadata"])["status"] == "success"
    assert R.log_ingestion(spark, "/proc/nowhere", "b", {}) is False


def test_feature_config_document(spark, tmp_path):
    R.save_feature_config(spark, str(tmp_path / "c"), split={"train_samples": 5})
    row = spark.read.json(str(tmp_path / "c")).first()
    assert len(row["feature_names"]) == 30 and json.loads(row["split_info"]) == {"train_samples": 5}
