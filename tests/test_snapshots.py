"""Atomic commits, batches that are held back, and merging of landing areas."""

from __future__ import annotations

import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sparkdrift.plans import ingest as I
from sparkdrift.sources import snapshots, table as S
from sparkdrift.sources.files import names, scratch, temporary_tables, write_once, written
from sparkdrift.sources.snapshots import CommitConflictError, SnapshotTable
from sparkdrift.streaming import jobs as J

SCHEMA = "latitude double, longitude double, timestamp timestamp, temperature_2m double, updated_at timestamp"


def rows(spark, hours, value, minute=0):
    data = [(1.0, 2.0, datetime(2024, 1, 1 + h // 24, h % 24), value + h, datetime(2024, 2, 1, 0, minute)) for h in hours]
    return spark.createDataFrame(data, SCHEMA)


def content(table, version=None):
    found = S.from_table_types(table.read(version)).collect()
    return {(r["timestamp"].day - 1) * 24 + r["timestamp"].hour: r["temperature_2m"] for r in found}


def test_versions_are_whole_and_stay_readable(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    assert table.version() == 0 and table.read() is None
    assert table.upsert(rows(spark, range(60), 0.0)) == 1
    assert table.upsert(rows(spark, range(20, 30), 100.0, 1)) == 2
    assert content(table, 1) == {h: float(h) for h in range(60)}
    assert content(table) == {h: h + (100.0 if 20 <= h < 30 else 0.0) for h in range(60)}
    # The third day was not touched: both versions name the same directory.
    assert table.live(1)["2024-01-03"] == table.live(2)["2024-01-03"]
    assert table.live(1)["2024-01-01"] != table.live(2)["2024-01-01"]
    part = table.read(start="2024-01-02", end="2024-01-02")
    assert part.count() == 24 and part.columns.count("dt") == 1 and "commit" not in part.columns
    assert all("dt=2024-01-02" in f for f in part.inputFiles())
    assert table.upsert(rows(spark, [], 0.0)) == 2
    assert table.vacuum(keep=1) == 2 and content(table)[25] == 125.0 and names(spark, f"{table.path}/versions") == ["000000000002.json"]


def test_a_write_that_dies_leaves_the_old_table(spark, tmp_path, monkeypatch):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    table.upsert(rows(spark, range(60), 0.0))
    # The job dies after the first date is written.
    fail = F.when(F.col("timestamp") >= "2024-01-02", F.raise_error(F.lit("lost")).cast("double")).otherwise(F.lit(7.0))
    with pytest.raises(Exception, match="lost"):
        table.upsert(rows(spark, range(60), 0.0, 1).withColumn("temperature_2m", fail))
    assert content(table) == {h: float(h) for h in range(60)}

    # The driver dies between the data and the list.
    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(snapshots, "write_once", die)
        with pytest.raises(KeyboardInterrupt):
            table.upsert(rows(spark, range(60), 500.0, 1))
    assert content(table) == {h: float(h) for h in range(60)} and table.version() == 1
    assert table.upsert(rows(spark, [0], 9.0, 2)) == 2 and content(table)[0] == 9.0


def test_two_writers_conflict(spark, tmp_path, monkeypatch):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    table.upsert(rows(spark, range(5), 0.0))
    real, raced = snapshots.write_once, []

    def other_first(session, path, text):
        if not raced:
            raced.append(1)
            SnapshotTable(spark, table.path).upsert(rows(spark, [1], 50.0, 1))
        return real(session, path, text)

    monkeypatch.setattr(snapshots, "write_once", other_first)
    with pytest.raises(CommitConflictError):
        table.upsert(rows(spark, [2], 70.0, 1))
    assert content(table) == {0: 0.0, 1: 51.0, 2: 2.0, 3: 3.0, 4: 4.0}
    raced.clear()
    assert table.upsert(rows(spark, [2], 70.0, 1), attempts=2) == 4
    assert content(table)[2] == 72.0


def test_ambiguous_rows_publish_nothing(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    with pytest.raises(S.AmbiguousOrderError):
        table.upsert(rows(spark, [1], 0.0).unionByName(rows(spark, [1], 5.0)))
    assert table.version() == 0


def test_a_replayed_stream_gives_the_same_rows(spark, tmp_path):
    landing = str(tmp_path / "landing")
    first = rows(spark, range(30), 0.0)
    first.write.parquet(landing)
    rows(spark, range(25, 35), 100.0, 1).write.mode("append").parquet(landing)
    for mark in ("a", "b"):  # the second checkpoint starts from nothing
        J.upsert_stream(J.read_landed(spark, landing, first.schema), str(tmp_path / "t"), str(tmp_path / mark), atomic=True).awaitTermination()
        assert content(SnapshotTable(spark, str(tmp_path / "t"))) == {h: h + (100.0 if h >= 25 else 0.0) for h in range(35)}


def test_files_are_published_once_and_scratch_goes(spark, tmp_path):
    path = str(tmp_path / "v" / "1.json")
    os.makedirs(tmp_path / "v")
    assert write_once(spark, path, "a") and not write_once(spark, path, "b")
    assert open(path).read() == "a" and names(spark, str(tmp_path / "v")) == ["1.json"]
    with scratch(spark.range(5)) as frame:
        where = frame.inputFiles()[0].removeprefix("file://")
        assert frame.count() == 5 and os.path.exists(where)
    assert not os.path.exists(where)


def document(hours, value, day="2024-01-02"):
    times = [f"{day}T{h:02d}:00" for h in hours]
    return json.dumps({"hourly": {"time": times, "temperature_2m": [value + h for h in hours]}})


def test_bad_batches_are_held_back_whole(spark, tmp_path):
    table, log = str(tmp_path / "t"), str(tmp_path / "log")
    days = [f"2024-01-0{d}" for d in range(1, 6)]
    data = [("good", document(range(4), 1.0, days[0]), 1), ("large", document(range(4), 999.0, days[1]), 1)]
    data += [("twice", document([0, 1], 1.0, days[2]), 1), ("twice", document([2, 1], 5.0, days[2]), 1)]
    data += [("same", document([0, 1], 1.0, days[3]), 1), ("same", document([0, 1], 1.001, days[3]), 1)]
    data += [("later", document([0], 1.0, days[4]), 1), ("later", document([0], 8.0, days[4]), 2)]
    df = spark.createDataFrame(data, "batch_id string, payload string, landed int").withColumns(
        {"location_name": F.lit("s"), "latitude": F.lit(1.0), "longitude": F.lit(2.0)}
    )
    rows_ = {r["batch_id"]: r for r in I.ingest_payloads(spark, df, table, log, arrival=["landed"]).collect()}
    assert {b: r["status"] for b, r in rows_.items()} == {
        "good": "success", "large": "failed", "twice": "failed", "same": "success", "later": "success"
    }
    assert rows_["large"]["error_message"] == "value out of range: temperature_2m"
    assert rows_["twice"]["error_message"] == "ambiguous key" and rows_["twice"]["records_count"] == 4
    stored = S.from_table_types(spark.read.parquet(table))
    counts = {r["batch_id"]: r["count"] for r in stored.groupBy("batch_id").count().collect()}
    assert counts == {"good": 4, "same": 2, "later": 1}
    assert stored.where("batch_id = 'later'").first()["temperature_2m"] == 8.0
    rejects = spark.read.parquet(f"{log}_rejects")
    assert rejects.groupBy("batch_id").count().count() == 2 and rejects.count() == 8
    assert json.loads(rejects.where("batch_id = 'large'").orderBy("timestamp").first()["row"])["temperature_2m"] == 999.0


def test_areas_are_merged_by_hour(spark, tmp_path):
    landing, table, log = (str(tmp_path / x) for x in ("landing", "t", "log"))
    data = [("archive", document([0, 1], 100.0)), ("recent", document([0, 1, 2, 3], 0.0)), ("archive", '{"error": true}')]
    df = spark.createDataFrame(data, "source string, payload string").withColumns(
        {"dt": F.lit("2024-01-02").cast("date"), "batch_id": F.col("source"), "location_name": F.lit("s")}
    )
    df.write.partitionBy("source", "dt").parquet(landing)
    with pytest.raises(ValueError, match="location.*latitude"):
        I.run_incremental(spark, landing, table, log, datetime(2024, 1, 2, 12), by_hour=True)
    whole = df.withColumns({"latitude": F.lit(1.0), "longitude": F.lit(2.0)})
    whole.write.mode("overwrite").partitionBy("source", "dt").parquet(landing)
    I.run_incremental(spark, landing, table, log, datetime(2024, 1, 2, 12), by_hour=True)
    got = S.from_table_types(spark.read.parquet(table)).orderBy("timestamp").collect()
    assert [r["temperature_2m"] for r in got] == [100.0, 101.0, 2.0, 3.0]


def test_temporary_tables_go_with_their_block(spark):
    with temporary_tables(spark):
        outer = written(spark.range(3))
        with temporary_tables(spark):
            inner = written(spark.range(4))
            paths = [f.inputFiles()[0].removeprefix("file://") for f in (outer, inner)]
            assert inner.count() == 4 and all(map(os.path.exists, paths))
        assert [os.path.exists(p) for p in paths] == [True, False]
    assert not os.path.exists(paths[0])
    kept = written(spark.range(2))
    assert kept.count() == 2
