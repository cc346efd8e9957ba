"""Streams over landed files."""

from __future__ import annotations

from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from sparkdrift.operators.reference import create_profile
from sparkdrift.sources.table import from_table_types
from sparkdrift.streaming import jobs as J

START = datetime(2024, 1, 1)
SCHEMA = (
    "latitude double, longitude double, timestamp timestamp, temperature_2m double, "
    "updated_at timestamp, batch_id string"
)


def rows(spark, first, last, value, batch):
    data = [
        (1.0, 2.0, START + timedelta(hours=h), value + h, START + timedelta(days=30, minutes=batch), f"b{batch}")
        for h in range(first, last)
    ]
    return spark.createDataFrame(data, SCHEMA)


def test_upsert_stream_applies_late_corrections(spark, tmp_path):
    landing, table, mark = (str(tmp_path / x) for x in ("landing", "table", "mark"))
    first = rows(spark, 0, 30, 0.0, 1)

    def run():
        stream = J.read_landed(spark, landing, first.schema)
        J.upsert_stream(stream, table, mark).awaitTermination()

    first.write.parquet(landing)
    run()
    # The next delivery overlaps and corrects the last hours; a second run finds nothing new.
    rows(spark, 28, 40, 100.0, 2).write.mode("append").parquet(landing)
    run()
    run()
    stored = from_table_types(spark.read.parquet(table)).orderBy("timestamp").collect()
    assert len(stored) == 40
    assert [r["temperature_2m"] for r in stored[27:30]] == [27.0, 128.0, 129.0]
    assert [r["batch_id"] for r in stored[27:31]] == ["b1", "b1", "b1", "b2"]


def test_overlap_is_delivered_once(spark, tmp_path):
    landing, out, mark = (str(tmp_path / x) for x in ("landing", "out", "mark"))
    first = rows(spark, 0, 5, 0.0, 1)
    first.unionByName(rows(spark, 3, 5, 50.0, 1)).coalesce(1).write.parquet(landing)
    stream = J.drop_overlap(J.read_landed(spark, landing, first.schema), ["latitude", "longitude", "timestamp"])
    query = stream.writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out)
    query.awaitTermination()
    assert spark.read.parquet(out).count() == 5


def test_window_counts_feed_psi(spark, tmp_path):
    landing, out, mark = (str(tmp_path / x) for x in ("landing", "out", "mark"))
    hours = 24 * 12
    frame = pd.DataFrame(
        {"timestamp": pd.date_range(START, periods=hours, freq="h"), "x": [float(h % 24) for h in range(hours)]}
    )
    frame.loc[24 * 8 :, "x"] += 30
    df = spark.createDataFrame(frame)
    df.coalesce(1).write.parquet(landing)
    profile = create_profile(df.where(F.col("x") < 24), ["x"])
    profile.write.parquet(str(tmp_path / "profile"))
    profile = spark.read.parquet(str(tmp_path / "profile"))
    counts = J.window_bin_counts(
        J.read_landed(spark, landing, df.schema), profile, ["x"], window="48 hours", slide="1 day"
    )
    query = (
        counts.writeStream.format("parquet").outputMode("append").option("checkpointLocation", mark)
        .trigger(availableNow=True).start(out)
    )
    query.awaitTermination()
    found = J.window_psi(spark.read.parquet(out), profile).orderBy("window").collect()
    by_end = {r["window"]["end"].day: r["psi"] for r in found}
    # A window is emitted when the watermark passes its end; the last ones stay open.
    assert by_end[5] < 0.01 < 1 < by_end[11] and max(by_end) <= 12
    direct = df.where((F.col("timestamp") >= "2024-01-03") & (F.col("timestamp") < "2024-01-05")).count()
    stored = spark.read.parquet(out).where(F.col("window.end") == "2024-01-05").agg(F.sum("n_cur")).first()[0]
    assert stored == direct == 48
