from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkdrift.config import QualityConfig
from sparkdrift.operators import quality as Q


def observations(n=24):
    rng = np.random.RandomState(0)
    return pd.DataFrame(
        {
            "timestamp": pd.date_range("2024-01-01", periods=n, freq="h"),
            "temperature": rng.uniform(-10, 30, n),
            "humidity": rng.uniform(30, 90, n),
            "precipitation": rng.uniform(0, 10, n),
            "wind_speed": rng.uniform(0, 50, n),
            "pressure": rng.uniform(990, 1030, n),
        }
    )


def result(spark, frame, **kwargs):
    return Q.validate(spark.createDataFrame(frame), **kwargs).first()


def test_clean_data_is_valid(spark):
    row = result(spark, observations())
    assert row["is_valid"] and row["quality_score"] == 1.0 and row["issues"] == []
    assert (row["total_records"], row["valid_records"]) == (24, 24)


@pytest.mark.parametrize(
    "column, bad", [("temperature", [100, -100]), ("humidity", [150, -10]), ("precipitation", [-5]), ("pressure", [800, 1200])]
)
def test_out_of_range(spark, column, bad):
    frame = observations()
    frame.loc[: len(bad) - 1, column] = bad
    row = result(spark, frame)
    found = {r["column"]: r["out_of_range_count"] for r in row["range_details"]}
    assert found[column] == len(bad) and sum(found.values()) == len(bad)
    assert row["valid_records"] == 24 - len(bad)
    share = len(bad) / 24 * 100
    assert row["issues"][0].startswith(f"{column}: {len(bad)} values ({share:.1f}%) out of range [")
    assert row["validity"] == pytest.approx((4 + 1 - len(bad) / 24) / 5)


def test_nulls_count_as_valid_rows(spark):
    frame = observations()
    frame.loc[:1, "temperature"] = np.nan
    row = result(spark, frame)
    nulls = {r["column"]: r["null_count"] for r in row["null_details"]}
    assert nulls["temperature"] == 2 and row["valid_records"] == 24
    assert row["issues"] == ["temperature: 2 null values (8.3%)"]
    assert row["completeness"] == pytest.approx(1 - 2 / 24 / 5)


def test_gap_lowers_consistency(spark):
    frame = observations(11)
    frame.loc[10, "timestamp"] = pd.Timestamp("2024-01-01 15:00")
    row = result(spark, frame)
    assert row["temporal_details"]["gaps_found"] == 1
    assert row["consistency"] == pytest.approx(0.9)
    assert row["issues"] == ["Found 1 time gaps > 2.0 hours (max gap: 6.0 hours)"]
    assert row["quality_score"] == pytest.approx(0.98)


def test_missing_columns_and_empty(spark):
    df = spark.createDataFrame(observations()).drop("pressure", "humidity")
    row = Q.validate(df).first()
    assert not row["is_valid"] and row["quality_score"] == 0
    assert row["issues"] == ["Missing required columns: ['humidity', 'pressure']"]
    empty = Q.validate(spark.createDataFrame(observations()).limit(0)).first()
    assert not empty["is_valid"] and empty["issues"] == ["DataFrame is empty"]
    assert (empty["quality_score"], empty["total_records"]) == (0, 0)


def test_wrong_types_are_reported(spark):
    df = spark.createDataFrame(observations()).withColumn("humidity", F.col("humidity").cast("string"))
    row = Q.validate(df.withColumn("timestamp", F.col("timestamp").cast("string"))).first()
    assert row["issues"][:2] == [
        "'timestamp' column is not datetime type",
        "'humidity' column is not numeric type",
    ]
    assert not row["is_valid"]


def test_single_row_and_all_null_column(spark):
    assert result(spark, observations(1))["consistency"] == 1.0
    frame = observations()
    frame["wind_speed"] = np.nan
    row = result(spark, frame)
    assert row["completeness"] == pytest.approx(0.8) and row["validity"] == 1.0


def test_outliers_per_column_and_per_row(spark):
    frame = observations()
    frame.loc[0, ["temperature", "pressure"]] = [1000, 0]
    df = spark.createDataFrame(frame)
    found = {r["feature"]: r["outliers"] for r in Q.iqr_outliers(df).collect()}
    for c in frame.columns[1:]:
        q1, q3 = frame[c].quantile([0.25, 0.75])
        outside = (frame[c] < q1 - 1.5 * (q3 - q1)) | (frame[c] > q3 + 1.5 * (q3 - q1))
        assert found[c] == outside.sum()
    assert Q.outlier_rows(df).first()["outlier_rows"] == 1
    assert sum(r["outliers"] for r in Q.iqr_outliers(df.limit(3)).collect()) == 0


def test_anomaly_flags(spark):
    frame = observations(200)
    frame.loc[5, "temperature"] = 500
    frame["humidity"] = 50.0
    got = Q.flag_anomalies(spark.createDataFrame(frame)).toPandas()
    z = ((frame["temperature"] - frame["temperature"].mean()) / frame["temperature"].std()).abs()
    assert (got.sort_values("timestamp")["temperature_anomaly"].to_numpy() == (z > 3).to_numpy()).all()
    assert got["is_anomaly"].sum() == 1 and not got["humidity_anomaly"].any()


def test_keys_grade_each_batch(spark):
    frame = pd.concat([observations().assign(batch="a"), observations(5).assign(batch="b", pressure=1.0)])
    rows = {r["batch"]: r for r in Q.validate(spark.createDataFrame(frame), keys=["batch"]).collect()}
    assert rows["a"]["quality_score"] == 1.0 and rows["b"]["valid_records"] == 0


def test_bounds_from_settings(spark):
    config = QualityConfig.from_mapping(
        {"data_quality": {"temperature_bounds": {"min": -60, "max": 5}, "min_completeness": 0.95}}
    )
    assert config.specs[0].upper == 5.0 and config.specs[1].upper == 100.0 and config.min_score == 0.95


def test_report_text(spark):
    text = Q.validation_report(Q.validate(spark.createDataFrame(observations()))).first()["report"]
    assert "Status: ✓ VALID" in text and "Quality Score: 100.00%" in text
    bad = Q.validation_report(Q.validate(spark.createDataFrame(observations()).drop("pressure"))).first()[0]
    assert "✗ INVALID" in bad and "  • Missing required columns: ['pressure']" in bad


def test_stats(spark):
    frame = observations()
    rows = {r["column"]: r for r in Q.column_stats(spark.createDataFrame(frame), list(frame.columns[1:])).collect()}
    for c in frame.columns[1:]:
        assert rows[c]["mean"] == pytest.approx(frame[c].mean())
        assert rows[c]["std"] == pytest.approx(frame[c].std())
