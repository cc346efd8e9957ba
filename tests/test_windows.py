"""Chunked series operators equal plain pandas computations, whatever the chunk size."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkdrift.config import FeatureConfig
from sparkdrift.operators import windows as W
from sparkdrift.operators.split import (
    build_features,
    build_training_frame,
    feature_matrix,
    feature_names,
    split_info,
    temporal_split,
)

SMALL = dict(chunk_rows=5)


def hourly(n=120, seed=42, holes=0.15, series="a"):
    rng = np.random.RandomState(seed)
    frame = pd.DataFrame(
        {
            "series": series,
            "timestamp": pd.date_range("2024-01-01", periods=n, freq="h"),
            "x": 15 + 10 * np.sin(2 * np.pi * np.arange(n) / 24) + rng.normal(0, 2, n),
            "y": rng.uniform(0, 1, n),
        }
    )
    frame.loc[rng.rand(n) < holes, "x"] = np.nan
    return frame


@pytest.fixture(scope="module")
def two_series():
    # One series holds nearly all rows.
    return pd.concat([hourly(150, 1), hourly(10, 2, series="b")], ignore_index=True)


def to_spark(spark, frame):
    df = spark.createDataFrame(frame)
    return df.withColumns({c: F.nanvl(c, F.lit(None)) for c in ("x", "y") if c in frame.columns})


def collect(df, *order):
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)


@pytest.mark.parametrize("layout", [{}, SMALL, dict(chunk_rows=1)])
def test_lags_rolling_and_future_max(spark, two_series, layout):
    series = W.Series(("series",), **layout)
    df = to_spark(spark, two_series)
    got = collect(
        W.add_lags_and_rolling(df, series, ["x", "y"], [1, 3], ["x"], [4]), "series", "timestamp"
    )
    by = two_series.groupby("series")
    for lag in (1, 3):
        for c in ("x", "y"):
            np.testing.assert_array_equal(got[f"{c}_lag_{lag}h"], by[c].shift(lag))
    rolling = by["x"].rolling(4, min_periods=1)
    for stat in ("mean", "min", "max"):
        want = getattr(rolling, stat)().to_numpy()
        np.testing.assert_allclose(got[f"x_rolling_{stat}_4h"].astype(float), want)
    want = by["x"].rolling(4, min_periods=2).std().to_numpy()
    np.testing.assert_allclose(got["x_rolling_std_4h"].astype(float), want, atol=1e-9)

    strict = collect(W.future_max(df, "x", series, 6), "series", "timestamp")
    lenient = collect(W.future_max_lenient(df, "x", series, 6), "series", "timestamp")
    want_strict, want_lenient = [], []
    for _, g in by:
        values = g["x"].to_numpy()
        for i in range(len(values)):
            ahead = values[i + 1 : i + 7]
            best = np.nan if np.isnan(ahead).all() else np.nanmax(ahead)
            want_lenient.append(best)
            want_strict.append(best if len(ahead) >= 3 else np.nan)
    np.testing.assert_array_equal(lenient["next_day_max_temp"].astype(float), want_lenient)
    np.testing.assert_array_equal(strict["target"].astype(float), [v for v in want_strict if v == v])


@pytest.mark.parametrize("layout", [{}, SMALL])
def test_forward_fill_crosses_chunks(spark, two_series, layout):
    frame = two_series.copy()
    frame.loc[20:60, "x"] = np.nan
    got = collect(
        W.forward_fill(to_spark(spark, frame), ["x"], W.Series(("series",), **layout)),
        "series",
        "timestamp",
    )
    np.testing.assert_array_equal(got["x"].astype(float), frame.groupby("series")["x"].ffill())


def test_one_series_without_keys_and_ties(spark):
    n = 60
    frame = pd.DataFrame(
        {"timestamp": pd.Timestamp("2024-01-01"), "id": np.arange(n)[::-1], "x": np.arange(float(n))[::-1]}
    )
    series = W.Series((), tie=("id",), **SMALL)
    got = collect(W.add_lags(to_spark(spark, frame), ["x"], series, [2]), "id")
    np.testing.assert_array_equal(got["x_lag_2h"], pd.Series(np.arange(float(n))).shift(2))


def test_rows_without_time_come_last_and_null_keys_are_a_series(spark):
    df = spark.createDataFrame(
        [(None, "2024-01-01", 1.0), (None, None, 3.0), (None, "2024-01-02", 2.0), ("a", "2024-01-05", 9.0)],
        "series string, t string, x double",
    ).withColumn("timestamp", F.col("t").cast("timestamp"))
    got = {r["x"]: r["x_lag_1h"] for r in W.add_lags(df, ["x"], W.Series(("series",)), [1]).collect()}
    assert got == {1.0: None, 2.0: 1.0, 3.0: 2.0, 9.0: None}


def test_time_gaps_across_slices(spark):
    frame = hourly(80, holes=0).drop(index=[10, 11, 12, 40, 41, 70]).sample(frac=1, random_state=1)
    row = W.time_gaps(to_spark(spark, frame), W.Series(())).first()
    assert (row["total_intervals"], row["gaps_found"], row["max_gap_hours"]) == (73, 2, 4.0)
    doubled = to_spark(spark, pd.concat([frame, frame]))
    row = W.time_gaps(doubled, W.Series(())).first()
    assert (row["total_intervals"], row["gaps_found"], row["max_gap_hours"]) == (147, 2, 4.0)


@pytest.fixture
def uncoalesced(spark):
    # A small table would be put into one partition.
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_slices_hold_even_numbers_of_rows(spark, uncoalesced):
    # Even rows, one row from 1970, one busy day, and many rows without a time.
    df = spark.range(40_000).select(
        F.when(F.col("id") == 0, F.lit(0))
        .when(F.col("id") < 10_000, 1_700_000_000 + F.col("id") * 60)
        .when(F.col("id") < 25_000, F.lit(1_701_000_000))
        .cast("timestamp")
        .alias("timestamp"),
        "id",
    )
    series = W.Series((), tie=("id",))
    order = [F.col(c).asc_nulls_last() for c in ("timestamp", "id")]
    sizes = [r["count"] for r in W.slices(df, (), order).groupBy(W.SLICE).count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 2 * 40_000 / len(sizes)
    numbered = W.number_rows(df, series)
    wanted = pd.concat([pd.Series(np.arange(40_000))])
    got = numbered.select("id", W.ROW).toPandas().sort_values("id")
    assert (got[W.ROW].to_numpy() == wanted.to_numpy()).all()


def test_fill_carries_over_many_spans(spark, monkeypatch):
    monkeypatch.setattr(W, "SPAN", 2)
    frame = hourly(60, holes=0)
    frame.loc[3:50, "x"] = np.nan
    got = collect(W.forward_fill(to_spark(spark, frame), ["x"], W.Series((), chunk_rows=2)), "timestamp")
    np.testing.assert_array_equal(got["x"], frame["x"].ffill())


def test_gap_of_exactly_the_limit_and_single_row(spark):
    frame = hourly(3, holes=0).drop(index=[1])
    row = W.time_gaps(to_spark(spark, frame), W.Series(())).first()
    assert (row["gaps_found"], row["max_gap_hours"]) == (0, 2.0)
    single = W.time_gaps(to_spark(spark, hourly(1, holes=0)), W.Series(())).first()
    assert (single["total_intervals"], single["gaps_found"], single["max_gap_hours"]) == (0, 0, None)


def test_densify(spark):
    frame = hourly(60, holes=0).drop(index=[5, 6, 30])
    got = collect(W.densify_hourly(to_spark(spark, frame), W.Series(("series",)), ["x"]), "timestamp")
    assert len(got) == 60
    assert list(got.index[got["x"].isna()]) == [5, 6, 30]


def weather(n=720, seed=42):
    rng = np.random.RandomState(seed)
    return pd.DataFrame(
        {
            "timestamp": pd.date_range("2024-01-01", periods=n, freq="h"),
            "temperature_2m": 15 + 10 * np.sin(2 * np.pi * np.arange(n) / 24) + rng.normal(0, 2, n),
            "relative_humidity_2m": 60 + 20 * rng.rand(n),
            "precipitation": rng.exponential(0.5, n),
            "wind_speed_10m": 10 + 5 * rng.rand(n),
            "surface_pressure": 1013 + rng.normal(0, 5, n),
            "location_name": "Test City",
            "latitude": 40.7128,
            "longitude": -74.0060,
        }
    )


SERIES = W.Series((), chunk_rows=100)


def test_default_features_and_matrix(spark):
    names = feature_names()
    assert len(names) == len(set(names)) == 30
    df = spark.createDataFrame(weather()).withColumn("cloud_cover", F.lit(None).cast("double"))
    built = build_features(df, SERIES)
    assert set(names) <= set(built.columns)
    frame = build_training_frame(df, SERIES)
    matrix = feature_matrix(frame)
    assert set(matrix.columns) == {*names, "target_next_day_max_temp"}
    rows = matrix.toPandas()
    assert len(rows) == 720 - 12 - 24 and not rows.isna().any().any()


def test_order_of_lag_and_fill(spark):
    frame = weather(60)
    frame.loc[30, "temperature_2m"] = np.nan
    df = spark.createDataFrame(frame).withColumn(
        "temperature_2m", F.nanvl("temperature_2m", F.lit(None))
    )
    got = collect(build_features(df, SERIES), "timestamp")
    # The measure is filled after the lag was taken, then the lag itself is filled forward.
    assert got.loc[30, "temperature_2m"] == frame.loc[29, "temperature_2m"]
    assert got.loc[31, "temperature_2m_lag_1h"] == got.loc[30, "temperature_2m_lag_1h"]
    assert got.loc[0, "temperature_2m_rolling_std_6h"] == 0


def test_split_is_ordered_and_complete(spark):
    frame = build_training_frame(spark.createDataFrame(weather()), SERIES)
    labelled = temporal_split(frame, test_days=5, validation_days=3)
    info = {r["split"]: r for r in split_info(labelled).collect()}
    assert info["train"]["end"] < info["val"]["start"] <= info["val"]["end"] < info["test"]["start"]
    assert sum(r["samples"] for r in info.values()) == frame.count()
    assert (info["test"]["end"] - info["test"]["start"]).days == 5


def test_split_of_too_short_data_fails(spark):
    df = spark.createDataFrame(weather(120))
    with pytest.raises(Exception, match="insufficient data for split"):
        temporal_split(df, test_days=10, validation_days=5).collect()


def test_two_measures_are_enough(spark):
    frame = weather(360)[["timestamp", "temperature_2m", "relative_humidity_2m"]]
    assert feature_matrix(build_training_frame(spark.createDataFrame(frame), SERIES)).count() > 0
    with pytest.raises(ValueError, match="missing columns"):
        build_training_frame(spark.createDataFrame(frame.drop(columns="temperature_2m")), SERIES)


def test_config_from_settings():
    config = FeatureConfig.from_mapping(
        {"features": {"lag_hours": [2], "rolling_columns": ["precipitation"]}, "model": {"target": "t"}}
    )
    assert config.lags == (2,) and config.rolling_columns == ("precipitation",)
    assert config.target == "t" and config.windows == (6, 24)


def test_plan_splits_a_single_series(spark, sf_dir):
    """No window may gather the whole table in one partition."""
    from contract.views import events

    plan = W.add_lags(events(spark, sf_dir), ["value"], W.Series((), "ts", ("event_id",)))
    text = plan._jdf.queryExecution().executedPlan().toString()
    lines = text.splitlines()
    single = [i for i, line in enumerate(lines) if "Exchange SinglePartition" in line]
    # Only the table of bucket sizes is accumulated in one place, after its aggregation.
    assert all("HashAggregate" in lines[i + 1] for i in single)
    assert "Python" not in text
