"""Features and target from one cut, against the same steps one after another."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from sparkdrift.config import FeatureConfig
from sparkdrift.operators.transform import DEFAULT_ZONE
from sparkdrift.operators import split, windows
from sparkdrift.operators.split import build_features, build_training_frame, numeric_columns
from sparkdrift.operators.transform import add_calendar
from sparkdrift.operators.windows import Series

CONFIG = FeatureConfig(
    measures=("a", "b", "n"), lag_columns=("a", "n", "label"), rolling_columns=("a", "b"), lags=(1, 3), windows=(2, 5),
    target_source="a", target="target", horizon=4, excluded=(*FeatureConfig().excluded, "s", "label"),
)


def frame(spark):
    """Series of very different lengths with long holes, at the start as well; one has no value of b."""
    rng = np.random.RandomState(3)
    rows = []
    for s, n in (("long", 140), ("short", 3), ("one", 1), ("mid", 30)):
        for i in range(n):
            hole = (20 <= i < 41) or i < 2 or rng.rand() < 0.2
            rows.append((s, datetime(2024, 1, 1) + timedelta(hours=i), None if hole else float(rng.normal()),
                         None if s == "mid" or rng.rand() < 0.5 else float(i), None if rng.rand() < 0.3 else i, f"x{i}"))
    return spark.createDataFrame(rows, "s string, timestamp timestamp, a double, b double, n int, label string").repartition(4)


def one_after_another(df, series, target):
    calendar = add_calendar(df, series.time, DEFAULT_ZONE)
    wide = windows.add_lags_and_rolling(
        calendar, series, CONFIG.lag_columns, CONFIG.lags, CONFIG.rolling_columns, CONFIG.windows, keep_position=True
    )
    numeric = [c for c in numeric_columns(wide, CONFIG) if c != windows.ROW and c not in series.keys]
    filled = windows.fill_features(wide, numeric, series, True)
    if not target:
        return filled.drop(windows.ROW)
    return windows.future_max(filled, "a", series, CONFIG.horizon, "target")


def table(df):
    return df.toPandas().sort_values(["s", "timestamp"]).reset_index(drop=True)


@pytest.mark.parametrize("chunk", [1, 7, 50_000])
@pytest.mark.parametrize("keyed", [True, False])
def test_one_cut_equals_separate_steps(spark, monkeypatch, chunk, keyed):
    monkeypatch.setattr(windows, "SPAN", 3)
    series = Series(("s",) if keyed else (), "timestamp", () if keyed else ("s",), chunk)
    df = frame(spark)
    for build, target in ((build_features, False), (build_training_frame, True)):
        got, want = table(build(df, series, CONFIG)), table(one_after_another(df, series, target))
        assert list(got.columns) == list(want.columns)
        pd.testing.assert_frame_equal(got, want, check_exact=False, rtol=1e-12)


def test_rows_are_cut_and_dealt_once(spark):
    df = frame(spark).repartition(8)
    built = build_training_frame(df, Series(("s",), "timestamp"), CONFIG)
    plan = built._jdf.queryExecution().optimizedPlan().toString()
    # The range exchange is behind the written cut; chunks are dealt by one window partitioning.
    assert len(set(re.findall(r"windowspecdefinition\(([^,]*s#\d+, __chunk#\d+L)", plan))) == 1
    physical = built._jdf.queryExecution().executedPlan().toString()
    initial = physical.split("== Initial Plan ==")[-1]
    assert len(re.findall(r"Exchange hashpartitioning\(s#\d+, __chunk#", initial)) == 1
    assert "rangepartitioning" not in initial and split.build_training_frame is build_training_frame


def test_empty_frames(spark):
    df = frame(spark).limit(0)
    assert build_training_frame(df, Series(("s",), "timestamp"), CONFIG).collect() == []
