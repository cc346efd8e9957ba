"""Sliding two-sample tests by look-up, against direct tests of every window."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkdrift.operators import detect as D
from sparkdrift.operators import drift as T
from sparkdrift.operators.distribution import TwoSample

START = datetime(2024, 1, 1)


def frame(seed=0, n=1500):
    rng = np.random.RandomState(seed)
    days = rng.randint(0, 14, n)
    few = np.where(rng.rand(n) < 0.4, 2.0, rng.randint(0, 5, n))  # one value holds much of the data
    out = pd.DataFrame({
        "t": [START + timedelta(days=int(d), hours=int(h)) for d, h in zip(days, rng.randint(0, 24, n))],
        "x": rng.normal(days, 3).round(2), "few": few, "wide": rng.choice([-1, 1], n) * rng.lognormal(0, 6, n),
        "same": 1.0, "holes": np.where(rng.rand(n) < 0.3, np.nan, rng.normal(0, 1, n)),
    })
    out.loc[days == 9, "x"] += 1e6
    return out


def brute(ref, cur):
    points = np.unique(np.concatenate([ref, cur]))
    gap = np.abs(np.searchsorted(np.sort(ref), points, "right") / len(ref) - np.searchsorted(np.sort(cur), points, "right") / len(cur))
    return gap.max(), float((gap[:-1] * np.diff(points)).sum())


@pytest.mark.parametrize("cells", [4096, 3])
def test_every_window_equals_a_direct_test(spark, monkeypatch, cells):
    monkeypatch.setattr(D, "RANK_CELLS", cells)
    data, names = frame(), ["x", "few", "wide", "same", "holes"]
    cut = START + timedelta(days=5)
    df = spark.createDataFrame(data)
    got = D.sliding_cdf_tests(df, names, "t", F.col("t") < F.lit(cut), 3).collect()
    found = {(r["feature"], str(r["window_end"])): r for r in got}
    assert len(found) == len(got) == 5 * 9
    day = data["t"].dt.floor("D")
    for name in names:
        ref = data.loc[data["t"] < cut, name].dropna().to_numpy()
        for end in range(5, 14):
            last = START + timedelta(days=end)
            inside = (day <= last) & (day > last - timedelta(days=3)) & (data["t"] >= cut)
            cur = data.loc[inside, name].dropna().to_numpy()
            row = found[name, str(last.date())]
            ks, area = brute(ref, cur)
            assert row["ks_statistic"] == pytest.approx(ks, abs=1e-12)
            assert row["wasserstein"] == pytest.approx(area, rel=1e-9, abs=1e-9)
    last = START + timedelta(days=13)
    newest = df.where((F.col("t") < F.lit(cut)) | (F.date_trunc("day", "t") > F.lit(last - timedelta(days=3))))
    for r in T.ks_test(TwoSample.split(newest, names, F.col("t") < F.lit(cut))).collect():
        assert found[r["feature"], str(last.date())]["ks_p_value"] == pytest.approx(r["ks_p_value"], abs=1e-12)
    assert found["same", str(last.date())]["ks_p_value"] == 1.0


def test_windows_without_a_reference_are_left_out(spark):
    df = spark.createDataFrame([(START, 1.0, None), (START + timedelta(days=1), 2.0, 3.0)], "t timestamp, a double, b double")
    got = D.sliding_cdf_tests(df, ["a", "b"], "t", F.col("t") < F.lit(START + timedelta(days=1))).collect()
    assert [(r["feature"], r["ks_statistic"], r["wasserstein"], r["ks_p_value"]) for r in got] == [("a", 1.0, 1.0, 0.0)]
    assert D.sliding_cdf_tests(df.limit(0), ["a"], "t", F.lit(True)).collect() == []


def test_the_reference_is_not_repeated_per_window(spark):
    df = spark.createDataFrame(frame(2, 300))
    plan = D.sliding_cdf_tests(df, ["x"], "t", F.col("t") < F.lit(START + timedelta(days=5)))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
