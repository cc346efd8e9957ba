"""Profiles, drift reports and the reference store on seeded frames."""

from __future__ import annotations

import json
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkdrift.config import DriftConfig, deep_merge
from sparkdrift.operators import detect as D
from sparkdrift.operators.distribution import to_long
from sparkdrift.operators import history
from sparkdrift.operators.history import feature_metrics
from sparkdrift.operators.reference import create_profile, profile_only_tests, reference_values
from sparkdrift.plans import drift_check as C
from sparkdrift.sources.references import ReferenceNotFoundError, ReferenceStore
from sparkdrift.sources.runs import report_json

NAMES = ["temperature_2m", "humidity", "precipitation"]


def frame(seed, n, temperature, humidity, rain):
    rng = np.random.RandomState(seed)
    return pd.DataFrame(
        {
            NAMES[0]: rng.normal(*temperature, n),
            NAMES[1]: rng.normal(*humidity, n),
            NAMES[2]: rng.exponential(rain, n),
        }
    )


REFERENCE = frame(42, 1000, (20, 5), (60, 15), 2)
STABLE = frame(123, 500, (20, 5), (60, 15), 2)
SHIFTED = frame(456, 500, (35, 5), (85, 15), 2)
SEVERE = frame(789, 500, (50, 10), (20, 5), 20)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    store = ReferenceStore(spark, str(tmp_path_factory.mktemp("references")))
    df = spark.createDataFrame(REFERENCE)
    C.create_reference(store, "raw", df, NAMES, metadata={"origin": "test"})
    C.create_reference(store, "bins", df, NAMES, keep_values=False)
    return store


def run(spark, store, current, name="raw", **kwargs):
    report, results = C.detect_drift(store, name, spark.createDataFrame(current), **kwargs)
    return report.first(), {r["feature_name"]: r for r in results.collect()}


def test_stable_data(spark, store):
    report, results = run(spark, store, STABLE)
    calm = [r for r in results.values() if r["severity"] in ("none", "low")]
    assert len(calm) >= 2
    assert report["reference_samples"] == 1000 and report["current_samples"] == 500


@pytest.mark.parametrize("name", ["raw", "bins"])
def test_shift_and_severe_drift(spark, store, name):
    report, results = run(spark, store, SHIFTED, name)
    assert report["drift_detected"] and results[NAMES[0]]["mean_shift"] > 10
    report, _ = run(spark, store, SEVERE, name)
    assert report["overall_severity"] in ("significant", "severe")
    assert report["overall_drift_score"] > 0.5
    assert report["recommendations"][0].startswith("URGENT")
    assert report["recommendations"][1].startswith("Investigate: temperature_2m")


def test_profile_equals_numpy(spark):
    frame = REFERENCE.assign(flag=np.arange(1000) % 2.0, fixed=3.0)
    rows = {
        r["feature"]: r
        for r in create_profile(spark.createDataFrame(frame), list(frame.columns)).collect()
    }
    for name, values in frame.items():
        r = rows[name]
        assert r["n_samples"] == 1000
        assert r["mean"] == pytest.approx(values.mean())
        assert r["std"] == pytest.approx(values.std(), abs=1e-12)
        assert r["median"] == pytest.approx(values.median())
        assert r["quantiles"]["5%"] == pytest.approx(values.quantile(0.05))
        edges = np.unique(np.percentile(values, np.linspace(0, 100, 11)))
        if name == "fixed":
            edges = np.array([3.0, 3.0 + 1e-10])
        assert r["bin_edges"] == pytest.approx(list(edges), rel=1e-12)
        assert r["bin_counts"] == list(np.histogram(values, edges)[0])


def test_profile_of_missing_values(spark):
    df = spark.createDataFrame(
        pd.DataFrame({"x": [1, 2, np.nan, 4, 5, np.nan, 7], "y": [np.nan] * 7})
    )
    row = create_profile(df, ["x"]).first()
    assert row["n_samples"] == 5 and sum(row["bin_counts"]) == 5
    single = create_profile(df.where("x = 4"), ["x"]).first()
    assert single["std"] is None and single["bin_counts"] == [1]
    with pytest.raises(Exception, match="no valid values in feature y"):
        create_profile(df, ["x", "y"]).collect()
    with pytest.raises(ValueError, match="missing columns"):
        create_profile(df, ["z"])


def test_profile_only_statistics(spark):
    """Against direct numeric integration of the piecewise linear profile."""
    df = spark.createDataFrame(REFERENCE)
    profile = create_profile(df, [NAMES[0]])
    current = SHIFTED[NAMES[0]].to_numpy()
    got = profile_only_tests(
        profile, to_long(spark.createDataFrame(SHIFTED), [NAMES[0]])
    ).first()
    values = REFERENCE[NAMES[0]].to_numpy()
    edges = np.percentile(values, np.linspace(0, 100, 11))
    mass = np.concatenate([[0], np.cumsum(np.histogram(values, edges)[0])]) / len(values)
    grid = np.linspace(min(edges[0], current.min()), max(edges[-1], current.max()), 400_001)
    f = np.interp(grid, edges, mass)
    g = np.searchsorted(np.sort(current), grid, side="right") / len(current)
    assert got["ks_statistic"] == pytest.approx(np.abs(f - g).max(), abs=2e-3)
    assert got["wasserstein"] == pytest.approx(np.abs(f - g).mean() * (grid[-1] - grid[0]), rel=1e-3)
    bins = np.linspace(grid[0], grid[-1], 11)
    p = np.clip(np.diff(np.interp(bins, edges, mass)), 1e-10, 1)
    q = np.clip(np.histogram(current, bins)[0] / len(current), 1e-10, 1)
    assert got["psi"] == pytest.approx(float(((q - p) * np.log(q / p)).sum()), rel=1e-6)


def test_warnings(spark, store):
    report, _ = run(spark, store, STABLE.head(3))
    assert report["warnings"] == ["Low samples (3 < 50): results may be unreliable"]
    report, results = run(spark, store, STABLE, features=[NAMES[0], "unknown"])
    assert report["warnings"] == ["Features not in reference: ['unknown']"] and len(results) == 1
    report, results = run(spark, store, STABLE.assign(humidity=np.nan))
    assert report["warnings"] == ["Feature 'humidity' has no valid values"]
    assert set(results) == {NAMES[0], NAMES[2]} and report["n_features_total"] == 2


def test_errors(spark, store):
    df = spark.createDataFrame(STABLE)
    with pytest.raises(ReferenceNotFoundError):
        C.detect_drift(store, "absent", df)
    with pytest.raises(ValueError, match="no valid features"):
        C.detect_drift(store, "raw", df, features=["unknown"])
    with pytest.raises(ValueError, match="missing columns"):
        C.detect_drift(store, "raw", df.drop("humidity"))
    with pytest.raises(ValueError, match="neither current data"):
        C.detect_drift(store, "raw")
    nothing = spark.createDataFrame(STABLE.assign(**{n: np.nan for n in NAMES}))
    with pytest.raises(Exception, match="no features could be analyzed"):
        C.detect_drift(store, "raw", nothing)[0].collect()
    assert C.check(store, "absent", current=df)[0] == 2
    assert C.check(store, "raw", current=spark.createDataFrame(SEVERE))[0] == 1


def test_missing_cells_are_tolerated(spark, store):
    holed = STABLE.copy()
    holed.loc[::10, NAMES[0]] = np.nan
    report, results = run(spark, store, holed)
    assert report["current_samples"] == 500 and NAMES[0] in results
    assert results[NAMES[0]]["current_mean"] == pytest.approx(holed[NAMES[0]].mean())


def test_window_of_a_table(spark, store):
    table = spark.createDataFrame(
        STABLE.assign(timestamp=pd.date_range("2024-01-01", periods=500, freq="h"))
    )
    now = datetime(2024, 1, 15)
    report, _ = C.detect_drift(store, "raw", table=table, hours=48, now=now)
    row = report.first()
    assert row["current_samples"] == 49
    assert row["current_window_end"] == datetime(2024, 1, 15)
    with pytest.raises(C.InsufficientDataError):
        C.detect_drift(store, "raw", table=table, now=datetime(2030, 1, 1))
    report, _ = C.detect_drift(store, "raw", table=table.drop("humidity"), hours=48, now=now)
    assert report.first()["warnings"][0] == "Feature 'humidity' missing from current data"


@pytest.mark.parametrize(
    "psi, js, level",
    [(0.05, 0.01, "none"), (0.1, 0, "low"), (0, 0.05, "low"), (0.15, 0, "moderate"), (0.2, 0, "significant"),
     (0.1, 0.2, "significant"), (0.5, 0, "severe"), (0, 0.4, "severe"), (float("inf"), 1, "severe")],
)
def test_severity(spark, psi, js, level):
    df = spark.createDataFrame([(float(psi), float(js))], "p double, j double")
    assert df.select(D.severity(F.col("p"), F.col("j"))).first()[0] == level


def test_config_spellings_and_isolation():
    config = DriftConfig.from_mapping(
        {"drift_detection": {"primary_method": "ks", "psi_thresholds": {"low": 0.3}, "ks_significance": 0.01}}
    )
    assert config.method == "ks" and config.psi["low"] == 0.3 and config.psi["severe"] == 0.5
    assert config.ks_p_value == 0.01 and DriftConfig().psi["low"] == 0.1
    base = {"a": {"b": 1}}
    deep_merge(base, {"a": {"b": 2}})["a"]["b"] = 3
    assert base == {"a": {"b": 1}}


def test_text_and_json(spark, store):
    report, results = C.detect_drift(store, "raw", spark.createDataFrame(SEVERE), report_id="abc")
    text = D.summary_lines(report, results).first()["summary"]
    assert "ID: abc | Reference: raw" in text and "Samples: 500 current vs 1,000 reference" in text
    assert text.index("[DRIFT]") < text.index("1. URGENT")
    document = json.loads(report_json(report, results).first()["report"])
    assert set(document["feature_results"]) == set(NAMES)


def test_history_tables(spark, store, tmp_path):
    report, results = C.detect_drift(store, "raw", spark.createDataFrame(SHIFTED), report_id="r")
    C.log_drift_run(str(tmp_path), report, results, "run-1", "weather", "3")
    assert C.log_drift_run_safe("/proc/nowhere", report, results, "run-1") is False
    metrics = spark.read.parquet(f"{tmp_path}/drift_run_metrics")
    assert metrics.count() == 3 + 6 * 3
    run_row = spark.read.parquet(f"{tmp_path}/drift_runs").first()
    assert run_row["current_window_hours"] == 168 and run_row["model_name"] == "weather"
    assert spark.read.parquet(f"{tmp_path}/drift_metrics").count() == 15
    keys = {r["key"] for r in metrics.collect()}
    assert {"temperature_2m_psi", "overall_drift_score", "humidity_ks_p_value"} <= keys


def test_features_with_long_common_names_stay_apart(spark):
    names = ["x" * 60 + end for end in ("a", "b", ".b", "-b")]
    results = spark.createDataFrame([("r", n, float(i)) for i, n in enumerate(names)], "run_id string, feature_name string, psi double")
    long = history.feature_metrics(results)
    assert {r["key"]: r["value"] for r in long.collect()} == {f"{n}_psi": float(i) for i, n in enumerate(names)}
    assert {r["display_name"] for r in long.collect()} == {"x" * 50 + "_psi"}
    runs = spark.createDataFrame([("r", 1)], "run_id string, timestamp int")
    assert history.drift_timeline(runs, long, names[1]).first()["psi"] == 1.0


def test_store(spark, store, tmp_path):
    names = [r["reference_name"] for r in store.list().collect()]
    assert names == ["bins", "raw"] and store.exists("raw") and not store.exists("x")
    meta = store.metadata("raw").first()
    assert meta["total_samples"] == 1000 and meta["features"] == NAMES
    assert meta["info"] == {"origin": "test"}
    assert store.load_values("bins") is None
    assert store.load_values("raw").groupBy("feature").agg(F.sum("cnt").alias("n")).first()["n"] == 1000
    other = ReferenceStore(spark, str(tmp_path))
    assert other.list() is None
    small = spark.createDataFrame(REFERENCE.head(10))
    for rows in (REFERENCE.head(20), REFERENCE.head(10)):
        df = spark.createDataFrame(rows)
        other.save("a", create_profile(df, NAMES), NAMES, reference_values(df, NAMES))
    assert other.load("a").first()["n_samples"] == 10
    other.save("a", create_profile(small, NAMES), NAMES)
    assert other.load_values("a") is None and other.features("a") == (NAMES, [])
    other.export_json("a", str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3
    assert other.delete("a") and not other.delete("a") and not other.exists("a")


def test_metric_rows(spark):
    df = spark.createDataFrame(
        [("r", "wind speed-10.m", 0.1, 0.2)], "run_id string, feature_name string, psi double, mean_shift double"
    )
    assert {x["key"] for x in feature_metrics(df).collect()} == {
        "wind_speed_10_m_psi",
        "wind_speed_10_m_mean_shift",
    }
