"""Metrics, models, registry tables and the training job."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkdrift.config import TrainingConfig
from sparkdrift.operators import metrics as M
from sparkdrift.operators import registry as R
from sparkdrift.operators.history import drift_history, drift_timeline
from sparkdrift.operators.windows import Series
from sparkdrift.plans import models as P
from sparkdrift.plans.training import claim_version, run_training, score_period, time_folds
from tests.test_windows import weather


def test_metrics_equal_numpy(spark):
    rng = np.random.RandomState(5)
    y = rng.normal(10, 3, 500)
    p = y + rng.normal(0.5, 1, 500)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p": p}))
    row = M.regression_metrics(df, "y", "p", list(M.METRICS)).first()
    e = y - p
    assert row["rmse"] == pytest.approx(np.sqrt((e**2).mean()))
    assert row["r2"] == pytest.approx(1 - (e**2).sum() / ((y - y.mean()) ** 2).sum())
    assert row["mape"] == pytest.approx((abs(e) / abs(y)).mean())
    report = M.residual_report(df, "y", "p").first()
    z = (e - e.mean()) / e.std()
    assert report["residual_skewness"] == pytest.approx((z**3).mean())
    assert report["residual_kurtosis"] == pytest.approx((z**4).mean() - 3)
    assert report["p95"] == pytest.approx(np.percentile(abs(e), 95))
    histogram = M.residual_histogram(df, "y", "p").orderBy("bin").toPandas()
    assert list(histogram["n"]) == list(np.histogram(e, 50)[0])
    points = M.qq_points(df, "y", "p", 3).orderBy("point").toPandas()
    assert list(points["residual_quantile"]) == pytest.approx(list(np.quantile(e, [0.25, 0.5, 0.75])))
    with pytest.raises(ValueError, match="unknown metrics"):
        M.regression_metrics(df, "y", "p", ["mad"])


def test_r2_edge_cases(spark):
    def r2(*pairs):
        df = spark.createDataFrame([(float(a), float(b)) for a, b in pairs], "y double, p double")
        return M.regression_metrics(df, "y", "p", ["r2"]).first()["r2"]

    assert r2((1, 1)) is None and r2((2, 2), (2, 2)) == 1.0 and r2((2, 2), (2, 3)) == 0.0


def test_weeks_start_on_monday_and_single_rows_are_dropped(spark):
    days = ["2024-01-01", "2024-01-07", "2024-01-08"]
    df = spark.createDataFrame([(d, 1.0, 2.0) for d in days], "d string, y double, p double")
    rows = M.metrics_by_period(df.withColumn("t", F.col("d").cast("timestamp")), "y", "p", "t", "W").collect()
    assert [(str(r["period"])[:10], r["n_samples"]) for r in rows] == [("2024-01-01", 2)]
    with pytest.raises(ValueError, match="unknown period"):
        M.metrics_by_period(df, "y", "p", "d", "M")


def test_ridge_equals_closed_form(spark):
    rng = np.random.RandomState(1)
    x = rng.normal(0, 1, (200, 3)) * [1, 10, 0.1] + [5, 0, 1]
    y = x @ [2.0, -0.5, 7.0] + 3 + rng.normal(0, 1, 200)
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y))
    model = P.fit_model("ridge", df, ["a", "b", "c"], "y", alpha=1.0)
    centred = x - x.mean(0)
    want = np.linalg.solve(centred.T @ centred + np.eye(3), centred.T @ (y - y.mean()))
    assert list(model.stages[1].coefficients) == pytest.approx(list(want), rel=1e-9)
    assert model.stages[1].intercept == pytest.approx(y.mean() - x.mean(0) @ want, rel=1e-9)
    weights = {r["feature"]: r["importance"] for r in P.feature_importance(spark, model).collect()}
    assert weights["b"] == pytest.approx(abs(want[1]))
    with pytest.raises(ValueError, match="unknown model type"):
        P.create_model("svm", df, "y")


def test_trees_learn(spark):
    rng = np.random.RandomState(2)
    x = rng.uniform(0, 1, 300)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": (x > 0.5) * 10.0}))
    for kind, params in (("random_forest", {"trees": 5}), ("gradient_boosting", {"rounds": 5})):
        scored = P.fit_model(kind, df, ["x"], "y", **params).transform(df)
        assert M.regression_metrics(scored, "y", "prediction").first()["r2"] > 0.9


VERSIONS = [("m", 2, "Production", "r2"), ("m", 10, "Staging", "r10"), ("m", 9, "Staging", "r9"), ("n", 1, "None", "n1")]
METRICS = [("r2", "test_rmse", 3.0), ("r2", "test_r2", 0.5), ("r10", "test_rmse", 2.0), ("r10", "test_r2", 0.4), ("r9", "rmse", 1.0)]


@pytest.fixture(scope="module")
def tables(spark):
    versions = spark.createDataFrame(VERSIONS, "model_name string, version bigint, stage string, run_id string")
    return versions, spark.createDataFrame(METRICS, "run_id string, key string, value double")


def test_registry_tables(spark, tables):
    versions, metrics = tables
    newest = {(r["model_name"], r["stage"]): r["version"] for r in R.latest_by_stage(versions).collect()}
    assert newest[("m", "Staging")] == 10
    info = R.model_info(versions, metrics).collect()
    assert [r["version"] for r in info if r["model_name"] == "m"] == [10, 9, 2]
    assert {r["run_id"]: r["metrics"] for r in info}["n1"] is None
    listed = {r["model_name"]: r["latest_versions"] for r in R.list_models(versions).collect()}
    assert listed["m"] == {"Production": 2, "Staging": 10}
    compared = {r["key"]: r for r in R.compare_versions(versions, metrics, 2, 10).collect()}
    assert compared["test_rmse"]["better_version"] == 10 and compared["test_rmse"]["difference"] == -1.0
    assert compared["test_r2"]["better_version"] == 2


def test_promotion_and_comparison(spark, tables):
    versions, metrics = tables
    chosen = spark.createDataFrame([("m", 10)], "model_name string, version bigint")
    after = {(r["model_name"], r["version"]): r["stage"] for r in R.promote_model(versions, chosen, "Production").collect()}
    assert after == {("m", 10): "Production", ("m", 2): "Archived", ("m", 9): "Staging", ("n", 1): "None"}
    with pytest.raises(ValueError, match="invalid stage"):
        R.promote_model(versions, chosen, "Live")
    candidates = spark.createDataFrame(
        [("m", "r10"), ("m", "r9"), ("m", "r2"), ("n", "n1")], "model_name string, run_id string"
    )
    got = {r["run_id"]: (r["is_better"], r["reason"]) for r in R.compare_production(candidates, versions, metrics).collect()}
    assert got == {
        "r10": (True, "compared"),
        "r9": (True, "compared"),
        "r2": (False, "compared"),
        "n1": (True, "no production model"),
    }


def test_gate(spark):
    df = spark.createDataFrame([(5.0, 0.5), (5.1, 0.9), (None, 0.9), (1.0, None)], "rmse double, r2 double")
    assert [r["meets_threshold"] for r in R.register_gate(df).collect()] == [True, False, False, False]


def test_drift_history(spark):
    runs = spark.createDataFrame([(f"r{i}", f"2024-01-0{i + 1}", "m" if i else "n") for i in range(5)], "run_id string, t string, model_name string")
    runs = runs.withColumn("timestamp", F.col("t").cast("timestamp")).drop("t")
    metrics = spark.createDataFrame([(f"r{i}", "a_b_psi", 0.05 + 0.06 * i) for i in range(5)], "run_id string, key string, value double")
    got = drift_history(runs, metrics, ["a_b_psi", "absent"], 3).orderBy("timestamp").collect()
    assert [r["run_id"] for r in got] == ["r2", "r3", "r4"] and got[0]["absent"] is None
    assert drift_history(runs, metrics, ["a_b_psi"], 30, "m").count() == 4
    bands = [r["band"] for r in drift_timeline(runs, metrics, "a b").collect()]
    assert bands == ["none", "low", "moderate", "significant", "significant"]


def test_training_job_registers_and_serves(spark, tmp_path):
    df = spark.createDataFrame(weather())
    series, root = Series((), chunk_rows=200), str(tmp_path)
    gate = TrainingConfig(test_days=5, validation_days=3, max_rmse=50.0, min_r2=-100.0)
    first = run_training(spark, df, series, root, "weather", "run-1", "ridge", training=gate)
    assert first["version"] == 1 and first["is_better"]
    assert set(first["metrics"]) >= {"train_rmse", "val_rmse", "test_rmse", "test_r2"}
    second = run_training(spark, df, series, root, "weather", "run-2", "ridge", training=gate, alpha=5.0)
    assert second["version"] == 2
    refused = run_training(
        spark, df, series, root, "weather", "run-3", "ridge", training=TrainingConfig(5, 3, 0.01, 0.99)
    )
    assert refused["version"] is None and not refused["meets_threshold"]
    versions = spark.read.parquet(f"{root}/model_versions")
    assert versions.count() == 2
    with pytest.raises(LookupError, match="no Production or Staging"):
        P.load_serving(spark, versions, f"{root}/models", "weather")
    promoted = R.promote_model(versions, versions.where("version = 2"), "Staging")
    model = P.load_serving(spark, promoted, f"{root}/models", "weather")
    predictions, scored = score_period(model, df, series)
    assert scored.first()["n_samples"] == 684 and "prediction" in predictions.columns
    with pytest.raises(LookupError, match="not found"):
        P.load_version(spark, f"{root}/models", "weather", 7)


def test_folds_expand(spark):
    df = spark.createDataFrame(weather(600))
    rows = time_folds(df, folds=4).groupBy("segment").agg(F.max("timestamp").alias("e"), F.min("timestamp").alias("s")).orderBy("segment").collect()
    assert [r["segment"] for r in rows] == [0, 1, 2, 3, 4]
    assert all(a["e"] < b["s"] for a, b in zip(rows, rows[1:]))


@pytest.mark.parametrize("kind", ["random_forest", "gradient_boosting"])
def test_full_size_trees_fit_a_step_and_a_slope(spark, kind):
    rng = np.random.RandomState(5)
    frame = pd.DataFrame({"a": rng.uniform(0, 10, 400), "b": rng.uniform(0, 1, 400)})
    frame["y"] = 3.0 * (frame["a"] > 5) + frame["a"] * 0.5 + rng.normal(0, 0.05, 400)
    df = spark.createDataFrame(frame)
    model = P.fit_model(kind, df, ["a", "b"], "y")
    assert model.stages[-1].getNumTrees == 100
    error = model.transform(df).select(F.sqrt(F.avg((F.col("prediction") - F.col("y")) ** 2)).alias("e")).first()["e"]
    assert error < 0.1 * frame["y"].std()


def test_two_runs_from_one_state_get_two_versions(spark, tmp_path):
    root = str(tmp_path)
    assert [claim_version(spark, root, "m", 4) for _ in range(3)] == [5, 6, 7]
    assert claim_version(spark, root, "other", 0) == 1 and claim_version(spark, root, "m", 9) == 10
