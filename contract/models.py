"""Model metrics, models and the registry tables."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from contract.registry import query
from contract.series import TRAINING
from contract.series import _ALL as ALL_FEATURES
from contract.views import OBS_FEATURES, SERIES, events, lineitem, obs_dense
from sparkdrift.config import TrainingConfig
from sparkdrift.operators import metrics as M
from sparkdrift.operators import registry as R
from sparkdrift.plans.models import fit_model, feature_importance
from sparkdrift.plans.training import prepare_data, score_period, train_model

_Y, _P = "l_extendedprice", "prediction"


def _pred(spark, sf):
    """Line items priced by a fixed rule."""
    return lineitem(spark, sf).withColumn(_P, F.col("l_quantity") * 2000)


_PRED_SQL = """pred AS (SELECT *, l_extendedprice AS y, l_quantity * 2000 AS p,
  l_extendedprice - l_quantity * 2000 AS r FROM lineitem)"""
_METRICS_SQL = """count(*) AS n_samples, sqrt(avg(r * r)) AS rmse, avg(r * r) AS mse, avg(abs(r)) AS mae,
  CASE WHEN count(*) >= 2 THEN CASE WHEN var_pop(y) > 0 THEN 1 - avg(r * r) / var_pop(y)
    WHEN sum(r * r) = 0 THEN 1 ELSE 0 END END AS r2,
  avg(abs(r) / greatest(abs(y), 2.220446049250313e-16)) AS mape"""


@query(
    "regression_metrics",
    "n_samples:i rmse:f4 mse:f0 mae:f4 r2:f6 mape:f6",
    f"WITH {_PRED_SQL} SELECT {_METRICS_SQL} FROM pred",
)
def _(spark, sf):
    return M.regression_metrics(_pred(spark, sf), _Y, _P, ["rmse", "mse", "mae", "r2", "mape"])


@query(
    "metrics_by_period",
    "freq:s period:t n_samples:i mean_residual:f4 std_residual:f4 rmse:f4 mae:f4 r2:f6 mape:f6",
    f"""WITH pred AS (SELECT l_shipdate, floor(l_extendedprice) AS y, l_quantity * 2000 AS p,
  floor(l_extendedprice) - l_quantity * 2000 AS r FROM lineitem)"""
    + "\nUNION ALL ".join(
        f"""{"" if i else " "}SELECT '{f}' AS freq, date_trunc('{u}', l_shipdate) AS period, avg(r) AS mean_residual,
  stddev_samp(r) AS std_residual, {_METRICS_SQL} FROM pred GROUP BY period HAVING count(*) >= 2"""
        for i, (f, u) in enumerate((("D", "day"), ("W", "week")))
    ),
)
def _(spark, sf):
    # Whole prices keep every sum exact, whatever the order of adding.
    whole = _pred(spark, sf).withColumn(_Y, F.floor(_Y))
    parts = [
        M.metrics_by_period(whole, _Y, _P, "l_shipdate", f).withColumn("freq", F.lit(f))
        for f in ("D", "W")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "metrics_by_hour",
    "period:t n_samples:i mean_residual:f4 std_residual:f4 rmse:f4 mae:f4 r2:f6 mape:f6",
    f"""WITH pred AS (SELECT ts, floor(value) + 1 AS y, event_id % 50 AS p, floor(value) + 1 - event_id % 50 AS r FROM events)
SELECT date_trunc('hour', ts) AS period, avg(r) AS mean_residual, stddev_samp(r) AS std_residual, {_METRICS_SQL}
FROM pred GROUP BY period HAVING count(*) >= 2""",
)
def _(spark, sf):
    pred = events(spark, sf).select("ts", (F.floor("value") + 1).alias("y"), (F.col("event_id") % 50).alias("p"))
    return M.metrics_by_period(pred, "y", "p", "ts", "H")


@query(
    "residual_report",
    "n_samples:i rmse:f4 mae:f4 r2:f6 mape:f6 residual_mean:f4 residual_std:f4 residual_min:f4 "
    "residual_max:f4 residual_skewness:f6 residual_kurtosis:f6 p50:f4 p90:f4 p95:f4 p99:f4",
    f"""WITH {_PRED_SQL},
m AS (SELECT avg(r) AS mu, stddev_pop(r) AS sd FROM pred)
SELECT {_METRICS_SQL}, avg(r) AS residual_mean, stddev_pop(r) AS residual_std, min(r) AS residual_min,
  max(r) AS residual_max, avg(((r - mu) / sd) ** 3) AS residual_skewness,
  avg(((r - mu) / sd) ** 4) - 3 AS residual_kurtosis, quantile_cont(abs(r), 0.5) AS p50,
  quantile_cont(abs(r), 0.9) AS p90, quantile_cont(abs(r), 0.95) AS p95, quantile_cont(abs(r), 0.99) AS p99
FROM pred, m""",
)
def _(spark, sf):
    return M.residual_report(_pred(spark, sf), _Y, _P)


_RBIN = " + ".join(
    f"(CASE WHEN r >= lo + {i} * ((hi - lo) / 50.0) THEN 1 ELSE 0 END)" for i in range(1, 50)
)


@query(
    "residual_histogram",
    "bin:i bin_lo:f4 n:i",
    f"""WITH {_PRED_SQL}, lim AS (SELECT min(r) AS lo, max(r) AS hi FROM pred),
b AS (SELECT {_RBIN} AS bin, count(*) AS n FROM pred, lim GROUP BY 1)
SELECT g.bin, lo + g.bin * ((hi - lo) / 50.0) AS bin_lo, coalesce(n, 0) AS n
FROM (SELECT unnest(generate_series(0, 49)) AS bin) AS g CROSS JOIN lim LEFT JOIN b ON b.bin = g.bin""",
)
def _(spark, sf):
    return M.residual_histogram(_pred(spark, sf), _Y, _P)


_PROBS = [i / 100 for i in range(1, 100)]


@query(
    "qq_points",
    "point:i normal_quantile:f6 residual_quantile:f4",
    f"""WITH {_PRED_SQL}
SELECT unnest(range(1, 100)) AS point, unnest([{", ".join(repr(NormalDist().inv_cdf(p)) for p in _PROBS)}])
  AS normal_quantile, unnest([{", ".join(f"quantile_cont(r, {p})" for p in _PROBS)}]) AS residual_quantile
FROM pred""",
)
def _(spark, sf):
    return M.qq_points(_pred(spark, sf), _Y, _P)


@query(
    "importance_topn",
    "feature:s importance:f1",
    """SELECT 's' || l_suppkey AS feature, sum(l_quantity - 25.5) AS importance FROM lineitem
GROUP BY l_suppkey ORDER BY abs(importance) DESC, feature LIMIT 20""",
)
def _(spark, sf):
    weights = (
        lineitem(spark, sf)
        .groupBy(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("feature"))
        .agg(F.sum(F.col("l_quantity") - 25.5).alias("importance"))
    )
    return M.top_importance(weights, 20)


# ------------------------------------------------------------------------------------------- models


def _training_rows(spark, sf):
    return prepare_data(obs_dense(spark, sf), SERIES, OBS_FEATURES, TRAINING, None, ALL_FEATURES)


def _predictions(spark, sf, kind, **params):
    trained = train_model(
        _training_rows(spark, sf), kind, OBS_FEATURES.target, ALL_FEATURES, **params
    )
    return trained.predictions


@query(
    "ridge_coefficients",
    "slope:f6 intercept:f4",
    """SELECT sxy / (sxx + 1000.0) AS slope, my - sxy / (sxx + 1000.0) * mx AS intercept FROM (
  SELECT regr_sxy(l_extendedprice, l_quantity) AS sxy, regr_sxx(l_extendedprice, l_quantity) AS sxx,
         avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem)""",
)
def _(spark, sf):
    model = fit_model("ridge", lineitem(spark, sf), ["l_quantity"], _Y, alpha=1000.0)
    slope = feature_importance(spark, model, signed=True)
    return slope.select(
        F.col("importance").alias("slope"), F.lit(float(model.stages[1].intercept)).alias("intercept")
    )


# Two features and a penalty that isn't negligible: the normal equations of centred columns.
_TWO_SQL = """sums AS (SELECT regr_sxx(l_extendedprice, l_quantity) + 1000.0 AS a, regr_sxx(l_extendedprice, l_tax) + 1000.0 AS d,
    regr_sxy(l_tax, l_quantity) AS b, regr_sxy(l_extendedprice, l_quantity) AS u, regr_sxy(l_extendedprice, l_tax) AS v,
    avg(l_quantity) AS mq, avg(l_tax) AS mt, avg(l_extendedprice) AS my FROM lineitem),
fitted AS (SELECT (d * u - b * v) / (a * d - b * b) AS q, (a * v - b * u) / (a * d - b * b) AS t, mq, mt, my FROM sums)"""


def _two_feature_model(spark, sf):
    return fit_model("ridge", lineitem(spark, sf), ["l_quantity", "l_tax"], _Y, alpha=1000.0)


@query(
    "ridge_predict_two",
    "l_orderkey:i l_linenumber:i prediction:f2",
    f"""WITH {_TWO_SQL}
SELECT l_orderkey, l_linenumber, my + q * (l_quantity - mq) + t * (l_tax - mt) AS prediction FROM lineitem, fitted""",
)
def _(spark, sf):
    return _two_feature_model(spark, sf).transform(lineitem(spark, sf))


@query(
    "importance_of_model",
    "feature:s importance:f4",
    f"WITH {_TWO_SQL} SELECT 'l_quantity' AS feature, abs(q) AS importance FROM fitted UNION ALL SELECT 'l_tax', abs(t) FROM fitted",
)
def _(spark, sf):
    return M.top_importance(feature_importance(spark, _two_feature_model(spark, sf)), 20)


@query("ridge_predict", "event_type:s hour:t split:s target:f6 prediction:f6")
def _(spark, sf):
    return _predictions(spark, sf, "ridge")


@query("rf_predict", "event_type:s hour:t split:s target:f6 prediction:f6")
def _(spark, sf):
    return _predictions(spark, sf, "random_forest")


@query("gbt_predict", "event_type:s hour:t split:s target:f6 prediction:f6")
def _(spark, sf):
    return _predictions(spark, sf, "gradient_boosting")


@query("split_metrics", "split:s n_samples:i rmse:f6 mae:f6 r2:f6 mape:f6")
def _(spark, sf):
    return train_model(
        _training_rows(spark, sf), "ridge", OBS_FEATURES.target, ALL_FEATURES
    ).metrics


@query("score_period", "n_samples:i rmse:f6 mae:f6 r2:f6 mape:f6")
def _(spark, sf):
    train = _training_rows(spark, sf).where(F.col("split") == "train")
    model = fit_model("ridge", train, ALL_FEATURES, OBS_FEATURES.target)
    recent = obs_dense(spark, sf).where(F.col("hour") >= F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00")))
    return score_period(model, recent, SERIES, OBS_FEATURES, None)[1]


# ----------------------------------------------------------------------------------------- registry


def _versions(spark, sf):
    """(versions, run metrics): a model per supplier, a version per quarter."""
    quarter = (F.year("l_shipdate") - 1995) * 4 + F.quarter("l_shipdate")
    tagged = _pred(spark, sf).select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("model_name"),
        quarter.cast("long").alias("version"),
        _Y,
        _P,
    )
    scored = M.regression_metrics(tagged, _Y, _P, ["rmse", "mae", "r2"], ["model_name", "version"])
    run = F.concat("model_name", F.lit("-v"), F.col("version").cast("string"))
    named = scored.select(
        "model_name",
        "version",
        run.alias("run_id"),
        *[F.col(m).alias(f"test_{m}") for m in ("rmse", "mae", "r2")],
    )
    slot = F.col("version") % 7
    stage = (
        F.when(slot == 0, "Production").when(slot == 1, "Staging").when(slot <= 3, "Archived")
        .otherwise("None")
    )
    metrics = named.unpivot(["run_id"], ["test_rmse", "test_mae", "test_r2"], "key", "value")
    versions = named.select("model_name", "version", stage.alias("stage"), "run_id")
    return versions, metrics.where(F.col("value").isNotNull())


_VERSIONS_SQL = f"""{_PRED_SQL},
g AS (SELECT 's' || l_suppkey AS model_name, (year(l_shipdate) - 1995) * 4 + quarter(l_shipdate) AS version,
        y, r FROM pred),
v AS (
  SELECT *, model_name || '-v' || version AS run_id,
    CASE version % 7 WHEN 0 THEN 'Production' WHEN 1 THEN 'Staging' WHEN 2 THEN 'Archived'
      WHEN 3 THEN 'Archived' ELSE 'None' END AS stage
  FROM (SELECT model_name, version, {_METRICS_SQL} FROM g GROUP BY ALL)),
newest AS (
  SELECT model_name, stage, max(version) AS version, arg_max(run_id, version) AS run_id
  FROM v GROUP BY model_name, stage)"""


@query(
    "latest_by_stage",
    "model_name:s stage:s version:i run_id:s",
    f"WITH {_VERSIONS_SQL} SELECT * FROM newest",
)
def _(spark, sf):
    return R.latest_by_stage(_versions(spark, sf)[0])


@query(
    "model_info",
    "model_name:s version:i stage:s run_id:s test_rmse:f4 test_r2:f6",
    f"WITH {_VERSIONS_SQL} SELECT *, rmse AS test_rmse, r2 AS test_r2 FROM v",
)
def _(spark, sf):
    info = R.model_info(*_versions(spark, sf))
    m = F.col("metrics")
    return info.select("*", m["test_rmse"].alias("test_rmse"), m["test_r2"].alias("test_r2"))


@query(
    "list_models",
    "model_name:s n_versions:i production:i staging:i",
    f"""WITH {_VERSIONS_SQL}
SELECT model_name, count(*) AS n_versions,
  coalesce(max(version) FILTER (WHERE stage = 'Production'), 0) AS production,
  coalesce(max(version) FILTER (WHERE stage = 'Staging'), 0) AS staging
FROM newest GROUP BY model_name""",
)
def _(spark, sf):
    listed = R.list_models(_versions(spark, sf)[0])
    held = F.col("latest_versions")
    return listed.select(
        "*",
        F.coalesce(held["Production"], F.lit(0)).alias("production"),
        F.coalesce(held["Staging"], F.lit(0)).alias("staging"),
    )


@query(
    "compare_versions",
    "model_name:s key:s value_a:f4 value_b:f4 difference:f4 better_version:i",
    f"""WITH {_VERSIONS_SQL},
k AS (
  SELECT model_name, version, 'test_rmse' AS key, rmse AS value FROM v
  UNION ALL SELECT model_name, version, 'test_mae', mae FROM v
  UNION ALL SELECT model_name, version, 'test_r2', r2 FROM v WHERE r2 IS NOT NULL)
SELECT a.model_name, a.key, a.value AS value_a, b.value AS value_b, b.value - a.value AS difference,
  CASE WHEN a.key = 'test_r2' THEN CASE WHEN b.value > a.value THEN 14 ELSE 7 END
       ELSE CASE WHEN b.value < a.value THEN 14 ELSE 7 END END AS better_version
FROM k a JOIN k b ON a.model_name = b.model_name AND a.key = b.key AND a.version = 7 AND b.version = 14""",
)
def _(spark, sf):
    return R.compare_versions(*_versions(spark, sf), 7, 14)


@query(
    "register_gate",
    "run_id:s rmse:f4 r2:f6 meets_threshold:b",
    f"""WITH {_VERSIONS_SQL}
SELECT run_id, rmse, r2, rmse <= 30000 AND coalesce(r2, 0) >= -1 AS meets_threshold FROM v""",
)
def _(spark, sf):
    _, metrics = _versions(spark, sf)
    wide = metrics.groupBy("run_id").pivot("key", ["test_rmse", "test_r2"]).agg(F.max("value"))
    named = wide.withColumnsRenamed({"test_rmse": "rmse", "test_r2": "r2"})
    return R.register_gate(named, TrainingConfig(max_rmse=30000.0, min_r2=-1.0))


@query(
    "compare_production",
    "model_name:s run_id:s new_rmse:f4 production_rmse:f4 is_better:b reason:s",
    f"""WITH {_VERSIONS_SQL},
last AS (SELECT model_name, arg_max(run_id, version) AS run_id, arg_max(rmse, version) AS new_rmse
         FROM v GROUP BY model_name),
prod AS (SELECT n.model_name, v.rmse AS production_rmse FROM newest n JOIN v ON v.run_id = n.run_id
         WHERE n.stage = 'Production')
SELECT last.*, production_rmse,
  CASE WHEN production_rmse IS NULL THEN TRUE ELSE new_rmse < production_rmse END AS is_better,
  CASE WHEN production_rmse IS NULL THEN 'no production model' ELSE 'compared' END AS reason
FROM last LEFT JOIN prod ON prod.model_name = last.model_name""",
)
def _(spark, sf):
    versions, metrics = _versions(spark, sf)
    candidates = versions.groupBy("model_name").agg(F.max_by("run_id", "version").alias("run_id"))
    return R.compare_production(candidates, versions, metrics)


@query(
    "promote_model",
    "model_name:s version:i stage:s",
    f"""WITH {_VERSIONS_SQL},
best AS (SELECT model_name, max(version) AS best FROM v WHERE stage = 'Staging' GROUP BY model_name)
SELECT v.model_name, version, CASE WHEN version = best THEN 'Production'
  WHEN best IS NOT NULL AND stage = 'Production' THEN 'Archived' ELSE stage END AS stage
FROM v LEFT JOIN best ON best.model_name = v.model_name""",
)
def _(spark, sf):
    versions, _ = _versions(spark, sf)
    newest = R.latest_by_stage(versions).where(F.col("stage") == "Staging")
    return R.promote_model(versions, newest, "Production")
