"""Views over the driver's tables that stand for the library's inputs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdrift.config import ColumnSpec, FeatureConfig, QualityConfig
from sparkdrift.operators.distribution import TwoSample
from sparkdrift.operators.windows import Series, densify_hourly
from sparkdrift.sources.files import shared_folder

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CUT = "1998-07-01 00:00:00"
EVENT_CUT = "2024-01-16 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at(text: str) -> Column:
    """Zone-less timestamp literal."""
    return F.to_timestamp_ntz(F.lit(text))


def shared_dir(spark: SparkSession) -> str:
    """A fresh directory in the folder the cluster shares."""
    return shared_folder(spark, "contract")


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def is_ref() -> Column:
    return F.col("l_shipdate") < at(CUT)


def li_sample(spark: SparkSession, sf_dir: str, features=FEATURES) -> TwoSample:
    return TwoSample.split(lineitem(spark, sf_dir), features, is_ref())


def shift_sample(spark: SparkSession, sf_dir: str) -> TwoSample:
    return TwoSample.split(li_shift(spark, sf_dir), FEATURES, is_ref())


def li_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current side keeps only dear items: a severe shift of one feature."""
    return lineitem(spark, sf_dir).where(is_ref() | (F.col("l_extendedprice") > 40000))


def reference_side(df: DataFrame) -> DataFrame:
    return df.where(is_ref())


def current_side(df: DataFrame) -> DataFrame:
    return df.where(~is_ref())


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly observations per event type; hours without events are missing."""
    return (
        events(spark, sf_dir)
        .groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))
        .agg(
            F.avg("value").alias("avg_value"),
            F.max("value").alias("max_value"),
            F.count(F.lit(1)).alias("n_events"),
        )
    )


SERIES = Series(("event_type",), "hour")
MEASURES = ["avg_value", "max_value", "n_events"]


def obs_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on a complete hourly grid, NULL where nothing happened."""
    return densify_hourly(obs(spark, sf_dir), SERIES, MEASURES)


OBS_QUALITY = QualityConfig(
    specs=(
        ColumnSpec("avg_value", 5.0, 100.0),
        ColumnSpec("max_value", 10.0, 250.0),
        ColumnSpec("n_events", 2.0, 40.0),
    ),
    time_column="hour",
)
LI_QUALITY = QualityConfig(
    specs=(
        ColumnSpec("l_quantity", 1.0, 45.0),
        ColumnSpec("l_extendedprice", 1000.0, 90000.0),
        ColumnSpec("l_discount", 0.0, 0.09),
        ColumnSpec("l_tax", 0.01, 0.07),
    ),
    time_column="l_shipdate",
)
OBS_FEATURES = FeatureConfig(
    measures=tuple(MEASURES),
    lag_columns=("avg_value", "max_value"),
    rolling_columns=("max_value",),
    target_source="max_value",
    target="target",
    excluded=(*FeatureConfig().excluded, "event_type", "hour"),
)

# ---------------------------------------------------------------------------------------------- SQL

IS_REF_SQL = f"l_shipdate < TIMESTAMP '{CUT}'"
SHIFT_SQL = f"(SELECT * FROM lineitem WHERE {IS_REF_SQL} OR l_extendedprice > 40000)"


def long_sql(source: str, ref: str, features=FEATURES, extra: str = "") -> str:
    """Long frame: feature, is_ref, value."""
    return "\n  UNION ALL ".join(
        f"SELECT '{f}' AS feature, ({ref}) AS is_ref, CAST({f} AS DOUBLE) AS value{extra} FROM {source}"
        for f in features
    )


LI_LONG_SQL = long_sql("lineitem", IS_REF_SQL)
SHIFT_LONG_SQL = long_sql(SHIFT_SQL, IS_REF_SQL)
LIMITS_SQL = """
  SELECT feature, min(value) AS lo, max(value) AS hi,
         count(*) FILTER (WHERE is_ref) AS ref_n, count(*) FILTER (WHERE NOT is_ref) AS cur_n
  FROM long GROUP BY feature"""


def bin_sql(bins: int = 10, value: str = "value", lo: str = "lo", hi: str = "hi") -> str:
    """Number of inner edges at or below the value."""
    edges = " + ".join(
        f"(CASE WHEN {value} >= {lo} + {i} * (({hi} - {lo}) / {float(bins)}) THEN 1 ELSE 0 END)"
        for i in range(1, bins)
    )
    return f"(CASE WHEN {lo} = {hi} THEN 0 ELSE {edges} END)"


HIST_SQL = f"""
  SELECT feature, {bin_sql()} AS bin, ref_n, cur_n,
         count(*) FILTER (WHERE is_ref) AS n_ref, count(*) FILTER (WHERE NOT is_ref) AS n_cur
  FROM long JOIN lim USING (feature) GROUP BY ALL"""
PSI_TERM_SQL = """(greatest(q, 1e-10) - greatest(p, 1e-10)) * ln(greatest(q, 1e-10) / greatest(p, 1e-10))"""


def js_sql(bins: int = 10) -> str:
    p, q = (f"(({x} + 1e-10) / (1 + {bins} * 1e-10))" for x in ("p", "q"))
    return f"({p} * log2({p} / (({p} + {q}) / 2)) + {q} * log2({q} / (({p} + {q}) / 2))) / 2"


SHARES_SQL = """
  SELECT feature, bin, n_ref / CAST(ref_n AS DOUBLE) AS p, n_cur / CAST(cur_n AS DOUBLE) AS q
  FROM hist"""
CDF_SQL = """
  SELECT feature, value, ref_n, cur_n,
         sum(n_ref) OVER w AS cum_ref, sum(n_cur) OVER w AS cum_cur,
         lead(value) OVER (PARTITION BY feature ORDER BY value) AS next_value
  FROM (SELECT feature, value, count(*) FILTER (WHERE is_ref) AS n_ref,
               count(*) FILTER (WHERE NOT is_ref) AS n_cur FROM long GROUP BY feature, value)
  JOIN lim USING (feature)
  WINDOW w AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING)"""
GAP_SQL = "abs(cum_ref / CAST(ref_n AS DOUBLE) - cum_cur / CAST(cur_n AS DOUBLE))"
CDF_TESTS_SQL = f"""
  SELECT feature, max({GAP_SQL}) AS ks_statistic,
         sum({GAP_SQL} * coalesce(next_value - value, 0)) AS wasserstein,
         any_value(ref_n) AS ref_n, any_value(cur_n) AS cur_n
  FROM cdf GROUP BY feature"""


def ks_p_sql(stat: str = "ks_statistic", n: str = "ref_n", m: str = "cur_n") -> str:
    """Large-sample p-value; the alternating series converges for every statistic checked here."""
    size = f"greatest(round(CAST({n} AS DOUBLE) * {m} / ({n} + {m})), 1.0)"
    lam = f"(sqrt({size}) * {stat} + 1 / (6 * sqrt({size})) + (sqrt({size}) * {stat} - 1) / (4 * {size}))"
    series = (
        f"(SELECT 2 * sum((CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * k * k * lam * lam))"
        f" FROM (SELECT unnest(generate_series(1, 100)) AS k, {lam} AS lam))"
    )
    return f"CASE WHEN {stat} <= 0 THEN 1.0 ELSE least(1.0, greatest(0.0, {series})) END"


def two_sample_sql(long: str) -> str:
    """Common table expressions up to shares and CDF tests."""
    return f"""long AS ({long}),
lim AS ({LIMITS_SQL}),
hist AS ({HIST_SQL}),
shares AS ({SHARES_SQL}),
hist_tests AS (
  SELECT feature, sum({PSI_TERM_SQL}) AS psi, greatest(sum({js_sql()}), 0) AS js_divergence
  FROM shares GROUP BY feature),
cdf AS ({CDF_SQL}),
cdf_tests AS ({CDF_TESTS_SQL})"""


OBS_SQL = """
  SELECT event_type, date_trunc('hour', ts) AS hour, avg(value) AS avg_value,
         max(value) AS max_value, count(*) AS n_events
  FROM events GROUP BY 1, 2"""
DENSE_SQL = f"""obs AS ({OBS_SQL}),
grid AS (
  SELECT event_type, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour
  FROM obs GROUP BY event_type),
dense AS (
  SELECT grid.event_type, grid.hour, avg_value, max_value, n_events
  FROM grid LEFT JOIN obs ON obs.event_type = grid.event_type AND obs.hour = grid.hour)"""
