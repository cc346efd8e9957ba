"""Quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract.registry import query
from contract.views import (
    DENSE_SQL,
    LI_QUALITY,
    OBS_QUALITY,
    events,
    lineitem,
    obs_dense,
)
from sparkdrift.config import ColumnSpec, QualityConfig
from sparkdrift.operators import quality as Q
from sparkdrift.plans.ingest import recheck_quality, validate_batches

EVENT_QUALITY = QualityConfig(specs=(ColumnSpec("value", 1.0, 200.0),), time_column="ts")


def _stack(template: str, config: QualityConfig) -> str:
    return "\nUNION ALL ".join(
        template.format(c=s.name, lo=s.lower, hi=s.upper) for s in config.specs
    )


@query(
    "range_check",
    "column:s min:f6 max:f6 expected_min:f6 expected_max:f6 below_min_count:i above_max_count:i "
    "out_of_range_count:i",
    _stack(
        """SELECT '{c}' AS "column", min({c}) AS min, max({c}) AS max, {lo} AS expected_min,
  {hi} AS expected_max, count(*) FILTER (WHERE {c} < {lo}) AS below_min_count,
  count(*) FILTER (WHERE {c} > {hi}) AS above_max_count,
  count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) AS out_of_range_count FROM lineitem""",
        LI_QUALITY,
    ),
)
def _(spark, sf):
    return Q.range_check(lineitem(spark, sf), LI_QUALITY)


@query(
    "null_analysis",
    "column:s null_count:i null_percentage:f2 is_issue:b",
    f"WITH {DENSE_SQL} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS null_count,
  100.0 * (count(*) - count({c})) / count(*) AS null_percentage,
  100.0 * (count(*) - count({c})) / count(*) > 5 AS is_issue FROM dense"""
        for c in ("event_type", "hour", "avg_value", "max_value", "n_events")
    ),
)
def _(spark, sf):
    return Q.null_analysis(obs_dense(spark, sf), OBS_QUALITY)


_GAPS = """SELECT {keys} count(d) AS total_intervals, count(*) FILTER (WHERE d > 2) AS gaps_found,
  max(d) AS max_gap_hours FROM (
  SELECT {keys} epoch_us({t} - lag({t}) OVER (PARTITION BY {part} ORDER BY {t})) / 3600000000.0 AS d
  FROM {table}) {group}"""


@query(
    "gap_check",
    "scope:s checked:b total_intervals:i gaps_found:i max_gap_hours:f6",
    f"""SELECT 'lineitem' AS scope, total_intervals > 0 AS checked, * FROM (
  {_GAPS.format(keys="", t="l_shipdate", part="1", table="lineitem", group="")})
UNION ALL
SELECT event_type, total_intervals > 0, total_intervals, gaps_found, max_gap_hours FROM (
  {_GAPS.format(keys="event_type,", t="ts", part="event_type", table="events", group="GROUP BY event_type")})""",
)
def _(spark, sf):
    whole = Q.gap_check(lineitem(spark, sf), LI_QUALITY).withColumn("scope", F.lit("lineitem"))
    per_type = Q.gap_check(events(spark, sf), EVENT_QUALITY, keys=["event_type"])
    return whole.unionByName(per_type.withColumnRenamed("event_type", "scope"))


_FENCES = """SELECT '{c}' AS feature, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper,
  (SELECT count({c}) FROM {table}) AS n_values,
  (SELECT count(*) FROM {table} WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))
    AS outliers
FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {table})"""


@query(
    "iqr_outliers",
    "feature:s lower:f5 upper:f5 n_values:i outliers:i",
    "\nUNION ALL ".join(_FENCES.format(c=s.name, table="lineitem") for s in LI_QUALITY.specs)
    + "\nUNION ALL "
    + _FENCES.format(c="value", table="events"),
)
def _(spark, sf):
    return Q.iqr_outliers(lineitem(spark, sf), LI_QUALITY).unionByName(
        Q.iqr_outliers(events(spark, sf), EVENT_QUALITY)
    )


@query(
    "outlier_rows",
    "outlier_rows:i",
    """SELECT count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))
  AS outlier_rows FROM events,
  (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)""",
)
def _(spark, sf):
    return Q.outlier_rows(events(spark, sf), EVENT_QUALITY)


def _score_sql(table: str, config: QualityConfig, keys: str, gaps: str) -> str:
    """Completeness, validity, consistency and score per key."""
    n = len(config.specs)
    complete = " + ".join(f"count({s.name}) / CAST(count(*) AS DOUBLE)" for s in config.specs)
    shares = ", ".join(
        f"count(*) FILTER (WHERE {s.name} BETWEEN {s.lower} AND {s.upper})"
        f" / CAST(nullif(count({s.name}), 0) AS DOUBLE)"
        for s in config.specs
    )
    valid = " AND ".join(
        f"NOT coalesce({s.name} < {s.lower} OR {s.name} > {s.upper}, FALSE)" for s in config.specs
    )
    return f"""parts AS (
  SELECT {keys} AS k, count(*) AS total_records, ({complete}) / {n} AS completeness,
         list_avg([{shares}]) AS validity, count(*) FILTER (WHERE {valid}) AS valid_records
  FROM {table} GROUP BY 1),
gaps AS ({gaps}),
score AS (
  SELECT parts.*, gaps_found, max_gap_hours, total_intervals,
         CASE WHEN total_intervals > 0
              THEN greatest(0.0, 1 - gaps_found / CAST(total_intervals AS DOUBLE)) ELSE 1.0 END AS consistency
  FROM parts JOIN gaps ON parts.k = gaps.k),
graded AS (
  SELECT *, round(0.4 * completeness + 0.4 * validity + 0.2 * consistency, 4) AS quality_score FROM score)"""


_EVENT_GAPS = (
    "SELECT event_type AS k, * FROM ("
    + _GAPS.format(
        keys="event_type,", t="ts", part="event_type", table="events", group="GROUP BY event_type"
    )
    + ")"
)


@query(
    "quality_score",
    "event_type:s completeness:f6 validity:f6 consistency:f6 quality_score:f4",
    f"""WITH {_score_sql("events", EVENT_QUALITY, "event_type", _EVENT_GAPS)}
SELECT k AS event_type, * FROM graded""",
)
def _(spark, sf):
    return Q.quality_score(events(spark, sf), EVENT_QUALITY, keys=["event_type"])


_LI_GAPS = (
    "SELECT 1 AS k, * FROM ("
    + _GAPS.format(keys="", t="l_shipdate", part="1", table="lineitem", group="")
    + ")"
)
_LI_OUTLIERS = " + ".join(
    f"(SELECT outliers FROM ({_FENCES.format(c=s.name, table='lineitem')}))" for s in LI_QUALITY.specs
)
_LI_ISSUE_LIST = [
    f"""CASE WHEN (SELECT count(*) FROM lineitem WHERE {s.name} < {s.lower} OR {s.name} > {s.upper}) > 0
   THEN printf('{s.name}: %d values (%.1f%%) out of range [{s.lower}, {s.upper}]',
     (SELECT count(*) FROM lineitem WHERE {s.name} < {s.lower} OR {s.name} > {s.upper}),
     (SELECT count(*) FROM lineitem WHERE {s.name} < {s.lower} OR {s.name} > {s.upper}) * 100.0
       / total_records) END"""
    for s in LI_QUALITY.specs
]
_LI_ISSUES = ", ".join(_LI_ISSUE_LIST)


@query(
    "validation_summary",
    "is_valid:b quality_score:f4 total_records:i valid_records:i anomaly_count:i completeness:f6 "
    "validity:f6 consistency:f6 gaps_found:i max_gap_hours:f4 issues:s",
    f"""WITH {_score_sql("lineitem", LI_QUALITY, "1", _LI_GAPS)}
SELECT *, quality_score >= 0.8 AS is_valid, {_LI_OUTLIERS} AS anomaly_count,
  concat_ws(' | ', {_LI_ISSUES}, CASE WHEN gaps_found > 0 THEN
    printf('Found %d time gaps > 2.0 hours (max gap: %.1f hours)', gaps_found, max_gap_hours) END) AS issues
FROM graded""",
)
def _(spark, sf):
    result = Q.validate(lineitem(spark, sf), LI_QUALITY)
    return result.select(
        "*", F.array_join("issues", " | ").alias("issue_text"), "temporal_details.*"
    ).drop("issues").withColumnRenamed("issue_text", "issues")


@query(
    "validation_report",
    "report:s",
    f"""WITH {_score_sql("lineitem", LI_QUALITY, "1", _LI_GAPS)},
v AS (SELECT *, {_LI_OUTLIERS} AS anomaly_count,
  nullif(concat_ws(chr(10), {", ".join(f"'  • ' || {issue}" for issue in _LI_ISSUE_LIST)},
    CASE WHEN gaps_found > 0 THEN
    printf('  • Found %d time gaps > 2.0 hours (max gap: %.1f hours)', gaps_found, max_gap_hours) END), '') AS issues
FROM graded)
SELECT concat_ws(chr(10), repeat('=', 60), 'DATA VALIDATION REPORT', repeat('=', 60), '',
  'Status: ' || CASE WHEN quality_score >= 0.8 THEN '✓ VALID' ELSE '✗ INVALID' END,
  printf('Quality Score: %.2f%%', quality_score * 100), format('Total Records: {{:,}}', total_records),
  format('Valid Records: {{:,}}', valid_records), format('Anomalies Detected: {{:,}}', anomaly_count), '',
  'Issues Found:' || chr(10) || issues || chr(10), 'Quality Score Breakdown:',
  printf('  • Completeness: %.2f%%', completeness * 100), printf('  • Validity: %.2f%%', validity * 100),
  printf('  • Consistency: %.2f%%', consistency * 100), '', repeat('=', 60)) AS report FROM v""",
)
def _(spark, sf):
    return Q.validation_report(Q.validate(lineitem(spark, sf), LI_QUALITY))


@query(
    "zscore_flags",
    "event_id:i value_anomaly:b is_anomaly:b",
    """SELECT event_id, abs(value - m) / s > 3 AS value_anomaly, abs(value - m) / s > 3 AS is_anomaly
FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)""",
)
def _(spark, sf):
    return Q.flag_anomalies(events(spark, sf), EVENT_QUALITY)


@query(
    "zscore_flags_per_type",
    "event_id:i is_anomaly:b",
    """SELECT event_id, abs(value - m) / s > 3 AS is_anomaly
FROM events JOIN (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1)
  USING (event_type)""",
)
def _(spark, sf):
    return Q.flag_anomalies(events(spark, sf), EVENT_QUALITY, ["event_type"])


@query(
    "column_stats",
    "column:s mean:f5 std:f5 min:f6 max:f6 null_count:i record_count:i",
    "\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min,
  max({c}) AS max, count(*) - count({c}) AS null_count, count(*) AS record_count FROM lineitem"""
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    ),
)
def _(spark, sf):
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return Q.column_stats(lineitem(spark, sf), names)


@query(
    "dataset_summary",
    "record_count:i start:t end:t locations:i",
    """SELECT count(*) AS record_count, min(ts) AS start, max(ts) AS "end",
  count(DISTINCT event_type) AS locations FROM events""",
)
def _(spark, sf):
    return Q.dataset_summary(events(spark, sf), "ts", "event_type")


_DAY_GAPS = (
    "SELECT dy AS k, * FROM ("
    + _GAPS.format(
        keys="dy,",
        t="ts",
        part="dy",
        table="(SELECT *, strftime(ts, '%Y-%m-%d') AS dy FROM events)",
        group="GROUP BY dy",
    )
    + ")"
)


@query(
    "backfill_quality",
    "batch:s is_valid:b quality_score:f4 total_records:i valid_records:i anomaly_count:i",
    f"""WITH daily AS (SELECT *, strftime(ts, '%Y-%m-%d') AS dy FROM events),
{_score_sql("daily", EVENT_QUALITY, "dy", _DAY_GAPS)},
f AS (SELECT dy, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM daily GROUP BY dy),
o AS (SELECT dy, count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))
        AS anomaly_count FROM daily JOIN f USING (dy) GROUP BY dy)
SELECT k AS batch, quality_score >= 0.8 AS is_valid, * FROM graded JOIN o ON o.dy = graded.k""",
)
def _(spark, sf):
    batched = events(spark, sf).withColumn("batch", F.date_format("ts", "yyyy-MM-dd"))
    return validate_batches(batched, "batch", EVENT_QUALITY)


_STORED_SPECS = (
    ColumnSpec("temperature", 1.0, 45.0),
    ColumnSpec("humidity", 0.0, 0.09),
    ColumnSpec("pressure", 1000.0, 90000.0),
)


@query(
    "recheck_quality",
    "is_valid:b quality_score:f4 total_records:i valid_records:i",
    f"""WITH stored AS (
  SELECT l_shipdate AS timestamp, l_quantity AS temperature, l_discount AS humidity,
         l_extendedprice AS pressure FROM lineitem),
{_score_sql("stored", QualityConfig(specs=_STORED_SPECS), "1", _LI_GAPS)}
SELECT *, quality_score >= 0.8 AS is_valid FROM graded""",
)
def _(spark, sf):
    stored = lineitem(spark, sf).select(
        F.col("l_shipdate").alias("timestamp"),
        F.col("l_quantity").alias("temperature_2m"),
        F.col("l_discount").cast("decimal(5,2)").alias("relative_humidity_2m"),
        F.col("l_extendedprice").alias("surface_pressure"),
    )
    return recheck_quality(stored, QualityConfig(specs=_STORED_SPECS))
