"""Drift statistics, profiles, reports and history."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract.registry import query
from contract.views import (
    EVENT_CUT,
    FEATURES,
    LI_LONG_SQL,
    SHIFT_LONG_SQL,
    SHIFT_SQL,
    at,
    bin_sql,
    current_side,
    events,
    is_ref,
    js_sql,
    ks_p_sql,
    li_sample,
    li_shift,
    lineitem,
    long_sql,
    reference_side,
    shared_dir,
    shift_sample,
    two_sample_sql,
)
from contract.views import IS_REF_SQL, PSI_TERM_SQL
from sparkdrift.config import DriftConfig
from sparkdrift.operators import detect as D
from sparkdrift.operators import drift as T
from sparkdrift.operators import history as H
from sparkdrift.operators.distribution import TwoSample, aligned_histogram, to_long
from sparkdrift.operators.reference import (
    create_profile,
    profile_bins,
    profile_only_tests,
    reference_values,
)
from sparkdrift.sources.references import ReferenceStore, newest_first, reference_metadata
from sparkdrift.sources.runs import report_json
from sparkdrift.streaming.jobs import stored_bin, window_psi

NOW = "2002-01-01T00:00:00"
LI_TESTS_SQL = two_sample_sql(LI_LONG_SQL)
SHIFT_TESTS_SQL = two_sample_sql(SHIFT_LONG_SQL)


@query("psi", "feature:s psi:f6", f"WITH {LI_TESTS_SQL} SELECT feature, psi FROM hist_tests")
def _(spark, sf):
    return T.psi(li_sample(spark, sf))


@query(
    "psi_shifted", "feature:s psi:f6", f"WITH {SHIFT_TESTS_SQL} SELECT feature, psi FROM hist_tests"
)
def _(spark, sf):
    return T.psi(shift_sample(spark, sf))


@query(
    "js_divergence",
    "feature:s js_divergence:f8",
    f"WITH {LI_TESTS_SQL} SELECT feature, js_divergence FROM hist_tests",
)
def _(spark, sf):
    return T.jensen_shannon(li_sample(spark, sf))


@query(
    "ks_test",
    "feature:s ks_statistic:f8 ks_p_value:f6",
    f"WITH {LI_TESTS_SQL} SELECT feature, ks_statistic, {ks_p_sql()} AS ks_p_value FROM cdf_tests",
)
def _(spark, sf):
    return T.ks_test(li_sample(spark, sf))


@query(
    "wasserstein",
    "feature:s wasserstein:f5",
    f"WITH {LI_TESTS_SQL} SELECT feature, wasserstein FROM cdf_tests",
)
def _(spark, sf):
    return T.wasserstein(li_sample(spark, sf))


@query(
    "aligned_histogram",
    "feature:s bin:i bin_lo:f6 bin_hi:f6 n_ref:i n_cur:i",
    f"""WITH {LI_TESTS_SQL}
SELECT lim.feature, g.bin, lo + g.bin * ((hi - lo) / 10.0) AS bin_lo,
       CASE WHEN g.bin = 9 THEN hi ELSE lo + (g.bin + 1) * ((hi - lo) / 10.0) END AS bin_hi,
       coalesce(n_ref, 0) AS n_ref, coalesce(n_cur, 0) AS n_cur
FROM lim CROSS JOIN (SELECT unnest(generate_series(0, 9)) AS bin) AS g
LEFT JOIN hist ON hist.feature = lim.feature AND hist.bin = g.bin""",
)
def _(spark, sf):
    sample = li_sample(spark, sf)
    return aligned_histogram(sample.long(), limits=sample.limits())


def _chi2_sql(cells: str, long: str = LI_LONG_SQL) -> str:
    """Statistic and p-value; the tail is a finite sum for the odd numbers of cells used here."""
    return f"""WITH long AS ({long}), lim AS (
  SELECT feature, min(value) AS lo, max(value) AS hi, count(*) FILTER (WHERE is_ref) AS r,
         count(*) FILTER (WHERE NOT is_ref) AS c FROM long GROUP BY feature),
cells AS ({cells}),
k AS (SELECT feature, count(*) AS n_cells FROM cells GROUP BY feature),
e AS (
  SELECT feature, n_cells, o_r, o_c, (o_r + o_c) * CAST(r AS DOUBLE) / (r + c) AS e_r,
         (o_r + o_c) * CAST(c AS DOUBLE) / (r + c) AS e_c
  FROM cells JOIN lim USING (feature) JOIN k USING (feature)),
y AS (SELECT *, CASE WHEN n_cells = 2 THEN least(0.5, abs(o_r - e_r)) ELSE 0 END AS fix FROM e),
x AS (
  SELECT feature, any_value(n_cells) AS n_cells,
         sum((abs(o_r - e_r) - fix) ** 2 / e_r + (abs(o_c - e_c) - fix) ** 2 / e_c) AS chi2_statistic
  FROM y GROUP BY feature)
SELECT feature, n_cells, chi2_statistic,
       (SELECT sum(exp(i * ln(x.chi2_statistic / 2) - lgamma(i + 1.0) - x.chi2_statistic / 2))
        FROM (SELECT unnest(range(0, 40)) AS i) AS t WHERE i < (x.n_cells - 1) // 2) AS chi2_p_value
FROM x"""


_BINNED_CELLS_SQL = f"""SELECT feature, {bin_sql(9)} AS cell, count(*) FILTER (WHERE is_ref) AS o_r,
          count(*) FILTER (WHERE NOT is_ref) AS o_c
   FROM long JOIN lim USING (feature) GROUP BY ALL"""


@query(
    "chi_square_cat",
    "feature:s n_cells:i chi2_statistic:f6 chi2_p_value:f6",
    _chi2_sql(
        """SELECT feature, value AS cell, count(*) FILTER (WHERE is_ref) AS o_r,
          count(*) FILTER (WHERE NOT is_ref) AS o_c
   FROM long WHERE feature IN ('l_discount', 'l_tax') GROUP BY feature, value"""
    ),
)
def _(spark, sf):
    return T.chi_square_test(li_sample(spark, sf, ["l_discount", "l_tax"]))


@query(
    "chi_square_binned",
    "feature:s n_cells:i chi2_statistic:f6 chi2_p_value:f6",
    _chi2_sql(_BINNED_CELLS_SQL),
)
def _(spark, sf):
    return T.chi_square_test(li_sample(spark, sf), bins=9)


_TAIL_SQL = """CASE WHEN (n_cells - 1) % 2 = 0 THEN
    (SELECT sum(exp(i * ln(h) - lgamma(i + 1.0) - h)) FROM (SELECT unnest(range(0, 200)) AS i) WHERE i < (n_cells - 1) // 2)
  ELSE 1 - (SELECT sum(exp((i + 0.5) * ln(h) - lgamma(i + 1.5) - h)) FROM (SELECT unnest(range(0, 400)) AS i))
    + (SELECT sum(exp((i - 0.5) * ln(h) - lgamma(i + 0.5) - h)) FROM (SELECT unnest(range(1, 200)) AS i)
       WHERE i <= (n_cells - 2) // 2) END"""
_DEFAULT_CELLS_SQL = f"""SELECT feature, CASE WHEN feature IN ('l_discount', 'l_tax') THEN value ELSE {bin_sql(10)} END AS cell,
          count(*) FILTER (WHERE is_ref) AS o_r, count(*) FILTER (WHERE NOT is_ref) AS o_c
   FROM long JOIN lim USING (feature) GROUP BY ALL"""


# Ten bins have an odd number of degrees, whose tail needs the error function: a series here.
@query(
    "chi_square_default",
    "feature:s n_cells:i chi2_statistic:f6 chi2_p_value:f6 categorical:b",
    f"""SELECT feature, n_cells, chi2_statistic, {_TAIL_SQL} AS chi2_p_value, feature IN ('l_discount', 'l_tax') AS categorical
FROM (SELECT feature, n_cells, chi2_statistic, chi2_statistic / 2 AS h FROM ({_chi2_sql(_DEFAULT_CELLS_SQL)}))""",
)
def _(spark, sf):
    return T.chi_square_test(li_sample(spark, sf))


@query(
    "detect_method",
    "feature:s method:s statistic:f6 threshold:f6 drift_detected:b interpretation:s",
    f"""WITH {SHIFT_TESTS_SQL}
SELECT feature, 'psi' AS method, psi AS statistic, 0.1 AS threshold, psi >= 0.1 AS drift_detected,
       CASE WHEN psi < 0.1 THEN 'No significant shift'
            WHEN psi < 0.2 THEN 'Moderate shift - monitor closely'
            ELSE 'Significant shift - action required' END AS interpretation
FROM hist_tests
UNION ALL
SELECT feature, 'js', js_divergence, 0.1, js_divergence >= 0.1,
       CASE WHEN js_divergence < 0.1 THEN 'Very similar distributions'
            WHEN js_divergence < 0.3 THEN 'Moderate difference'
            ELSE 'Significant difference' END
FROM hist_tests
UNION ALL
SELECT feature, 'ks', ks_statistic, 0.05, {ks_p_sql()} < 0.05,
       CASE WHEN {ks_p_sql()} < 0.05 THEN 'Significant drift detected' ELSE 'No significant drift' END
FROM cdf_tests
UNION ALL
SELECT feature, 'wasserstein', wasserstein, NULL, FALSE,
       'Distribution distance: ' || printf('%.4f', wasserstein) FROM cdf_tests
UNION ALL
SELECT feature, 'chi2', chi2_statistic, 0.05, chi2_p_value < 0.05,
       CASE WHEN chi2_p_value < 0.05 THEN 'Significant drift detected' ELSE 'No significant drift' END
FROM ({_chi2_sql(_BINNED_CELLS_SQL, SHIFT_LONG_SQL)}) AS binned""",
)
def _(spark, sf):
    sample = shift_sample(spark, sf)
    found = T.detect(sample, "chi2", bins=9)
    for method in ("psi", "js", "ks", "wasserstein"):
        found = found.unionByName(T.detect(sample, method))
    return found


# ------------------------------------------------------------------------------------------ profiles

_GRID = [i / 10 for i in range(11)]


def _profile_sql(source: str, where: str = "", features=FEATURES) -> str:
    quantiles = ", ".join(f"quantile_cont(value, {p})" for p in _GRID)
    long = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM {source} {where}" for f in features
    )
    return f"""ref_long AS ({long}),
prof AS (
  SELECT feature, count(*) AS n_samples, avg(value) AS mean, stddev_samp(value) AS std,
         min(value) AS min, max(value) AS max, quantile_cont(value, 0.5) AS median,
         quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.25) AS p25,
         quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.95) AS p95,
         list_sort(list_distinct([{quantiles}])) AS edges
  FROM ref_long GROUP BY feature),
prof_bins AS (
  SELECT feature, bin, edges[bin + 1] AS bin_lo, edges[bin + 2] AS bin_hi
  FROM (SELECT feature, edges, unnest(generate_series(0, len(edges) - 2)) AS bin FROM prof)),
prof_hist AS (
  SELECT b.feature, b.bin, b.bin_lo, b.bin_hi, count(v.value) AS cnt
  FROM prof_bins b LEFT JOIN ref_long v ON v.feature = b.feature AND v.value >= b.bin_lo
   AND (v.value < b.bin_hi OR (v.value = b.bin_hi AND b.bin = (SELECT max(bin) FROM prof_bins x
        WHERE x.feature = b.feature)))
  GROUP BY ALL)"""


REF_PROFILE_SQL = _profile_sql("lineitem", f"WHERE {IS_REF_SQL}")


@query(
    "reference_profile",
    "feature:s n_samples:i mean:f5 std:f5 min:f6 max:f6 median:f5 p5:f5 p25:f5 p75:f5 p95:f5 n_bins:i",
    f"""WITH {REF_PROFILE_SQL}
SELECT *, len(edges) - 1 AS n_bins FROM prof""",
)
def _(spark, sf):
    profile = create_profile(reference_side(lineitem(spark, sf)), FEATURES)
    q = F.col("quantiles")
    return profile.select(
        "*",
        *[q[k].alias(f"p{k[:-1]}") for k in ("5%", "25%", "75%", "95%")],
        F.size("bin_counts").alias("n_bins"),
    )


@query(
    "reference_histogram",
    "feature:s bin:i bin_lo:f5 bin_hi:f5 cnt:i",
    f"WITH {REF_PROFILE_SQL} SELECT * FROM prof_hist",
)
def _(spark, sf):
    return profile_bins(create_profile(reference_side(lineitem(spark, sf)), FEATURES))


def _stored_profile(spark, sf, features):
    """Profile of the first period, saved and read back as a drift check would find it."""
    store = ReferenceStore(spark, shared_dir(spark))
    frame = reference_side(lineitem(spark, sf))
    store.save("baseline", create_profile(frame, features), features)
    return store.load("baseline")


_MASS = """(SELECT sum(cnt * least(greatest(({x} - h.bin_lo) / (h.bin_hi - h.bin_lo), 0.0), 1.0))
    / sum(cnt) FROM prof_hist h WHERE h.feature = lim.feature)"""


@query(
    "profile_only_psi",
    "feature:s psi:f6 js_divergence:f6",
    f"""WITH {_profile_sql("lineitem", f"WHERE {IS_REF_SQL}", FEATURES)},
cur AS ({long_sql(SHIFT_SQL, IS_REF_SQL, FEATURES)}),
lim AS (
  SELECT prof.feature, least(prof.min, min(cur.value)) AS lo, greatest(prof.max, max(cur.value)) AS hi,
         count(*) AS cur_n
  FROM prof JOIN cur ON cur.feature = prof.feature AND NOT is_ref GROUP BY prof.feature, prof.min, prof.max),
grid AS (SELECT lim.*, unnest(generate_series(0, 9)) AS bin FROM lim),
spread AS (
  SELECT feature, bin, cur_n,
   (CASE WHEN bin = 9 THEN 1.0 ELSE {_MASS.format(x="(lim.lo + (lim.bin + 1) * ((lim.hi - lim.lo) / 10.0))")} END)
   - (CASE WHEN bin = 0 THEN 0.0 ELSE {_MASS.format(x="(lim.lo + lim.bin * ((lim.hi - lim.lo) / 10.0))")} END) AS p
  FROM grid AS lim),
have AS (
  SELECT feature, {bin_sql()} AS bin, count(*) AS n FROM cur JOIN lim USING (feature)
  WHERE NOT is_ref GROUP BY ALL),
shares AS (
  SELECT spread.feature, p, coalesce(n, 0) / CAST(cur_n AS DOUBLE) AS q
  FROM spread LEFT JOIN have ON have.feature = spread.feature AND have.bin = spread.bin)
SELECT feature, sum({PSI_TERM_SQL}) AS psi, greatest(sum({js_sql()}), 0) AS js_divergence
FROM shares GROUP BY feature""",
)
def _(spark, sf):
    profile = _stored_profile(spark, sf, FEATURES)
    return profile_only_tests(profile, to_long(current_side(li_shift(spark, sf)), FEATURES))


@query(
    "reference_roundtrip",
    "feature:s n_samples:i mean:f5 bins:s n_values:i total_cnt:i",
    f"""WITH {REF_PROFILE_SQL}
SELECT feature, n_samples, mean,
  (SELECT string_agg(CAST(cnt AS VARCHAR), ',' ORDER BY bin) FROM prof_hist h WHERE h.feature = prof.feature)
    AS bins,
  (SELECT count(DISTINCT value) FROM ref_long v WHERE v.feature = prof.feature) AS n_values,
  n_samples AS total_cnt
FROM prof""",
)
def _(spark, sf):
    store = ReferenceStore(spark, shared_dir(spark))
    frame = reference_side(lineitem(spark, sf))
    store.save(
        "baseline", create_profile(frame, FEATURES), FEATURES, reference_values(frame, FEATURES)
    )
    values = (
        store.load_values("baseline")
        .groupBy("feature")
        .agg(F.count(F.lit(1)).alias("n_values"), F.sum("cnt").alias("total_cnt"))
    )
    loaded = store.load("baseline").select(
        "feature", "n_samples", "mean", F.array_join("bin_counts", ",").alias("bins")
    )
    return loaded.join(values, "feature")


@query(
    "list_references",
    "reference_name:s created_at:t total_samples:i n_features:i first_feature:s",
    """SELECT 'ref_' || l_linestatus AS reference_name, max(l_shipdate) AS created_at,
  count(l_quantity) AS total_samples, 2 AS n_features, 'l_quantity' AS first_feature
FROM lineitem GROUP BY l_linestatus""",
)
def _(spark, sf):
    names = ["l_quantity", "l_tax"]
    frame = lineitem(spark, sf)
    # One grouped job profiles every status; each status is a reference of its own.
    profiles = create_profile(frame, names, keys=["l_linestatus"])
    stamps = frame.groupBy("l_linestatus").agg(F.max("l_shipdate").alias("created_at"))
    rows = profiles.groupBy("l_linestatus").agg(
        F.max(F.when(F.col("feature") == names[0], F.col("n_samples"))).alias("total_samples"),
        F.count(F.lit(1)).alias("n_features"),
    )
    metadata = rows.join(stamps, "l_linestatus").select(
        F.concat(F.lit("ref_"), "l_linestatus").alias("reference_name"),
        "created_at",
        "total_samples",
        "n_features",
        F.lit(names[0]).alias("first_feature"),
    )
    return newest_first(metadata)


@query(
    "list_references_all",
    "reference_name:s total_samples:i n_features:i features:s status:s",
    f"""SELECT 'ref_' || l_linestatus AS reference_name, count({FEATURES[0]}) AS total_samples,
  {len(FEATURES)} AS n_features, '{",".join(FEATURES)}' AS features, l_linestatus AS status
FROM lineitem GROUP BY l_linestatus""",
)
def _(spark, sf):
    store, frame = ReferenceStore(spark, shared_dir(spark)), lineitem(spark, sf)
    # Each status becomes a reference of its own; there are as many as references are wanted.
    for (status,) in frame.select("l_linestatus").distinct().toLocalIterator():
        rows = frame.where(F.col("l_linestatus") == status)
        store.save(f"ref_{status}", create_profile(rows, FEATURES), FEATURES, metadata={"status": status})
    store.save("obsolete", create_profile(frame, FEATURES[:1]), FEATURES[:1])
    store.delete("obsolete")
    return store.list().select(
        "reference_name", "total_samples", "n_features", F.array_join("features", ",").alias("features"),
        F.col("info")["status"].alias("status"),
    )


@query(
    "reference_metadata",
    "reference_name:s total_samples:i n_features:i origin:s",
    f"""SELECT 'baseline' AS reference_name, count(*) AS total_samples, 4 AS n_features,
  'lineitem' AS origin FROM lineitem WHERE {IS_REF_SQL}""",
)
def _(spark, sf):
    profile = create_profile(reference_side(lineitem(spark, sf)), FEATURES)
    row = reference_metadata(profile, "baseline", FEATURES, {"origin": "lineitem"})
    return row.withColumn("origin", F.col("info")["origin"])


# ------------------------------------------------------------------------------------------- reports


def _results(spark, sf, frame=None, config=DriftConfig()):
    whole = lineitem(spark, sf) if frame is None else frame
    reference = reference_side(whole)
    return D.feature_drift(
        create_profile(reference, FEATURES),
        current_side(whole),
        FEATURES,
        reference_values(reference, FEATURES),
        config,
    )


def _severity_sql(psi: str = "psi", js: str = "js_divergence") -> str:
    levels = (
        ("severe", 0.5, 0.4),
        ("significant", 0.2, 0.2),
        ("moderate", 0.15, 0.1),
        ("low", 0.1, 0.05),
    )
    whens = " ".join(f"WHEN {psi} >= {p} OR {js} >= {j} THEN '{name}'" for name, p, j in levels)
    return f"CASE {whens} ELSE 'none' END"


def _results_sql(long: str, name: str = "res") -> str:
    order = " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(FEATURES, 1))
    return f"""{two_sample_sql(long)},
moments AS (
  SELECT feature, avg(value) FILTER (WHERE is_ref) AS reference_mean,
         stddev_samp(value) FILTER (WHERE is_ref) AS reference_std,
         avg(value) FILTER (WHERE NOT is_ref) AS current_mean,
         stddev_samp(value) FILTER (WHERE NOT is_ref) AS current_std FROM long GROUP BY feature),
graded AS (
  SELECT *, {_severity_sql()} AS severity, {ks_p_sql()} AS ks_p_value,
         abs(current_mean - reference_mean) AS mean_shift,
         CASE feature {order} END AS position
  FROM hist_tests JOIN cdf_tests USING (feature) JOIN moments USING (feature)),
{name} AS (
  SELECT *, feature AS feature_name, psi >= 0.15 AS is_drifted,
    CASE WHEN severity = 'none' THEN printf('%s stable (PSI=%.4f)', feature, psi)
         ELSE printf('%s %s drift: PSI=%.3f, mean %s%.2f', feature, severity, psi,
                     CASE WHEN current_mean > reference_mean THEN '+' ELSE '-' END, mean_shift)
    END AS message
  FROM graded)"""


LI_RESULTS_SQL = _results_sql(LI_LONG_SQL)
SHIFT_RESULTS_SQL = _results_sql(SHIFT_LONG_SQL)
_RESULT_COLUMNS = (
    "feature_name:s psi:f6 ks_statistic:f6 ks_p_value:f6 js_divergence:f6 wasserstein:f5 severity:s "
    "is_drifted:b reference_mean:f5 reference_std:f5 current_mean:f5 current_std:f5 mean_shift:f5"
)


@query("feature_drift", _RESULT_COLUMNS, f"WITH {LI_RESULTS_SQL} SELECT * FROM res")
def _(spark, sf):
    return _results(spark, sf)


@query("feature_drift_shifted", _RESULT_COLUMNS, f"WITH {SHIFT_RESULTS_SQL} SELECT * FROM res")
def _(spark, sf):
    return _results(spark, sf, li_shift(spark, sf))


@query(
    "drift_messages", "feature_name:s message:s", f"WITH {SHIFT_RESULTS_SQL} SELECT * FROM res"
)
def _(spark, sf):
    return _results(spark, sf, li_shift(spark, sf))


@query(
    "drift_severity",
    "feature_name:s severity:s score:f2",
    f"""WITH {SHIFT_RESULTS_SQL}
SELECT feature_name, severity, CASE severity WHEN 'none' THEN 0 WHEN 'low' THEN 0.25
  WHEN 'moderate' THEN 0.5 WHEN 'significant' THEN 0.75 ELSE 1 END AS score FROM res""",
)
def _(spark, sf):
    sample = shift_sample(spark, sf)
    tests = T.histogram_tests(sample.long(), sample.limits())
    level = D.severity(F.col("psi"), F.col("js_divergence"))
    return tests.select(
        F.col("feature").alias("feature_name"),
        level.alias("severity"),
        D.severity_score(level).alias("score"),
    )


@query(
    "drift_flag",
    "feature_name:s by_psi:b by_ks:b by_js:b by_unknown:b",
    f"""WITH {SHIFT_RESULTS_SQL}
SELECT feature_name, psi >= 0.15 AS by_psi, ks_p_value < 0.05 AS by_ks, js_divergence >= 0.1 AS by_js,
  psi >= 0.15 AS by_unknown FROM res""",
)
def _(spark, sf):
    found = _results(spark, sf, li_shift(spark, sf))
    columns = [F.col("psi"), F.col("js_divergence"), F.col("ks_p_value")]
    methods = {"by_psi": "psi", "by_ks": "ks", "by_js": "jensen_shannon", "by_unknown": "other"}
    return found.select(
        "feature_name",
        *[D.drifted(*columns, DriftConfig(method=m)).alias(n) for n, m in methods.items()],
    )


_REPORT_COLUMNS = (
    "report_id:s reference_name:s reference_samples:i current_samples:i current_window_start:t "
    "current_window_end:t overall_drift_score:f6 overall_severity:s n_features_drifted:i "
    "n_features_total:i drift_detected:b recommendations:s warnings:s"
)


def _report_sql(results: str, source: str) -> str:
    return f"""WITH {results},
tot AS (
  SELECT avg(CASE severity WHEN 'none' THEN 0 WHEN 'low' THEN 0.25 WHEN 'moderate' THEN 0.5
               WHEN 'significant' THEN 0.75 ELSE 1 END) AS overall_drift_score,
         max(CASE severity WHEN 'none' THEN 0 WHEN 'low' THEN 1 WHEN 'moderate' THEN 2
               WHEN 'significant' THEN 3 ELSE 4 END) AS worst,
         count(*) FILTER (WHERE is_drifted) AS n_features_drifted, count(*) AS n_features_total,
         max(ref_n) AS reference_samples,
         string_agg(feature, ', ' ORDER BY position) FILTER (WHERE severity = 'severe') AS severe
  FROM res),
dec AS (
  SELECT *, ['none', 'low', 'moderate', 'significant', 'severe'][worst + 1] AS overall_severity,
    n_features_drifted / CAST(n_features_total AS DOUBLE) >= 0.3 OR worst >= 3 AS drift_detected
  FROM tot),
win AS (SELECT count(*) AS current_samples, min(l_shipdate) AS current_window_start,
        max(l_shipdate) AS current_window_end FROM {source} WHERE NOT ({IS_REF_SQL}))
SELECT 'r1' AS report_id, 'baseline' AS reference_name, *,
  CASE WHEN overall_severity = 'none' THEN 'No action needed: all features stable' ELSE
    coalesce(nullif(concat_ws(' | ',
      CASE WHEN overall_severity = 'severe' THEN 'URGENT: Retrain model immediately - severe drift detected'
           WHEN drift_detected THEN printf('Retrain model: %d/%d features show %s drift',
                n_features_drifted, n_features_total, overall_severity) END,
      'Investigate: ' || severe,
      CASE WHEN NOT drift_detected AND overall_severity = 'low'
           THEN 'Continue monitoring: minor drift within acceptable range' END), ''), 'Monitor closely')
  END AS recommendations,
  CASE WHEN current_samples < 50
       THEN printf('Low samples (%d < 50): results may be unreliable', current_samples) ELSE '' END AS warnings
FROM dec, win"""


def _report(spark, sf, frame):
    results = _results(spark, sf, frame)
    report = D.drift_report(
        results, current_side(frame), FEATURES, "baseline", "l_shipdate", report_id="r1", now=NOW
    )
    return report, results


def _flat(report):
    return report.withColumns(
        {
            "recommendations": F.array_join("recommendations", " | "),
            "warnings": F.array_join("warnings", " | "),
        }
    )


@query("drift_report", _REPORT_COLUMNS, _report_sql(LI_RESULTS_SQL, "lineitem"))
def _(spark, sf):
    return _flat(_report(spark, sf, lineitem(spark, sf))[0])


@query("drift_report_shifted", _REPORT_COLUMNS, _report_sql(SHIFT_RESULTS_SQL, SHIFT_SQL))
def _(spark, sf):
    return _flat(_report(spark, sf, li_shift(spark, sf))[0])


# Without an id the report gets a random one, which is all that differs and not compared.
@query(
    "drift_report_own_id",
    " ".join(c for c in _REPORT_COLUMNS.split() if not c.startswith("report_id")),
    _report_sql(LI_RESULTS_SQL, "lineitem"),
)
def _(spark, sf):
    frame = lineitem(spark, sf)
    current = current_side(frame)
    return _flat(D.drift_report(_results(spark, sf, frame), current, FEATURES, "baseline", "l_shipdate", now=NOW))


@query("drift_report_json", "report_id:s report:s")
def _(spark, sf):
    return report_json(*_report(spark, sf, li_shift(spark, sf)))


@query(
    "drift_summary_text",
    "report_id:s summary:s",
    f"""WITH rep AS ({_report_sql(SHIFT_RESULTS_SQL, SHIFT_SQL)}),
lines AS (WITH {SHIFT_RESULTS_SQL}
  SELECT string_agg(printf('[%-5s] %s: PSI=%.4f (%s)', CASE WHEN is_drifted THEN 'DRIFT' ELSE 'OK' END, feature, psi, severity),
    chr(10) ORDER BY CASE severity WHEN 'none' THEN 4 WHEN 'low' THEN 3 WHEN 'moderate' THEN 2 WHEN 'significant' THEN 1 ELSE 0 END,
    position) AS features FROM res),
advice AS (SELECT string_agg(i || '. ' || r, chr(10) ORDER BY i) AS listed FROM (
  SELECT unnest(string_split(recommendations, ' | ')) AS r,
         generate_subscripts(string_split(recommendations, ' | '), 1) AS i FROM rep))
SELECT report_id, concat_ws(chr(10), repeat('=', 50), 'DRIFT DETECTION REPORT',
  'ID: ' || report_id || ' | Reference: ' || reference_name,
  format('Samples: {{:,}} current vs {{:,}} reference', current_samples, reference_samples), repeat('-', 50),
  printf('Score: %.3f | Severity: %s', overall_drift_score, upper(overall_severity)),
  printf('Drifted: %d/%d | Action: %s', n_features_drifted, n_features_total, CASE WHEN drift_detected THEN 'YES' ELSE 'NO' END),
  CASE WHEN warnings <> '' THEN 'Warnings: ' || warnings END, repeat('-', 50), features, repeat('-', 50), listed,
  repeat('=', 50)) AS summary FROM rep, lines, advice""",
)
def _(spark, sf):
    return D.summary_lines(*_report(spark, sf, li_shift(spark, sf)))


@query(
    "drift_metrics_long",
    "model_name:s model_version:s metric_type:s metric_value:f5 threshold_value:f5 "
    "is_shift_detected:b window_start:t window_end:t",
    f"""WITH {SHIFT_RESULTS_SQL},
win AS (SELECT min(l_shipdate) AS window_start, max(l_shipdate) AS window_end
        FROM {SHIFT_SQL} WHERE NOT ({IS_REF_SQL})),
m AS (
  SELECT feature_name || '_psi' AS metric_type, psi AS metric_value, 0.15 AS threshold_value,
         psi >= 0.15 AS is_shift_detected FROM res
  UNION ALL SELECT feature_name || '_js_divergence', js_divergence, 0.1, js_divergence >= 0.1 FROM res
  UNION ALL SELECT feature_name || '_ks_p_value', ks_p_value, 0.05, ks_p_value < 0.05 FROM res
  UNION ALL SELECT feature_name || '_ks_statistic', ks_statistic, NULL, FALSE FROM res
  UNION ALL SELECT feature_name || '_wasserstein', wasserstein, NULL, FALSE FROM res)
SELECT 'pricing' AS model_name, '3' AS model_version, m.*, win.* FROM m, win""",
)
def _(spark, sf):
    report, results = _report(spark, sf, li_shift(spark, sf))
    return H.drift_metrics_long(results, report, "pricing", "3")


@query(
    "drift_run_metrics",
    "run_id:s key:s value:f5",
    f"""WITH {SHIFT_RESULTS_SQL},
m AS (
  SELECT unnest([{", ".join(f"{{'k': '{m}', 'v': CAST({m} AS DOUBLE)}}" for m in H.FEATURE_METRICS)}],
                recursive := true), feature_name FROM res)
SELECT 'run-1' AS run_id, feature_name || '_' || k AS key, v AS value FROM m
UNION ALL SELECT 'run-1', 'overall_drift_score', avg(CASE severity WHEN 'none' THEN 0 WHEN 'low' THEN 0.25
   WHEN 'moderate' THEN 0.5 WHEN 'significant' THEN 0.75 ELSE 1 END) FROM res
UNION ALL SELECT 'run-1', 'n_features_drifted', count(*) FILTER (WHERE is_drifted) FROM res
UNION ALL SELECT 'run-1', 'drift_ratio', count(*) FILTER (WHERE is_drifted) / CAST(count(*) AS DOUBLE)
  FROM res""",
)
def _(spark, sf):
    report, results = _report(spark, sf, li_shift(spark, sf))
    run = F.lit("run-1")
    return H.drift_run_metrics(report.withColumn("run_id", run), results.withColumn("run_id", run))


@query(
    "drift_heatmap",
    "feature_name:s psi:f6 ks_statistic:f6 js_divergence:f6",
    f"""WITH {SHIFT_RESULTS_SQL}
SELECT feature_name, least(psi, 1) AS psi, ks_statistic, least(js_divergence, 1) AS js_divergence
FROM res""",
)
def _(spark, sf):
    return H.drift_heatmap(_results(spark, sf, li_shift(spark, sf)))


LI_WASSERSTEIN = {
    "l_quantity": (0.1, 1.0),
    "l_extendedprice": (500.0, 5000.0),
    "l_discount": (0.001, 0.01),
}


@query(
    "drift_bands",
    "feature_name:s psi_band:s ks_band:s js_band:s wasserstein_band:s",
    f"""WITH {SHIFT_RESULTS_SQL},
lims(feature, m, l) AS (VALUES {", ".join(f"('{f}', {m}, {x})" for f, (m, x) in LI_WASSERSTEIN.items())})
SELECT feature_name,
  CASE WHEN psi < 0.1 THEN 'NO SIGNIFICANT DRIFT' WHEN psi < 0.2 THEN 'MODERATE DRIFT'
       ELSE 'SIGNIFICANT DRIFT' END AS psi_band,
  CASE WHEN ks_p_value < 0.001 THEN 'DRIFT DETECTED' WHEN ks_p_value < 0.05 THEN 'POSSIBLE DRIFT'
       ELSE 'NO DRIFT' END AS ks_band,
  CASE WHEN js_divergence < 0.1 THEN 'LOW' WHEN js_divergence < 0.3 THEN 'MODERATE' ELSE 'HIGH' END
    AS js_band,
  CASE WHEN wasserstein > l THEN 'LARGE SHIFT' WHEN wasserstein > m THEN 'MODERATE SHIFT'
       ELSE 'SMALL' END AS wasserstein_band
FROM res LEFT JOIN lims USING (feature)""",
)
def _(spark, sf):
    return D.drift_bands(_results(spark, sf, li_shift(spark, sf)), LI_WASSERSTEIN)


@query(
    "drift_recommendations",
    "group_name:s overall_severity:s drift_detected:b recommendations:s",
    f"""WITH base AS (
  SELECT l_returnflag AS g, l_linestatus AS s, {IS_REF_SQL} AS is_ref, l_quantity, l_extendedprice
  FROM lineitem WHERE {IS_REF_SQL} OR (l_returnflag = 'A') OR (l_returnflag = 'N' AND l_quantity > 10)
     OR (l_returnflag = 'R' AND l_extendedprice > 30000)),
long AS (
  SELECT g || '/' || f AS feature, g, f, is_ref, v AS value FROM (
    SELECT g, is_ref, 'l_quantity' AS f, l_quantity AS v FROM base
    UNION ALL SELECT g, is_ref, 'l_extendedprice', l_extendedprice FROM base)),
lim AS (SELECT feature, min(value) AS lo, max(value) AS hi, count(*) FILTER (WHERE is_ref) AS ref_n,
        count(*) FILTER (WHERE NOT is_ref) AS cur_n FROM long GROUP BY feature),
hist AS (SELECT feature, {bin_sql()} AS bin, ref_n, cur_n, count(*) FILTER (WHERE is_ref) AS n_ref,
         count(*) FILTER (WHERE NOT is_ref) AS n_cur FROM long JOIN lim USING (feature) GROUP BY ALL),
shares AS (SELECT feature, bin, n_ref / CAST(ref_n AS DOUBLE) AS p, n_cur / CAST(cur_n AS DOUBLE) AS q
           FROM hist),
t AS (SELECT split_part(feature, '/', 1) AS g, split_part(feature, '/', 2) AS f,
        sum({PSI_TERM_SQL}) AS psi, greatest(sum({js_sql()}), 0) AS js_divergence
      FROM shares GROUP BY feature),
r AS (SELECT *, {_severity_sql()} AS severity FROM t),
tot AS (
  SELECT g AS group_name, max(CASE severity WHEN 'none' THEN 0 WHEN 'low' THEN 1 WHEN 'moderate' THEN 2
     WHEN 'significant' THEN 3 ELSE 4 END) AS worst, count(*) FILTER (WHERE psi >= 0.15) AS k,
     count(*) AS n, string_agg(f, ', ' ORDER BY f DESC) FILTER (WHERE severity = 'severe') AS severe
  FROM r GROUP BY g),
d AS (SELECT *, ['none', 'low', 'moderate', 'significant', 'severe'][worst + 1] AS overall_severity,
        k / CAST(n AS DOUBLE) >= 0.3 OR worst >= 3 AS drift_detected FROM tot)
SELECT *, CASE WHEN overall_severity = 'none' THEN 'No action needed: all features stable' ELSE
    coalesce(nullif(concat_ws(' | ',
      CASE WHEN overall_severity = 'severe' THEN 'URGENT: Retrain model immediately - severe drift detected'
           WHEN drift_detected THEN printf('Retrain model: %d/%d features show %s drift', k, n,
                overall_severity) END,
      'Investigate: ' || severe,
      CASE WHEN NOT drift_detected AND overall_severity = 'low'
           THEN 'Continue monitoring: minor drift within acceptable range' END), ''), 'Monitor closely')
  END AS recommendations FROM d""",
)
def _(spark, sf):
    flag = F.col("l_returnflag")
    kept = (
        is_ref()
        | (flag == "A")
        | ((flag == "N") & (F.col("l_quantity") > 10))
        | ((flag == "R") & (F.col("l_extendedprice") > 30000))
    )
    names, keys = ["l_quantity", "l_extendedprice"], ["group_name"]
    frame = lineitem(spark, sf).where(kept).withColumn("group_name", flag)
    sample = TwoSample.split(frame, names, is_ref(), keys)
    tests = T.histogram_tests(sample.long(), sample.limits(), keys=keys)
    psi, js = F.col("psi"), F.col("js_divergence")
    graded = tests.select(
        "group_name",
        F.col("feature").alias("feature_name"),
        F.array_position(F.array(*[F.lit(n) for n in names]), F.col("feature")).alias("position"),
        D.severity(psi, js).alias("severity"),
        D.drifted(psi, js, F.lit(None)).alias("is_drifted"),
        F.lit(0).alias("reference_samples"),
    )
    return D.summarise(graded, keys=keys).withColumn(
        "recommendations", F.array_join("recommendations", " | ")
    )


@query(
    "drift_windows",
    "feature:s window_end:s cur_n:i psi:f6 js_divergence:f6",
    f"""WITH e AS (SELECT date_trunc('day', ts) AS d, ts < TIMESTAMP '{EVENT_CUT}' AS is_ref, value FROM events),
lim AS (SELECT min(value) AS lo, max(value) AS hi, count(*) FILTER (WHERE is_ref) AS ref_n FROM e),
b AS (SELECT d, is_ref, {bin_sql()} AS bin FROM e, lim),
ends AS (SELECT DISTINCT d + to_days(CAST(k AS INTEGER)) AS window_end
         FROM b, (SELECT unnest(generate_series(0, 6)) AS k)
         WHERE NOT is_ref AND d + to_days(CAST(k AS INTEGER)) <= (SELECT max(d) FROM b WHERE NOT is_ref)),
w AS (SELECT window_end, bin, count(*) AS n FROM ends JOIN b ON NOT is_ref
        AND d BETWEEN window_end - INTERVAL 6 DAYS AND window_end GROUP BY ALL),
t AS (SELECT window_end, sum(n) AS cur_n FROM w GROUP BY 1),
shares AS (
  SELECT t.window_end, cur_n, g.bin, coalesce(n, 0) / CAST(cur_n AS DOUBLE) AS q,
    (SELECT count(*) FROM b WHERE is_ref AND b.bin = g.bin) / CAST(ref_n AS DOUBLE) AS p
  FROM t CROSS JOIN (SELECT unnest(generate_series(0, 9)) AS bin) AS g CROSS JOIN lim
  LEFT JOIN w ON w.window_end = t.window_end AND w.bin = g.bin)
SELECT 'value' AS feature, strftime(window_end, '%Y-%m-%d') AS window_end, any_value(cur_n) AS cur_n,
  sum({PSI_TERM_SQL}) AS psi, greatest(sum({js_sql()}), 0) AS js_divergence
FROM shares GROUP BY shares.window_end""",
)
def _(spark, sf):
    found = D.sliding_histogram_tests(
        events(spark, sf), ["value"], "ts", F.col("ts") < at(EVENT_CUT)
    )
    return found.withColumn("window_end", F.col("window_end").cast("string"))


@query(
    "drift_windows_cdf",
    "feature:s window_end:s ks_statistic:f6 ks_p_value:f6 wasserstein:f5",
    f"""WITH e AS (SELECT date_trunc('day', ts) AS d, ts < TIMESTAMP '{EVENT_CUT}' AS is_ref, value FROM events),
ends AS (SELECT DISTINCT d + to_days(CAST(k AS INTEGER)) AS window_end
         FROM e, (SELECT unnest(generate_series(0, 6)) AS k)
         WHERE NOT is_ref AND d + to_days(CAST(k AS INTEGER)) <= (SELECT max(d) FROM e WHERE NOT is_ref)),
u AS (SELECT window_end, value, count(*) FILTER (WHERE is_ref) AS r, count(*) FILTER (WHERE NOT is_ref) AS c
      FROM ends JOIN e ON is_ref OR d BETWEEN window_end - INTERVAL 6 DAYS AND window_end GROUP BY ALL),
k AS (SELECT window_end, sum(r) OVER p AS ref_n, sum(c) OVER p AS cur_n,
        abs(sum(r) OVER w / CAST(sum(r) OVER p AS DOUBLE) - sum(c) OVER w / CAST(sum(c) OVER p AS DOUBLE)) AS gap,
        coalesce(lead(value) OVER w - value, 0) AS step
      FROM u WINDOW w AS (PARTITION BY window_end ORDER BY value), p AS (PARTITION BY window_end)),
t AS (SELECT window_end, any_value(ref_n) AS ref_n, any_value(cur_n) AS cur_n, max(gap) AS ks_statistic,
        sum(gap * step) AS wasserstein FROM k GROUP BY window_end)
SELECT 'value' AS feature, strftime(window_end, '%Y-%m-%d') AS window_end, ks_statistic,
  {ks_p_sql()} AS ks_p_value, wasserstein FROM t""",
)
def _(spark, sf):
    found = D.sliding_cdf_tests(events(spark, sf), ["value"], "ts", F.col("ts") < at(EVENT_CUT))
    return found.withColumn("window_end", F.col("window_end").cast("string"))


# ------------------------------------------------------------------------------------------- history

HISTORY_FEATURES = FEATURES


def _monthly_psi(spark, sf):
    """PSI of every shipping month against the stored bins of the first period: one grouped pass."""
    frame = lineitem(spark, sf)
    profile = _stored_profile(spark, sf, HISTORY_FEATURES)
    month = F.date_trunc("month", "l_shipdate").cast("timestamp_ntz")
    current = current_side(frame).withColumn("window", month)
    long = to_long(current, HISTORY_FEATURES, None, ["window"])
    edges = F.broadcast(profile.select("feature", "bin_edges"))
    counts = (
        long.join(edges, "feature")
        .withColumn("bin", stored_bin(F.col("value"), F.col("bin_edges")))
        .groupBy("window", "feature", "bin")
        .agg(F.count(F.lit(1)).alias("n_cur"))
    )
    return window_psi(counts, profile)


def _history(spark, sf):
    """(runs, run metrics): one run per month."""
    psi = _monthly_psi(spark, sf).select(
        F.date_format("window", "yyyy-MM").alias("run_id"), "window", "feature", "psi"
    )
    runs = psi.groupBy("run_id").agg(
        F.min("window").alias("timestamp"),
        (F.max("psi") >= 0.15).alias("drift_detected"),
        F.lit("pricing").alias("model_name"),
    )
    metrics = H.feature_metrics(psi.withColumnRenamed("feature", "feature_name"))
    total = psi.groupBy("run_id").agg(F.max("psi").alias("value"))
    worst = total.select("run_id", F.lit("max_psi").alias("key"), "value")
    return runs, metrics.unionByName(worst, allowMissingColumns=True)


_MONTHLY_SQL = f"""{_profile_sql("lineitem", f"WHERE {IS_REF_SQL}", HISTORY_FEATURES)},
cur AS ({long_sql("lineitem", IS_REF_SQL, HISTORY_FEATURES, ", date_trunc('month', l_shipdate) AS m")}),
placed AS (
  SELECT m, cur.feature, greatest(least(len(list_filter(edges, lambda e: e <= value)) - 1, len(edges) - 2), 0)
         AS bin FROM cur JOIN prof USING (feature) WHERE NOT is_ref),
c AS (SELECT m, feature, bin, count(*) AS n FROM placed GROUP BY ALL),
t AS (SELECT m, feature, sum(n) AS cur_n FROM c GROUP BY ALL),
s AS (SELECT feature, sum(cnt) AS ref_n FROM prof_hist GROUP BY feature),
sh AS (
  SELECT t.m, t.feature, h.bin, cnt / CAST(ref_n AS DOUBLE) AS p, coalesce(n, 0) / CAST(cur_n AS DOUBLE) AS q
  FROM t JOIN prof_hist h USING (feature) JOIN s USING (feature)
  LEFT JOIN c ON c.m = t.m AND c.feature = t.feature AND c.bin = h.bin),
monthly AS (SELECT m, strftime(m, '%Y-%m') AS run_id, feature, sum({PSI_TERM_SQL}) AS psi FROM sh GROUP BY ALL)"""


@query(
    "drift_history",
    "run_id:s timestamp:t drift_detected:b l_quantity_psi:f6 l_extendedprice_psi:f6 max_psi:f6",
    f"""WITH {_MONTHLY_SQL}
SELECT run_id, min(m) AS timestamp, max(psi) >= 0.15 AS drift_detected,
  max(psi) FILTER (WHERE feature = 'l_quantity') AS l_quantity_psi,
  max(psi) FILTER (WHERE feature = 'l_extendedprice') AS l_extendedprice_psi, max(psi) AS max_psi
FROM monthly GROUP BY run_id ORDER BY timestamp DESC LIMIT 30""",
)
def _(spark, sf):
    runs, metrics = _history(spark, sf)
    wanted = ["l_quantity_psi", "l_extendedprice_psi", "max_psi"]
    return H.drift_history(runs, metrics, wanted, 30, "pricing")


@query(
    "drift_timeline",
    "run_id:s timestamp:t psi:f6 band:s",
    f"""WITH {_MONTHLY_SQL}
SELECT run_id, m AS timestamp, psi, CASE WHEN psi < 0.1 THEN 'none' WHEN psi < 0.15 THEN 'low'
   WHEN psi < 0.2 THEN 'moderate' WHEN psi < 0.5 THEN 'significant' ELSE 'severe' END AS band
FROM monthly WHERE feature = 'l_quantity' ORDER BY m DESC LIMIT 12""",
)
def _(spark, sf):
    runs, metrics = _history(spark, sf)
    return H.drift_timeline(runs, metrics, "l_quantity", 12)
