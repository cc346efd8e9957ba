"""From test statistics to severities, decisions and a drift report."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkdrift.config import SEVERITIES, SEVERITY_SCORES, DriftConfig
from sparkdrift.functions.ks_exact import ks_p_value
from sparkdrift.functions.numeric import bin_index
from sparkdrift.operators.distribution import (
    attach_groups,
    bounds,
    group_keys,
    running_counts,
    running_sum,
    to_long,
    value_counts,
)
from sparkdrift.operators.drift import cdf_tests, histogram_sums, histogram_tests
from sparkdrift.operators.frames import null_safe_join, one_row
from sparkdrift.operators.reference import profile_only_tests
from sparkdrift.sources.files import written


def severity(psi: Column, js: Column, config: DriftConfig = DriftConfig()) -> Column:
    """Worst level whose PSI or JS threshold is reached."""
    expr = None
    for level in reversed(SEVERITIES[1:]):
        hit = (psi >= config.psi[level]) | (js >= config.js[level])
        expr = F.when(hit, level) if expr is None else expr.when(hit, level)
    return expr.otherwise(SEVERITIES[0])


def severity_rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), level).cast("int") - 1


def severity_score(level: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in SEVERITY_SCORES.items() for x in pair])[level]


def drifted(psi: Column, js: Column, ks_p: Column, config: DriftConfig = DriftConfig()) -> Column:
    """Per-feature decision by the configured method; an unknown method falls back to PSI."""
    if config.method == "ks":
        return ks_p < config.ks_p_value
    if config.method in ("js", "jensen_shannon"):
        return js >= config.js["moderate"]
    return psi >= config.psi["moderate"]


def drift_message(
    name: Column, level: Column, psi: Column, cur_mean: Column, ref_mean: Column
) -> Column:
    direction = F.when(cur_mean > ref_mean, "+").otherwise("-")
    return F.when(level == "none", F.format_string("%s stable (PSI=%.4f)", name, psi)).otherwise(
        F.format_string(
            "%s %s drift: PSI=%.3f, mean %s%.2f",
            name, level, psi, direction, F.abs(cur_mean - ref_mean),
        )
    )


def current_stats(current_long: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return current_long.groupBy(*group_keys(keys)).agg(
        F.avg("value").alias("current_mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("current_std"),
    )


def folded_stats(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The same from folded rows: deviations are taken from the mean, which a first pass finds."""
    group = group_keys(keys)
    present = counts.where(F.col("n_cur") > 0)
    sums = present.groupBy(*group).agg(
        F.sum("n_cur").alias("__n"), (F.sum(F.col("value") * F.col("n_cur")) / F.sum("n_cur")).alias("current_mean")
    )
    off = F.col("value") - F.col("current_mean")
    squares = attach_groups(present, sums, keys).groupBy(*group, "__n", "current_mean").agg(
        F.sum(off * off * F.col("n_cur")).alias("__squares")
    )
    spread = F.when(F.col("__n") > 1, F.sqrt(F.col("__squares") / (F.col("__n") - 1))).otherwise(0.0)
    return squares.select(*group, "current_mean", spread.alias("current_std"))


def combined_counts(values: DataFrame, current_long: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Folded long frame of stored reference values and current rows."""
    stored = values.select(
        *group_keys(keys), "value", F.col("cnt").alias("n_ref"), F.lit(0).cast("long").alias("n_cur")
    )
    return value_counts(stored.unionByName(current_long), keys)


def feature_drift(
    profile: DataFrame,
    current: DataFrame,
    features: Sequence[str],
    values: DataFrame | None = None,
    config: DriftConfig = DriftConfig(),
    keys: Sequence[str] = (),
    p_mode: str = "asymptotic",
) -> DataFrame:
    """Per-feature results: four statistics, both means and deviations, severity, decision, message.

    ``profile`` and ``values`` describe the reference; without ``values`` the profile's bins stand in
    for the raw data. Features without a valid current value are left out.
    """
    group = group_keys(keys)
    listed = [F.lit(f) for f in features]
    profile = profile.where(F.col("feature").isin(*features))
    current_long = to_long(current, features, None, keys)
    if values is None:
        tests = profile_only_tests(profile, current_long, keys=keys)
        p = ks_p_value("ks_statistic", "cur_n", "cur_n", p_mode)
        tests = tests.withColumn("ks_p_value", p).drop("cur_n")
        stats = current_stats(current_long, keys)
    else:
        # Everything about the current rows follows from one fold of both sides, which is written once.
        counts = written(combined_counts(values.where(F.col("feature").isin(*features)), current_long, keys))
        stats = folded_stats(counts, keys)
        limits = bounds(counts, keys).where((F.col("ref_n") > 0) & (F.col("cur_n") > 0))
        tests = null_safe_join(
            histogram_tests(counts, limits, keys=keys), cdf_tests(counts, keys, p_mode), group
        )
    joined = null_safe_join(
        null_safe_join(tests, stats, group),
        profile.select(
            *group,
            "n_samples",
            F.col("mean").alias("reference_mean"),
            F.col("std").alias("reference_std"),
        ),
        group,
    )
    psi, js = F.col("psi"), F.col("js_divergence")
    graded = joined.withColumn("severity", severity(psi, js, config))
    return graded.select(
        *keys,
        F.col("feature").alias("feature_name"),
        F.array_position(F.array(*listed), F.col("feature")).cast("int").alias("position"),
        "psi",
        "ks_statistic",
        "ks_p_value",
        "js_divergence",
        "wasserstein",
        "severity",
        drifted(psi, js, F.col("ks_p_value"), config).alias("is_drifted"),
        "reference_mean",
        "reference_std",
        "current_mean",
        "current_std",
        F.abs(F.col("current_mean") - F.col("reference_mean")).alias("mean_shift"),
        drift_message(
            F.col("feature"),
            F.col("severity"),
            psi,
            F.col("current_mean"),
            F.col("reference_mean"),
        ).alias("message"),
        F.col("n_samples").alias("reference_samples"),
    )


def recommendations(
    level: Column, detected: Column, n_drifted: Column, n_total: Column, severe: Column
) -> Column:
    """Ordered advice; ``severe`` is the array of severely drifted feature names."""
    # Advice texts.
    advice = F.array_compact(
        F.array(
            F.when(level == "severe", "URGENT: Retrain model immediately - severe drift detected")
            .when(
                detected,
                F.format_string(
                    "Retrain model: %d/%d features show %s drift", n_drifted, n_total, level
                ),
            ),
            F.when(F.size(severe) > 0, F.concat(F.lit("Investigate: "), F.array_join(severe, ", "))),
            F.when(
                ~detected & (level == "low"),
                "Continue monitoring: minor drift within acceptable range",
            ),
        )
    )
    return (
        F.when(level == "none", F.array(F.lit("No action needed: all features stable")))
        .when(F.size(advice) == 0, F.array(F.lit("Monitor closely")))
        .otherwise(advice)
    )


def summarise(
    results: DataFrame, config: DriftConfig = DriftConfig(), keys: Sequence[str] = ()
) -> DataFrame:
    """Overall score, severity, decision and advice; one row per key (or one row)."""
    rank = severity_rank(F.col("severity"))
    total = results.groupBy(*keys).agg(
        F.avg(severity_score(F.col("severity"))).alias("overall_drift_score"),
        F.max_by("severity", rank).alias("overall_severity"),
        F.count_if("is_drifted").alias("n_features_drifted"),
        F.count(F.lit(1)).alias("n_features_total"),
        F.transform(
            F.array_sort(
                F.collect_list(
                    F.when(
                        F.col("severity") == "severe",
                        F.struct("position", "feature_name"),
                    )
                )
            ),
            lambda s: s["feature_name"],
        ).alias("severe_features"),
        F.max("reference_samples").alias("reference_samples"),
        F.collect_set("feature_name").alias("analyzed_features"),
    )
    ratio = F.try_divide(F.col("n_features_drifted"), F.col("n_features_total"))
    level = F.col("overall_severity")
    decided = total.withColumn(
        "drift_detected",
        (ratio >= config.drifted_share) | level.isin("significant", "severe"),
    )
    return decided.withColumn(
        "recommendations",
        recommendations(
            level,
            F.col("drift_detected"),
            F.col("n_features_drifted"),
            F.col("n_features_total"),
            F.col("severe_features"),
        ),
    )


def drift_report(
    results: DataFrame,
    current: DataFrame,
    features: Sequence[str],
    reference_name: str,
    time_column: str | None = "timestamp",
    config: DriftConfig = DriftConfig(),
    report_id: str | None = None,
    now: str | None = None,
    warnings: Sequence[str] = (),
) -> DataFrame:
    """One-row report. ``now`` (ISO string) fixes the clock; a window without timestamps ends there.

    ``warnings`` carries what was known before any job ran; low sample counts and features without
    valid values are found in the data and appended.
    """
    clock = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    has_time = time_column is not None and time_column in current.columns
    window = (
        [F.min(time_column), F.max(time_column)]
        if has_time
        else [F.lit(None).cast("timestamp"), F.lit(None).cast("timestamp")]
    )
    sample = current.agg(
        F.count(F.lit(1)).alias("current_samples"),
        window[0].alias("w_start"),
        window[1].alias("w_end"),
    )
    back = F.expr(f"INTERVAL {config.window_hours} HOURS")
    seen = F.col("sample")
    lost = F.array_except(F.array(*[F.lit(f) for f in features]), F.col("analyzed_features"))
    late = F.transform(
        lost, lambda f: F.concat(F.lit("Feature '"), f, F.lit("' has no valid values"))
    )
    few = F.array_compact(
        F.array(
            F.when(
                seen["current_samples"] < config.min_samples,
                F.format_string(
                    f"Low samples (%d < {config.min_samples}): results may be unreliable",
                    seen["current_samples"],
                ),
            )
        )
    )
    early = F.array(*[F.lit(w) for w in warnings]).cast("array<string>")
    nothing = F.col("n_features_total") == 0
    return summarise(results, config).withColumn("sample", one_row(sample)).select(
        F.lit(str(uuid.uuid4()) if report_id is None else report_id).alias("report_id"),
        clock.alias("timestamp"),
        F.lit(reference_name).alias("reference_name"),
        "reference_samples",
        seen["current_samples"].alias("current_samples"),
        F.coalesce(seen["w_start"].cast("timestamp"), clock - back).alias("current_window_start"),
        F.coalesce(seen["w_end"].cast("timestamp"), clock).alias("current_window_end"),
        "overall_drift_score",
        "overall_severity",
        "n_features_drifted",
        F.when(nothing, F.raise_error(F.lit("no features could be analyzed")).cast("long"))
        .otherwise(F.col("n_features_total"))
        .alias("n_features_total"),
        "drift_detected",
        "recommendations",
        F.concat(early, few, late).alias("warnings"),
    )


def select_features(
    requested: Sequence[str] | None,
    available: Sequence[str],
    current_columns: Sequence[str],
    from_table: bool = False,
) -> tuple[list[str], list[str]]:
    """Features to analyse and the warnings that selecting them produced.

    Features unknown to the reference are skipped with a warning. Features absent from the current
    frame are an error when the caller handed the frame over, a warning when it came from a table.
    """
    warnings: list[str] = []
    features = list(available) if requested is None else list(requested)
    unknown = [f for f in features if f not in set(available)]
    if unknown:
        warnings.append(f"Features not in reference: {unknown}")
        features = [f for f in features if f not in set(unknown)]
    if not features:
        raise ValueError("no valid features to analyze")
    absent = [f for f in features if f not in set(current_columns)]
    if absent and not from_table:
        raise ValueError(f"current data is missing columns: {absent}")
    warnings += [f"Feature '{f}' missing from current data" for f in absent]
    return [f for f in features if f not in set(absent)], warnings


def summary_lines(report: DataFrame, results: DataFrame) -> DataFrame:
    """Readable text of one report: header, features worst first, numbered advice."""
    # Layout of the text summary.
    rule, thin = "=" * 50, "-" * 50
    status = F.when(F.col("is_drifted"), "DRIFT").otherwise("OK")
    row = F.format_string(
        "[%-5s] %s: PSI=%.4f (%s)", status, F.col("feature_name"), F.col("psi"), F.col("severity")
    )
    per_feature = results.agg(
        F.transform(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        (-severity_rank(F.col("severity"))).alias("rank"),
                        F.col("position"),
                        row.alias("line"),
                    )
                )
            ),
            lambda s: s["line"],
        )
    ).scalar()
    advice = F.transform(
        F.col("recommendations"), lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r)
    )
    warned = F.when(
        F.size("warnings") > 0,
        F.array(F.concat(F.lit("Warnings: "), F.array_join("warnings", "; "))),
    ).otherwise(F.array().cast("array<string>"))
    return report.withColumn("feature_lines", per_feature).select(
        "report_id",
        F.array_join(
            F.concat(
                F.array(
                    F.lit(rule),
                    F.lit("DRIFT DETECTION REPORT"),
                    F.concat(
                        F.lit("ID: "), "report_id", F.lit(" | Reference: "), "reference_name"
                    ),
                    F.format_string(
                        "Samples: %,d current vs %,d reference",
                        F.col("current_samples"),
                        F.col("reference_samples"),
                    ),
                    F.lit(thin),
                    F.format_string(
                        "Score: %.3f | Severity: %s",
                        F.col("overall_drift_score"),
                        F.upper("overall_severity"),
                    ),
                    F.format_string(
                        "Drifted: %d/%d | Action: %s",
                        F.col("n_features_drifted"),
                        F.col("n_features_total"),
                        F.when(F.col("drift_detected"), "YES").otherwise("NO"),
                    ),
                ),
                warned,
                F.array(F.lit(thin)),
                F.col("feature_lines"),
                F.array(F.lit(thin)),
                advice,
                F.array(F.lit(rule)),
            ),
            "\n",
        ).alias("summary"),
    )


def exit_code(drift_detected: bool | None) -> int:
    """Process exit code of a drift check: 0 no drift, 1 drift, 2 the check itself failed (None)."""
    return 2 if drift_detected is None else int(drift_detected)


def sliding_histogram_tests(
    df: DataFrame,
    features: Sequence[str],
    time_column: str,
    is_ref: Column,
    window_days: int = 7,
    bins: int = 10,
) -> DataFrame:
    """PSI and JS of every daily-stepped trailing window against one reference sample.

    Rows are folded to (feature, day, bin) once; a window is the range sum of its daily partials, so
    rows are never copied per window. All windows share one grid over the whole value range.
    """
    day = F.date_trunc("day", F.col(time_column)).cast("date")
    long = to_long(df.withColumn("__day", day).withColumn("__ref", is_ref), features,
                   F.col("__ref"), ["__day"])
    limits = bounds(long).select("feature", "lo", "hi", "ref_n")
    daily = (
        long.join(F.broadcast(limits), "feature")
        .withColumn("bin", bin_index(F.col("value"), F.col("lo"), F.col("hi"), bins))
        .groupBy("feature", "bin", "__day")
        .agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"))
    )
    reference = daily.groupBy("feature", "bin").agg(F.sum("n_ref").alias("n_ref"))
    # Each day's partial reaches the windows ending on that day and the next window_days - 1 days.
    reach = daily.where(F.col("n_cur") > 0).select(
        "feature",
        "bin",
        "n_cur",
        F.explode(
            F.sequence(F.col("__day"), F.date_add("__day", window_days - 1), F.expr("INTERVAL 1 DAY"))
        ).alias("window_end"),
    )
    windowed = reach.groupBy("feature", "bin", "window_end").agg(F.sum("n_cur").alias("n_cur"))
    last_day = daily.where(F.col("n_cur") > 0).agg(F.max("__day")).scalar()
    windowed = windowed.where(F.col("window_end") <= last_day)
    ends = windowed.groupBy("feature", "window_end").agg(F.sum("n_cur").alias("cur_n"))
    grid = null_safe_join(ends, limits, ["feature"]).select(
        "feature", "window_end", "cur_n", "ref_n", "lo", "hi",
        F.explode(
            F.sequence(F.lit(0), F.when(F.col("hi") <= F.col("lo"), 0).otherwise(bins - 1))
        ).alias("bin"),
    )
    filled = null_safe_join(
        null_safe_join(grid, windowed, ["feature", "window_end", "bin"], "left"),
        reference,
        ["feature", "bin"],
        "left",
    )
    return filled.groupBy("feature", "window_end", "cur_n").agg(
        *histogram_sums(
            "coalesce(n_ref, 0) / ref_n", "coalesce(n_cur, 0) / cur_n", f"{float(bins)}D"
        )
    )


def sliding_cdf_tests(
    df: DataFrame,
    features: Sequence[str],
    time_column: str,
    is_ref: Column,
    window_days: int = 7,
    p_mode: str = "asymptotic",
) -> DataFrame:
    """KS and Wasserstein of every daily-stepped trailing window against one reference sample.

    Rows are folded to (feature, day, value) once and windows add up daily partials. The reference becomes
    one table of its share and of the integral of that share at every value, which each window looks up at
    its own values only: between two of them the window's share is one level, and the reference crosses a
    level at most once. What is shuffled doesn't depend on the number of windows times reference values.
    """
    day = F.date_trunc("day", F.col(time_column)).cast("date")
    rows = df.withColumn("__day", day).withColumn("__ref", is_ref)
    daily = written(value_counts(to_long(rows, features, F.col("__ref"), ["__day"]), ["__day"]))
    reference = written(reference_table(daily))
    later = daily.where(F.col("n_cur") > 0)
    last_day = later.agg(F.max("__day")).scalar()
    reach = F.sequence(F.col("__day"), F.date_add("__day", window_days - 1), F.expr("INTERVAL 1 DAY"))
    none = F.lit(0).cast("long").alias("n_ref")
    current = later.select(F.explode(reach).alias("window_end"), "feature", "value", none, "n_cur")
    counts = value_counts(current.where(F.col("window_end") <= last_day), ["window_end"])
    walked = running_counts(counts, ["window_end"]).selectExpr(
        "window_end", "feature", "value", "next_value", "n_cur", "cum_cur", "cur_n", "cur_lo = cur_hi AS one_value"
    )
    here = reference.selectExpr(
        "feature", "value", "below", "upto", "integral", "ref_n", "ref_hi", "hi_integral", "ref_lo = ref_hi AS one_ref"
    )
    after = reference.selectExpr("feature", "value AS next_value", "integral AS next_integral")
    steps = (
        walked.join(here, ["feature", "value"])
        .join(after, ["feature", "next_value"], "left")
        .where("ref_n > 0")
        # The last value's step ends where the reference does; levels are ranks of the reference.
        .withColumn("end", F.coalesce("next_value", F.greatest("ref_hi", "value")))
        .withColumn("end_integral", F.expr("coalesce(next_integral, if(ref_hi > value, hi_integral, integral))"))
        .withColumn("level", F.expr("cum_cur / cur_n"))
        .withColumn("rank", F.expr("least(greatest(ceil(level * ref_n), 1), ref_n)"))
    )
    crossed = level_crossings(steps, reference)
    gap = "greatest(abs(upto / ref_n - level), abs(below / ref_n - (cum_cur - n_cur) / cur_n))"
    # Up to the crossing the level lies above the reference's share, from there on below it.
    inner = """level * (at - value) - (at_integral - integral)
        + (end_integral - at_integral) - level * (end - at)"""
    first = "if(cum_cur = n_cur, integral, 0D)"
    summed = crossed.groupBy("window_end", "feature").agg(
        F.expr(f"max({gap})").alias("ks_statistic"),
        F.expr(f"sum(greatest({inner}, 0D) + {first})").alias("wasserstein"),
        *[F.expr(f"first({c})").alias(c) for c in ("ref_n", "cur_n")],
        F.expr("first(one_ref AND one_value)").alias("constant"),
    )
    p = ks_p_value("ks_statistic", "ref_n", "cur_n", p_mode)
    settled = F.expr("CASE WHEN constant THEN if(ks_statistic > 0, 0D, 1D) END")
    return summed.select(
        "window_end", "feature", "ks_statistic", F.coalesce(settled, p).alias("ks_p_value"), "wasserstein"
    )


def reference_table(counts: DataFrame) -> DataFrame:
    """Per feature and value of either side: reference values below and up to it, and the integral of the
    reference's share up to it, with the feature's reference size, limits and the integral at its end."""
    cdf = running_counts(value_sums(counts), keep_cell=True).where("ref_n > 0")
    area = F.expr("cum_ref / ref_n * (coalesce(next_value, value) - value)")
    summed = running_sum(cdf, area, "integral")
    ends = summed.where("value = ref_hi").select("feature", F.col("integral").alias("hi_integral"))
    # One row per feature column.
    return summed.join(F.broadcast(ends), "feature").selectExpr(
        "feature", "value", "n_ref", "cum_ref - n_ref AS below", "cum_ref AS upto", "integral",
        "ref_n", "ref_lo", "ref_hi", "hi_integral",
    )


def value_sums(counts: DataFrame) -> DataFrame:
    return counts.groupBy("feature", "value").agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"))


# Equal parts that the reference's ranks are cut into for looking up levels.
RANK_CELLS = 4096


def level_crossings(steps: DataFrame, reference: DataFrame) -> DataFrame:
    """Add ``at`` and ``at_integral``: where the reference reaches each step's rank, kept inside the step.

    Steps and reference values meet in cells of ranks; a reference value is in every cell that its ranks
    touch, so the first one at or after a step's rank is always in the step's own cell.
    """
    cell = f"cast(floor((%s) * {RANK_CELLS}.0D / ref_n) AS int)"
    touched = F.expr(f"explode(sequence({cell % 'below'}, {cell % '(upto - 1)'}))")
    values = reference.where("n_ref > 0").select(
        "feature", touched.alias("cell"), F.col("upto").alias("pos"), F.lit(1).alias("kind"),
        F.struct("value", "integral").alias("found"),
    )
    asked = steps.withColumn("cell", F.expr(cell % "(rank - 1)")).withColumnRenamed("rank", "pos").withColumn("kind", F.lit(0))
    order = W.partitionBy("feature", "cell").orderBy("pos", "kind").rowsBetween(0, W.unboundedFollowing)
    both = asked.unionByName(values, True)
    looked_up = both.withColumn("reached", F.first("found", ignorenulls=True).over(order)).where("kind = 0")
    at = F.least(F.greatest("reached.value", "value"), "end")
    integral = (
        F.when(F.col("reached.value") <= F.col("value"), F.col("integral"))
        .when(F.col("reached.value") >= F.col("end"), F.col("end_integral"))
        .otherwise(F.col("reached.integral"))
    )
    return looked_up.withColumn("at", at).withColumn("at_integral", integral).drop("reached", "found", "cell")


# Bands of the integration check as (upper limit, exclusive; label).
BANDS = {
    "psi": ((0.1, "NO SIGNIFICANT DRIFT"), (0.2, "MODERATE DRIFT"), (None, "SIGNIFICANT DRIFT")),
    "ks": ((0.001, "DRIFT DETECTED"), (0.05, "POSSIBLE DRIFT"), (None, "NO DRIFT")),
    "js": ((0.1, "LOW"), (0.3, "MODERATE"), (None, "HIGH")),
}
# Wasserstein limits per feature in its own unit (moderate, large).
WASSERSTEIN_LIMITS = {
    "temperature_2m": (3.0, 10.0),
    "relative_humidity_2m": (5.0, 10.0),
    "wind_speed_10m": (1.0, 3.0),
    "pressure_msl": (2.0, 5.0),
}


def band(value: Column, bands: Sequence[tuple[float | None, str]]) -> Column:
    """Label of the first band whose upper limit exceeds the value."""
    expr = F
    for upper, label in bands:
        expr = expr.otherwise(label) if upper is None else expr.when(value < upper, label)
    return expr


def drift_bands(
    results: DataFrame, limits: Mapping[str, tuple[float, float]] = WASSERSTEIN_LIMITS
) -> DataFrame:
    """Band labels for all four statistics; Wasserstein limits depend on the feature's unit."""
    wasserstein = F.lit("SMALL")
    for name, (moderate, large) in limits.items():
        here = F.col("feature_name") == name
        wasserstein = (
            F.when(here & (F.col("wasserstein") > large), "LARGE SHIFT")
            .when(here & (F.col("wasserstein") > moderate), "MODERATE SHIFT")
            .otherwise(wasserstein)
        )
    return results.select(
        "feature_name",
        band(F.col("psi"), BANDS["psi"]).alias("psi_band"),
        band(F.col("ks_p_value"), BANDS["ks"]).alias("ks_band"),
        band(F.col("js_divergence"), BANDS["js"]).alias("js_band"),
        wasserstein.alias("wasserstein_band"),
    )
