"""Data quality: ranges, nulls, gaps, outliers and one score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdrift.config import ColumnSpec, QualityConfig
from sparkdrift.functions.numeric import clean_double, safe_ratio
from sparkdrift.operators.distribution import (
    attach_groups,
    exact_quantiles,
    group_keys,
    to_long,
)
from sparkdrift.operators.frames import null_safe_join
from sparkdrift.operators.windows import Series, time_gaps


def missing_columns(df: DataFrame, config: QualityConfig = QualityConfig()) -> list[str]:
    return sorted({config.time_column, *config.columns} - set(df.columns))


def type_issues(df: DataFrame, config: QualityConfig = QualityConfig()) -> list[str]:
    """Schema check, no job."""
    issues = []
    types = {f.name: f.dataType for f in df.schema}
    time_type = types.get(config.time_column)
    if time_type is not None and not isinstance(time_type, (T.TimestampType, T.TimestampNTZType)):
        issues.append(f"'{config.time_column}' column is not datetime type")
    for name in config.columns:
        if name in types and not isinstance(types[name], T.NumericType):
            issues.append(f"'{name}' column is not numeric type")
    return issues


def _measure(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, T.NumericType):
        return clean_double(F.col(name))
    return F.col(name).try_cast("double")


def _present(df: DataFrame, specs: Sequence[ColumnSpec]) -> list[ColumnSpec]:
    return [s for s in specs if s.name in df.columns]


def _out_of_range(df: DataFrame, spec: ColumnSpec) -> Column:
    c = _measure(df, spec.name)
    return F.coalesce((c < spec.lower) | (c > spec.upper), F.lit(False))


def _is_null(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.col(name).isNull() | F.isnan(name)
    return F.col(name).isNull()


def scan_once(
    df: DataFrame, config: QualityConfig = QualityConfig(), keys: Sequence[str] = ()
) -> DataFrame:
    """Every count the checks need, from one aggregation pass over the raw rows."""
    specs = _present(df, config.specs)
    invalid = F.lit(False)
    for s in specs:
        invalid = invalid | _out_of_range(df, s)
    ranges = []
    for s in specs:
        c = _measure(df, s.name)
        ranges.append(
            F.struct(
                F.lit(s.name).alias("column"),
                F.min(c).alias("min"),
                F.max(c).alias("max"),
                F.lit(s.lower).alias("expected_min"),
                F.lit(s.upper).alias("expected_max"),
                F.count_if(c < s.lower).alias("below_min_count"),
                F.count_if(c > s.upper).alias("above_max_count"),
                F.count_if((c < s.lower) | (c > s.upper)).alias("out_of_range_count"),
                F.count(c).alias("valid_values"),
            )
        )
    nulls = [
        F.struct(
            F.lit(name).alias("column"),
            F.count_if(_is_null(df, name)).alias("null_count"),
            F.count(F.lit(1)).alias("total"),
        )
        for name in df.columns
        if name not in keys
    ]
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(~invalid).alias("valid_records"),
        F.array(*ranges).alias("ranges"),
        F.array(*nulls).alias("nulls"),
    )


def range_check(
    df: DataFrame, config: QualityConfig = QualityConfig(), keys: Sequence[str] = ()
) -> DataFrame:
    """One row per checked column; NULL values are not out of range."""
    return scan_once(df, config, keys).select(*keys, F.inline("ranges")).drop("valid_values")


def null_analysis(
    df: DataFrame, config: QualityConfig = QualityConfig(), keys: Sequence[str] = ()
) -> DataFrame:
    """One row per column of the frame; flagged above the configured share."""
    percent = safe_ratio(F.col("null_count") * 100, F.col("total"))
    return (
        scan_once(df, config, keys)
        .select(*keys, F.inline("nulls"))
        .select(
            *keys,
            "column",
            "null_count",
            F.round(percent, 2).alias("null_percentage"),
            (percent > config.null_issue_percent).alias("is_issue"),
        )
    )


def gap_check(
    df: DataFrame,
    config: QualityConfig = QualityConfig(),
    series_keys: Sequence[str] = (),
    keys: Sequence[str] = (),
) -> DataFrame:
    """Gaps strictly above the limit. Without series keys all rows count as one series."""
    series = Series(tuple(dict.fromkeys([*keys, *series_keys])), config.time_column)
    gaps = time_gaps(df, series, config.max_gap_hours, keys)
    return gaps.select(
        *keys,
        (F.col("total_intervals") > 0).alias("checked"),
        "total_intervals",
        "gaps_found",
        "max_gap_hours",
        F.lit(1.0).alias("expected_interval_hours"),
        F.lit(config.max_gap_hours).alias("gap_threshold_hours"),
    )


def outlier_bounds(long: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    q = F.col("quantiles")
    spread = q[1] - q[0]
    return exact_quantiles(long, [0.25, 0.75], keys).select(
        *group_keys(keys),
        (q[0] - 1.5 * spread).alias("lower"),
        (q[1] + 1.5 * spread).alias("upper"),
    )


def iqr_outliers(
    df: DataFrame, config: QualityConfig = QualityConfig(), keys: Sequence[str] = ()
) -> DataFrame:
    """Values outside the quartile fences per column; columns with fewer than 4 values report 0."""
    names = [s.name for s in _present(df, config.specs)]
    measured = df.select(*keys, *[_measure(df, n).alias(n) for n in names])
    long = to_long(measured, names, None, keys)
    fenced = attach_groups(long, outlier_bounds(long, keys), keys)
    outside = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    return fenced.groupBy(*group_keys(keys), "lower", "upper").agg(
        F.sum("n_cur").alias("n_values"),
        F.when(F.sum("n_cur") >= 4, F.sum(F.when(outside, F.col("n_cur")).otherwise(0)))
        .otherwise(0)
        .alias("outliers"),
    )


def outlier_rows(
    df: DataFrame, config: QualityConfig = QualityConfig(), keys: Sequence[str] = ()
) -> DataFrame:
    """Rows that are an outlier in at least one column, counted once each."""
    names = [s.name for s in _present(df, config.specs)]
    fences = iqr_outliers(df, config, keys).where(F.col("n_values") >= 4)
    wide = fences.groupBy(*keys).agg(
        *[
            F.struct(
                F.max(F.when(F.col("feature") == n, F.col("lower"))).alias("lower"),
                F.max(F.when(F.col("feature") == n, F.col("upper"))).alias("upper"),
            ).alias(f"__fence_{n}")
            for n in names
        ]
    )
    hit = F.lit(False)
    if keys:
        joined = null_safe_join(df, wide, list(keys))
        fence = {n: F.col(f"__fence_{n}") for n in names}
    else:
        joined = df
        row = wide.select(F.struct("*")).scalar()
        fence = {n: row[f"__fence_{n}"] for n in names}
    for n in names:
        c = _measure(df, n)
        hit = hit | F.coalesce((c < fence[n]["lower"]) | (c > fence[n]["upper"]), F.lit(False))
    return joined.groupBy(*keys).agg(F.count_if(hit).alias("outlier_rows"))


def _mean_of(items: Column, value) -> Column:
    kept = F.filter(F.transform(items, value), lambda x: x.isNotNull())
    total = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x)
    return F.coalesce(safe_ratio(total, F.size(kept)), F.lit(0.0))


def breakdown(scanned: DataFrame, gaps: DataFrame, config: QualityConfig, keys: Sequence[str] = ()) -> DataFrame:
    """Completeness, validity, consistency and the weighted score."""
    joined = null_safe_join(scanned, gaps, list(keys), "left")
    completeness = _mean_of(
        F.col("ranges"), lambda r: safe_ratio(r["valid_values"], F.col("total_records"))
    )
    validity = _mean_of(
        F.col("ranges"),
        lambda r: safe_ratio(r["valid_values"] - r["out_of_range_count"], r["valid_values"]),
    )
    # No intervals means nothing can be missing; greatest() would skip the NULL share.
    missing_share = F.coalesce(
        safe_ratio(F.col("gaps_found"), F.col("total_intervals")), F.lit(0.0)
    )
    consistency = F.greatest(1 - missing_share, F.lit(0.0))
    parts = joined.select(
        "*",
        completeness.alias("completeness"),
        validity.alias("validity"),
        consistency.alias("consistency"),
    )
    score = (
        F.col("completeness") * config.completeness_weight
        + F.col("validity") * config.validity_weight
        + F.col("consistency") * config.consistency_weight
    )
    return parts.withColumn(
        "quality_score", F.when(F.col("total_records") == 0, 0.0).otherwise(F.round(score, 4))
    )


def quality_score(
    df: DataFrame,
    config: QualityConfig = QualityConfig(),
    series_keys: Sequence[str] = (),
    keys: Sequence[str] = (),
) -> DataFrame:
    return breakdown(
        scan_once(df, config, keys), gap_check(df, config, series_keys, keys), config, keys
    ).select(*keys, "completeness", "validity", "consistency", "quality_score")


def _issues(typed: list[str], config: QualityConfig) -> Column:
    total = F.col("total_records")

    def range_issue(r: Column) -> Column:
        n = r["out_of_range_count"]
        return F.when(
            n > 0,
            F.format_string(
                "%s: %d values (%.1f%%) out of range [%s, %s]",
                r["column"],
                n,
                F.try_divide(n * F.lit(100.0), total.cast("double")),
                r["expected_min"].cast("string"),
                r["expected_max"].cast("string"),
            ),
        )

    def null_issue(r: Column) -> Column:
        share = F.try_divide(r["null_count"] * F.lit(100.0), total.cast("double"))
        return F.when(
            share > config.null_issue_percent,
            F.format_string("%s: %d null values (%.1f%%)", r["column"], r["null_count"], share),
        )

    gap_issue = F.when(
        F.col("gaps_found") > 0,
        F.format_string(
            f"Found %d time gaps > {config.max_gap_hours} hours (max gap: %.1f hours)",
            F.col("gaps_found"),
            F.col("max_gap_hours"),
        ),
    )
    return F.array_compact(
        F.concat(
            F.array(*[F.lit(i) for i in typed]).cast("array<string>"),
            F.transform("ranges", range_issue),
            F.transform("nulls", null_issue),
            F.array(gap_issue),
        )
    )


def validate(
    df: DataFrame,
    config: QualityConfig = QualityConfig(),
    series_keys: Sequence[str] = (),
    keys: Sequence[str] = (),
) -> DataFrame:
    """Full validation: one row, or one row per ``keys``.

    Missing required columns make the result invalid without looking at values; range, null and gap
    issues are reported but only the score and the types decide.
    """
    missing = missing_columns(df, config)
    if missing:
        counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_records"))
        empty = F.col("total_records") == 0
        return counted.select(
            *keys,
            F.lit(False).alias("is_valid"),
            F.lit(0.0).alias("quality_score"),
            "total_records",
            F.lit(0).cast("long").alias("valid_records"),
            F.when(empty, F.array(F.lit("DataFrame is empty")))
            .otherwise(F.array(F.lit(f"Missing required columns: {missing}")))
            .alias("issues"),
            F.lit(0).cast("long").alias("anomaly_count"),
        )
    typed = type_issues(df, config)
    graded = breakdown(
        scan_once(df, config, keys), gap_check(df, config, series_keys, keys), config, keys
    )
    outliers = (
        iqr_outliers(df, config, keys).groupBy(*keys).agg(F.sum("outliers").alias("anomaly_count"))
    )
    joined = null_safe_join(graded, outliers, list(keys), "left")
    empty = F.col("total_records") == 0
    return joined.select(
        *keys,
        (
            (F.col("quality_score") >= config.min_score)
            & (F.col("completeness") >= config.min_completeness)
            & F.lit(not typed)
            & ~empty
        ).alias("is_valid"),
        "quality_score",
        "total_records",
        "valid_records",
        F.when(empty, F.array(F.lit("DataFrame is empty")))
        .otherwise(_issues(typed, config))
        .alias("issues"),
        F.coalesce("anomaly_count", F.lit(0)).alias("anomaly_count"),
        "completeness",
        "validity",
        "consistency",
        F.col("ranges").alias("range_details"),
        F.col("nulls").alias("null_details"),
        F.struct("checked", "total_intervals", "gaps_found", "max_gap_hours").alias("temporal_details"),
    )


def flag_anomalies(
    df: DataFrame, config: QualityConfig = QualityConfig(), keys: Sequence[str] = ()
) -> DataFrame:
    """Add ``<column>_anomaly`` and ``is_anomaly``: more than N sample deviations from the mean."""
    names = [s.name for s in _present(df, config.specs)]
    moments = df.groupBy(*keys).agg(
        *[F.avg(_measure(df, n)).alias(f"__mean_{n}") for n in names],
        *[F.stddev_samp(_measure(df, n)).alias(f"__std_{n}") for n in names],
    )
    if keys:
        joined = null_safe_join(df, moments, list(keys))
        stat = F.col
    else:
        joined = df
        row = moments.select(F.struct("*")).scalar()

        def stat(name: str) -> Column:
            return row[name]

    flags = {}
    for n in names:
        std = stat(f"__std_{n}")
        z = F.abs(F.try_divide(_measure(df, n) - stat(f"__mean_{n}"), std))
        flags[f"{n}_anomaly"] = F.coalesce((std > 0) & (z > config.z_threshold), F.lit(False))
    flagged = joined.select(*df.columns, *[c.alias(n) for n, c in flags.items()])
    any_flag = F.lit(False)
    for n in flags:
        any_flag = any_flag | F.col(n)
    return flagged.withColumn("is_anomaly", any_flag)


def column_stats(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean, sample deviation, range and NULL count per column, from one pass."""
    stats = []
    for name in columns:
        c = _measure(df, name)
        stats.append(
            F.struct(
                F.lit(name).alias("column"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).alias("min"),
                F.max(c).alias("max"),
                F.count_if(c.isNull()).alias("null_count"),
                F.count(F.lit(1)).alias("record_count"),
            )
        )
    return df.groupBy(*keys).agg(F.array(*stats).alias("stats")).select(*keys, F.inline("stats"))


def dataset_summary(df: DataFrame, time_column: str, location_column: str | None = None) -> DataFrame:
    """Record count, time range and number of locations."""
    locations = (
        F.count_distinct(location_column) if location_column else F.lit(None).cast("long")
    )
    return df.agg(
        F.count(F.lit(1)).alias("record_count"),
        F.min(time_column).alias("start"),
        F.max(time_column).alias("end"),
        locations.alias("locations"),
    )


def validation_report(result: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Readable text of validation results."""
    # Layout of the text report.
    rule = "=" * 60

    def percent(c: str) -> Column:
        return F.format_string("%.2f%%", F.col(c) * 100)

    listed = F.when(
        F.size("issues") > 0,
        F.concat(
            F.array(F.lit("Issues Found:")),
            F.transform("issues", lambda i: F.concat(F.lit("  • "), i)),
            F.array(F.lit("")),
        ),
    ).otherwise(F.array().cast("array<string>"))
    parts = F.array().cast("array<string>")
    if "completeness" in result.columns:
        parts = F.when(
            F.col("total_records") > 0,
            F.array(
                F.lit("Quality Score Breakdown:"),
                F.concat(F.lit("  • Completeness: "), percent("completeness")),
                F.concat(F.lit("  • Validity: "), percent("validity")),
                F.concat(F.lit("  • Consistency: "), percent("consistency")),
                F.lit(""),
            ),
        ).otherwise(parts)
    head = F.array(
        F.lit(rule),
        F.lit("DATA VALIDATION REPORT"),
        F.lit(rule),
        F.lit(""),
        F.when(F.col("is_valid"), "Status: ✓ VALID").otherwise("Status: ✗ INVALID"),
        F.concat(F.lit("Quality Score: "), percent("quality_score")),
        F.format_string("Total Records: %,d", F.col("total_records")),
        F.format_string("Valid Records: %,d", F.col("valid_records")),
        F.format_string("Anomalies Detected: %,d", F.col("anomaly_count")),
        F.lit(""),
    )
    return result.select(
        *keys, F.array_join(F.concat(head, listed, parts, F.array(F.lit(rule))), "\n").alias("report")
    )
