"""Two-sample tests on long frames: PSI, Jensen-Shannon, Kolmogorov-Smirnov, Wasserstein, chi-square."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkdrift.functions.ks_exact import ks_p_value
from sparkdrift.functions.numeric import bin_index, chi2_sf
from sparkdrift.operators.distribution import (
    SIZES,
    TwoSample,
    attach_groups,
    binned_counts,
    bounds,
    group_keys,
    running_counts,
    side_sums,
)
from sparkdrift.operators.frames import exprs

EPSILON = 1e-10
CATEGORY_LIMIT = 20
METHODS = ("psi", "ks", "js", "chi2", "wasserstein")
# Default decision thresholds per method.
DEFAULT_THRESHOLDS = {"psi": 0.1, "ks": 0.05, "js": 0.1, "chi2": 0.05, "wasserstein": None}


def psi_term(p: str, q: str) -> str:
    """One bin's PSI contribution as SQL text; shares are clipped, not renormalised."""
    p, q = (f"least(greatest({x}, {EPSILON!r}D), 1D)" for x in (p, q))
    return f"({q} - {p}) * ln({q} / {p})"


def js_term(p: str, q: str, n_bins: str) -> str:
    """One bin's base-2 Jensen-Shannon contribution after smoothing and renormalising."""
    p, q = (f"((greatest({x}, 0D) + {EPSILON!r}D) / (1D + {n_bins} * {EPSILON!r}D))" for x in (p, q))
    mid = f"(({p} + {q}) / 2)"
    return f"({p} * log2({p} / {mid}) + {q} * log2({q} / {mid})) / 2"


def histogram_sums(p: str, q: str, n_bins: str) -> list[Column]:
    """PSI and JS over the bins of a group; rounding noise below zero is cut off."""
    return exprs(
        f"sum({psi_term(p, q)}) AS psi", f"greatest(sum({js_term(p, q, n_bins)}), 0D) AS js_divergence"
    )


def check_sides(limits: DataFrame) -> DataFrame:
    """Fail at run time when a group has no valid value on one side."""
    message = F.concat(
        F.when(F.col("ref_n") == 0, "reference").otherwise("current"),
        F.lit(" sample is empty or holds only missing values: "),
        F.col("feature"),
    )
    empty = (F.col("ref_n") == 0) | (F.col("cur_n") == 0)
    guarded = F.when(empty, F.raise_error(message).cast("long")).otherwise(F.col("ref_n"))
    return limits.withColumn("ref_n", guarded)


def histogram_tests(
    counts: DataFrame, limits: DataFrame, bins: int = 10, keys: Sequence[str] = ()
) -> DataFrame:
    """PSI and Jensen-Shannon divergence from one shared histogram.

    Bins that are empty on both sides contribute nothing to either sum, so only occupied bins are
    shuffled; their smoothing mass enters JS through the known number of bins.
    """
    group = group_keys(keys)
    # 0: ordinary, 1: both sides hold one and the same value, 2: both constant but different.
    kind = F.expr("CASE WHEN lo = hi THEN 1 WHEN ref_lo = ref_hi AND cur_lo = cur_hi THEN 2 ELSE 0 END")
    binned = binned_counts(
        counts, limits.withColumn("kind", kind), bins, keys, ["ref_n", "cur_n", "kind"]
    )
    summed = binned.groupBy(*group).agg(
        *histogram_sums("n_ref / ref_n", "n_cur / cur_n", f"if(kind = 1, 1D, {float(bins)}D)"),
        F.max("kind").alias("kind"),
    )
    return summed.selectExpr(
        *group,
        "CASE kind WHEN 1 THEN 0D WHEN 2 THEN double('Infinity') ELSE psi END AS psi",
        "CASE kind WHEN 1 THEN 0D WHEN 2 THEN 1D ELSE js_divergence END AS js_divergence",
    )


def cdf_tests(
    counts: DataFrame, keys: Sequence[str] = (), p_mode: str = "asymptotic", strict: bool = False
) -> DataFrame:
    """KS statistic and p-value, and the Wasserstein-1 distance, from one shared CDF.

    ``counts`` must be folded. Groups with an empty side fail when ``strict``, else are left out.
    """
    group = group_keys(keys)
    cdf = running_counts(counts, keys)
    cdf = check_sides(cdf) if strict else cdf.where((F.col("ref_n") > 0) & (F.col("cur_n") > 0))
    gap = "abs(cum_ref / ref_n - cum_cur / cur_n)"
    summed = cdf.groupBy(*group).agg(
        *exprs(
            f"max({gap}) AS ks_statistic",
            f"sum({gap} * coalesce(next_value - value, 0D)) AS wasserstein",
            "first(ref_n) AS ref_n",
            "first(cur_n) AS cur_n",
            "first(ref_lo = ref_hi AND cur_lo = cur_hi) AS constant",
        )
    )
    p = ks_p_value("ks_statistic", "ref_n", "cur_n", p_mode)
    settled = F.expr("CASE WHEN constant THEN if(ks_statistic > 0, 0D, 1D) END")
    return summed.select(
        *group, "ks_statistic", F.coalesce(settled, p).alias("ks_p_value"), "wasserstein"
    )


def chi_square(
    counts: DataFrame,
    bins: int | None = None,
    keys: Sequence[str] = (),
    default_bins: int = 10,
    category_limit: int = CATEGORY_LIMIT,
) -> DataFrame:
    """Chi-square test of homogeneity, one cell per category or per equal-width bin.

    Categories are used when ``bins`` is not given and both sides have at most ``category_limit`` distinct
    values; ``categorical`` tells which form ran. A limit of 0 always bins. With one degree of freedom the
    continuity correction applies. ``counts`` must be folded.
    """
    group = group_keys(keys)
    distinct = (
        F.count_if(F.col("n_ref") > 0).alias("ref_distinct"),
        F.count_if(F.col("n_cur") > 0).alias("cur_distinct"),
    )
    limits = check_sides(bounds(counts, keys, distinct))
    categorical = F.lit(bins is None) & (
        F.greatest("ref_distinct", "cur_distinct") <= category_limit
    )
    bin_of = bin_index(F.col("value"), F.col("lo"), F.col("hi"), bins or default_bins)
    cells = (
        attach_groups(
            counts,
            limits.select(*group, "lo", "hi", *SIZES, categorical.alias("categorical")),
            keys,
        )
        .withColumn("cell", F.when(F.col("categorical"), F.col("value")).otherwise(bin_of))
        .groupBy(*group, "cell")
        .agg(*side_sums(), *[F.max(c).alias(c) for c in (*SIZES, "categorical")])
        .withColumn("n_cells", F.count(F.lit(1)).over(W.partitionBy(*group)))
    )
    seen = F.col("n_ref") + F.col("n_cur")
    total = F.col("ref_n") + F.col("cur_n")

    def term(observed: Column, side_total: Column) -> Column:
        expected = seen * side_total / total
        distance = F.abs(expected - observed)
        corrected = distance - F.when(
            F.col("n_cells") == 2, F.least(F.lit(0.5), distance)
        ).otherwise(F.lit(0.0))
        return corrected * corrected / expected

    summed = (
        cells.groupBy(*group, "n_cells", "categorical")
        .agg(
            F.sum(
                term(F.col("n_ref"), F.col("ref_n")) + term(F.col("n_cur"), F.col("cur_n"))
            ).alias("chi2")
        )
    )
    enough = F.col("n_cells") >= 2
    dof = F.greatest(F.col("n_cells") - 1, F.lit(1)).cast("int")
    return summed.select(
        *group,
        F.when(enough, F.col("chi2")).otherwise(0.0).alias("chi2_statistic"),
        F.when(enough, chi2_sf(F.col("chi2"), dof)).otherwise(1.0).alias("chi2_p_value"),
        F.col("n_cells"),
        F.col("categorical"),
    )


def psi(sample: TwoSample, bins: int = 10) -> DataFrame:
    """Population stability index per feature; two narrow passes, no value shuffle."""
    return _histogram(sample, bins).select(*group_keys(sample.keys), "psi")


def jensen_shannon(sample: TwoSample, bins: int = 10) -> DataFrame:
    return _histogram(sample, bins).select(*group_keys(sample.keys), "js_divergence")


def _histogram(sample: TwoSample, bins: int) -> DataFrame:
    return histogram_tests(sample.long(), check_sides(sample.limits()), bins, sample.keys)


def ks_test(sample: TwoSample, p_mode: str = "asymptotic") -> DataFrame:
    tests = cdf_tests(sample.counts(), sample.keys, p_mode, strict=True)
    return tests.select(*group_keys(sample.keys), "ks_statistic", "ks_p_value")


def wasserstein(sample: TwoSample) -> DataFrame:
    tests = cdf_tests(sample.counts(), sample.keys, "asymptotic", strict=True)
    return tests.select(*group_keys(sample.keys), "wasserstein")


def chi_square_test(
    sample: TwoSample, bins: int | None = None, category_limit: int = CATEGORY_LIMIT
) -> DataFrame:
    return chi_square(sample.counts(), bins, sample.keys, category_limit=category_limit)


def _interpretation(method: str) -> Column:
    s, p = F.col("statistic"), F.col("p_value")
    # Interpretation texts and their bands.
    if method == "psi":
        return (
            F.when(s < 0.1, "No significant shift")
            .when(s < 0.2, "Moderate shift - monitor closely")
            .otherwise("Significant shift - action required")
        )
    if method == "js":
        return (
            F.when(s < 0.1, "Very similar distributions")
            .when(s < 0.3, "Moderate difference")
            .otherwise("Significant difference")
        )
    if method == "wasserstein":
        return F.format_string("Distribution distance: %.4f", s)
    return F.when(p < 0.05, "Significant drift detected").otherwise("No significant drift")


def detect(
    sample: TwoSample,
    method: str = "psi",
    threshold: float | None = None,
    bins: int | None = None,
) -> DataFrame:
    """Run one named test and decide per feature; p-value methods decide below the threshold."""
    method = method.lower()
    if method not in METHODS:
        raise ValueError(f"unknown method '{method}', expected one of {', '.join(METHODS)}")
    limit = DEFAULT_THRESHOLDS[method] if threshold is None else threshold
    no_p = F.lit(None).cast("double")
    if method == "psi":
        tested, stat, p = psi(sample, bins or 10), F.col("psi"), no_p
    elif method == "js":
        tested, stat, p = jensen_shannon(sample, bins or 10), F.col("js_divergence"), no_p
    elif method == "ks":
        tested, stat, p = ks_test(sample), F.col("ks_statistic"), F.col("ks_p_value")
    elif method == "chi2":
        tested = chi_square_test(sample, bins)
        stat, p = F.col("chi2_statistic"), F.col("chi2_p_value")
    else:
        tested, stat, p = wasserstein(sample), F.col("wasserstein"), no_p
    result = tested.select(
        *group_keys(sample.keys), F.lit(method).alias("method"), stat.alias("statistic"), p.alias("p_value")
    )
    if limit is None:
        drifted = F.lit(False)
    elif method in ("ks", "chi2"):
        drifted = F.col("p_value") < limit
    else:
        drifted = F.col("statistic") >= limit
    return result.select(
        "*",
        F.lit(limit).cast("double").alias("threshold"),
        drifted.alias("drift_detected"),
        _interpretation(method).alias("interpretation"),
    )
