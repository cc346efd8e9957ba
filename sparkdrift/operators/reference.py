"""Reference profiles: what is remembered about the data a model was trained on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdrift.functions.numeric import bin_edge, bin_index
from sparkdrift.operators.distribution import (
    attach_groups,
    group_keys,
    rank_picks,
    running_counts,
    to_long,
    value_counts,
)
from sparkdrift.operators.drift import EPSILON, histogram_sums
from sparkdrift.operators.frames import exprs, null_safe_join

# Named quantiles of a profile.
NAMED_QUANTILES = {"5%": 0.05, "25%": 0.25, "75%": 0.75, "95%": 0.95}


def create_profile(
    df: DataFrame, features: Sequence[str], n_bins: int = 10, keys: Sequence[str] = ()
) -> DataFrame:
    """One row per feature: moments, quantiles, quantile-based bin edges and their counts.

    Edges are deduplicated; a constant feature gets the single bin [min, max + 1e-10]. The number of
    values below every edge comes with the quantile ranks, so the data is not binned in another pass.
    A feature without any valid value fails at run time.
    """
    group = group_keys(keys)
    long = to_long(df, features, None, keys)
    grid = [i / n_bins for i in range(n_bins + 1)]
    picked = rank_picks(long, [0.5, *NAMED_QUANTILES.values(), *grid], keys)
    stats = long.groupBy(*group).agg(
        *exprs(
            "avg(value) AS mean",
            "stddev_samp(value) AS std",
            "min(value) AS min",
            "max(value) AS max",
        )
    )
    start = 2 + len(NAMED_QUANTILES)
    labels = ", ".join(f"'{k}'" for k in NAMED_QUANTILES)
    # Repeated edges keep their first occurrence; equal edges have equal counts below them.
    cuts = (
        null_safe_join(picked, stats, group)
        .withColumnRenamed("size", "n_samples")
        .withColumn(
            "pairs",
            F.expr(
                f"zip_with(slice(quantiles, {start}, {n_bins + 1}), "
                f"slice(below, {start}, {n_bins + 1}), (e, b) -> struct(e AS edge, b AS below))"
            ),
        )
        .withColumn(
            "cuts",
            F.expr("filter(pairs, (e, i) -> i = 0 OR coalesce(get(pairs, i - 1).edge != e.edge, true))"),
        )
        .withColumn("varied", F.expr("coalesce(std > 0, false) AND size(cuts) >= 2"))
    )
    profile = cuts.selectExpr(
        *group,
        "n_samples",
        "mean",
        "std",
        "min",
        "max",
        "quantiles[0] AS median",
        f"map_from_arrays(array({labels}), slice(quantiles, 2, {len(NAMED_QUANTILES)})) AS quantiles",
        f"if(varied, cuts.edge, array(min, max + {EPSILON!r}D)) AS bin_edges",
        """if(varied, transform(slice(cuts, 1, greatest(size(cuts) - 1, 0)), (e, i) ->
             if(i = size(cuts) - 2, n_samples, get(cuts, i + 1).below) - e.below),
           array(n_samples)) AS bin_counts""",
    )
    return profile if keys else _require_all(profile, features)


def _require_all(profile: DataFrame, features: Sequence[str]) -> DataFrame:
    """Fail at run time when a requested feature has no profile; bounded by the feature list."""
    spark = profile.sparkSession
    wanted = spark.range(1).select(F.explode(F.array(*[F.lit(f) for f in features])).alias("feature"))
    joined = wanted.join(F.broadcast(profile), "feature", "left")
    message = F.concat(F.lit("no valid values in feature "), F.col("feature"))
    checked = F.when(
        F.col("n_samples").isNull(), F.raise_error(message).cast("long")
    ).otherwise(F.col("n_samples"))
    return joined.withColumn("n_samples", checked)


def reference_values(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Raw values of a reference as a folded long table ``(feature, value, cnt)``."""
    counts = value_counts(to_long(df, features, None, keys), keys)
    return counts.select(*group_keys(keys), "value", F.col("n_cur").alias("cnt"))


def profile_bins(profile: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per stored bin: ``(feature, bin, bin_lo, bin_hi, cnt)``."""
    return profile.select(
        *group_keys(keys),
        "bin_edges",
        F.posexplode("bin_counts").alias("bin", "cnt"),
    ).select(
        *group_keys(keys),
        "bin",
        F.col("bin_edges")[F.col("bin")].alias("bin_lo"),
        F.col("bin_edges")[F.col("bin") + 1].alias("bin_hi"),
        "cnt",
    )


def _mass_below(x: Column) -> Column:
    """Share of a profile's mass below ``x`` when each bin's mass is spread evenly inside it."""
    edges, counts = F.col("bin_edges"), F.col("bin_counts")
    total = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c)
    inside = F.transform(
        counts,
        lambda c, i: c
        * F.least(
            F.greatest((x - edges[i]) / (edges[i + 1] - edges[i]), F.lit(0.0)), F.lit(1.0)
        ),
    )
    return F.aggregate(inside, F.lit(0.0), lambda a, c: a + c) / total


def profile_only_tests(
    profile: DataFrame, current_long: DataFrame, bins: int = 10, keys: Sequence[str] = ()
) -> DataFrame:
    """All four statistics against a profile that kept no raw values.

    The profile acts as a piecewise linear CDF. PSI and JS integrate it over the equal-width bins of
    the combined range; KS and Wasserstein compare it with the current CDF at every current value and
    stored edge, exactly and without sampling. Also returns ``cur_n``. The profile is read several
    times, so it should come from a store rather than from a long plan.
    """
    group = group_keys(keys)
    counts = value_counts(current_long, keys)
    stored = profile.select(*group, "bin_edges", "bin_counts")
    first_edge, last_edge = F.col("bin_edges")[0], F.element_at("bin_edges", -1)
    limits = null_safe_join(
        counts.groupBy(*group).agg(
            F.sum("n_cur").alias("cur_n"), F.min("value").alias("lo"), F.max("value").alias("hi")
        ),
        stored,
        group,
    ).withColumns(
        {"lo": F.least("lo", first_edge), "hi": F.greatest("hi", last_edge)}
    )
    # Bin counts become one array per group, so empty bins need no grid to be joined to.
    slots = [F.sum(F.when(F.col("bin") == i, F.col("n_cur")).otherwise(0)) for i in range(bins)]
    placed = attach_groups(counts, limits, keys).withColumn(
        "bin", bin_index(F.col("value"), F.col("lo"), F.col("hi"), bins)
    )
    filled = placed.groupBy(*group).agg(
        F.array(*slots).alias("slots"),
        *[F.first(c).alias(c) for c in ("cur_n", "lo", "hi", "bin_edges", "bin_counts")],
    )

    def mass_in(i: int) -> Column:
        lo, hi = F.col("lo"), F.col("hi")
        upper = F.lit(1.0) if i == bins - 1 else _mass_below(bin_edge(F.lit(i + 1), lo, hi, bins))
        lower = F.lit(0.0) if i == 0 else _mass_below(bin_edge(F.lit(i), lo, hi, bins))
        return upper - lower

    spread = filled.select(
        *group,
        "cur_n",
        F.inline(
            F.arrays_zip(
                F.array(*[mass_in(i) for i in range(bins)]).alias("p"), F.col("slots").alias("n")
            )
        ),
    )
    histogram = spread.groupBy(*group, "cur_n").agg(
        *histogram_sums("p", "n / cur_n", f"{float(bins)}D")
    )

    edge_rows = stored.select(
        *group,
        F.explode("bin_edges").alias("value"),
        F.lit(0).cast("long").alias("n_ref"),
        F.lit(0).cast("long").alias("n_cur"),
    )
    points = value_counts(current_long.unionByName(edge_rows), keys)
    walked = attach_groups(running_counts(points, keys), stored, keys)
    here, after = _mass_below(F.col("value")), _mass_below(F.col("next_value"))
    at = F.col("cum_cur") / F.col("cur_n")
    before = (F.col("cum_cur") - F.col("n_cur")) / F.col("cur_n")
    a, b = F.col("gap_here"), F.col("gap_next")
    width = F.col("next_value") - F.col("value")
    # Area between a line and a step: two triangles when the sign changes on the way.
    area = F.when(a * b >= 0, (F.abs(a) + F.abs(b)) / 2).otherwise(
        (a * a + b * b) / (2 * (F.abs(a) + F.abs(b)))
    )
    cdf = (
        walked.where(F.col("cur_n") > 0)
        .select(
            *group,
            "value",
            "next_value",
            F.greatest(F.abs(here - at), F.abs(here - before)).alias("gap"),
            (here - at).alias("gap_here"),
            (after - at).alias("gap_next"),
        )
        .groupBy(*group)
        .agg(
            F.max("gap").alias("ks_statistic"),
            F.sum(F.coalesce(area * width, F.lit(0.0))).alias("wasserstein"),
        )
    )
    return null_safe_join(histogram, cdf, group)
