"""Two-sample distributions in long form: one frame for any number of features.

The long frame has the columns ``(keys..., feature, value, n_ref, n_cur)``. A raw observation carries
weight 1 on its own side and 0 on the other; ``value_counts`` folds equal values, and every consumer
accepts either form because it only sums weights. All group-wise work is partial aggregation, or a
window over (feature, cell) where the cell splits a feature's sorted values into many tasks, so one
dominant feature or value never lands in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkdrift.functions.numeric import bin_edge, bin_index, clean_double
from sparkdrift.operators.frames import exprs, null_safe_join, require_columns

SIZES = ("ref_n", "cur_n")
LIMITS = ("lo", "hi", "ref_lo", "ref_hi", "cur_lo", "cur_hi")


def to_long(
    df: DataFrame,
    features: Sequence[str],
    is_ref: Column | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Unpivot ``features`` of one frame whose rows are split by the predicate ``is_ref``.

    One scan serves both samples. NULL and NaN are dropped. Without a predicate every row counts as
    current.
    """
    require_columns(df, [*features, *keys])
    cleaned = [clean_double(F.col(quoted(f))).alias(f) for f in features]
    named = [F.col(quoted(f)) for f in features]
    if is_ref is None:
        # Constant weights are added last, so that every plan over this frame looks the same and
        # Spark can reuse its exchanges.
        long = df.select(*keys, *cleaned).unpivot(list(keys), named, "feature", "value")
        return long.where(F.col("value").isNotNull()).selectExpr(
            *keys, "feature", "value", "0L AS n_ref", "1L AS n_cur"
        )
    side = F.when(is_ref, 1).otherwise(0).cast("long").alias("n_ref")
    long = df.select(*keys, side, *cleaned).unpivot([*keys, "n_ref"], named, "feature", "value")
    return long.where(F.col("value").isNotNull()).withColumn("n_cur", F.expr("1L - n_ref"))


@dataclass(frozen=True)
class TwoSample:
    """Two samples of the same features: one frame whose rows the predicate ``is_ref`` splits.

    ``keys`` make every statistic one per key group and feature.
    """

    frame: DataFrame
    features: tuple[str, ...]
    is_ref: Column
    keys: tuple[str, ...] = ()

    @classmethod
    def split(
        cls, frame: DataFrame, features: Sequence[str], is_ref: Column, keys: Sequence[str] = ()
    ) -> TwoSample:
        require_columns(frame, [*features, *keys])
        return cls(frame, tuple(features), is_ref, tuple(keys))

    @classmethod
    def pair(
        cls,
        reference: DataFrame,
        current: DataFrame,
        features: Sequence[str],
        keys: Sequence[str] = (),
    ) -> TwoSample:
        """Two separate frames."""
        names = [*keys, *features]
        require_columns(reference, names)
        require_columns(current, names)
        both = reference.select(*names, F.lit(True).alias("__is_ref")).unionByName(
            current.select(*names, F.lit(False).alias("__is_ref"))
        )
        return cls(both, tuple(features), F.col("__is_ref"), tuple(keys))

    def long(self) -> DataFrame:
        return to_long(self.frame, self.features, self.is_ref, self.keys)

    def counts(self) -> DataFrame:
        return value_counts(self.long(), self.keys)

    def limits(self) -> DataFrame:
        """Sizes and ranges, one row per group; rows are not unfolded."""
        side = F.when(self.is_ref, True).otherwise(False).alias("__r")
        # Values go by number, so that no feature name can be read as something else.
        named = {f"__v{i}": f for i, f in enumerate(self.features)}
        values = [clean_double(F.col(quoted(f))).alias(v) for v, f in named.items()]
        narrow = self.frame.select(*self.keys, side, *values)
        ref, cur = F.col("__r"), ~F.col("__r")
        per_feature = [
            F.struct(
                F.lit(f).alias("feature"),
                F.count(F.when(ref, F.col(v))).alias("ref_n"),
                F.count(F.when(cur, F.col(v))).alias("cur_n"),
                F.min(v).alias("lo"),
                F.max(v).alias("hi"),
                F.min(F.when(ref, F.col(v))).alias("ref_lo"),
                F.max(F.when(ref, F.col(v))).alias("ref_hi"),
                F.min(F.when(cur, F.col(v))).alias("cur_lo"),
                F.max(F.when(cur, F.col(v))).alias("cur_hi"),
            )
            for v, f in named.items()
        ]
        wide = narrow.groupBy(*self.keys).agg(F.array(*per_feature).alias("items"))
        return wide.select(*self.keys, F.inline("items")).where("ref_n + cur_n > 0")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def side_sums() -> list[Column]:
    return exprs("sum(n_ref) AS n_ref", "sum(n_cur) AS n_cur")


def group_keys(keys: Sequence[str]) -> list[str]:
    return [*keys, "feature"]


def value_counts(long: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Fold equal values; map-side combining absorbs hot values."""
    return long.groupBy(*group_keys(keys), "value").agg(*side_sums())


def bounds(
    counts: DataFrame, keys: Sequence[str] = (), extra: Sequence[Column] = ()
) -> DataFrame:
    """Sizes and value ranges of both sides per group; works on raw and folded long frames."""
    return counts.groupBy(*group_keys(keys)).agg(
        *exprs(
            "sum(n_ref) AS ref_n",
            "sum(n_cur) AS cur_n",
            "min(value) AS lo",
            "max(value) AS hi",
            "min(value) FILTER (WHERE n_ref > 0) AS ref_lo",
            "max(value) FILTER (WHERE n_ref > 0) AS ref_hi",
            "min(value) FILTER (WHERE n_cur > 0) AS cur_lo",
            "max(value) FILTER (WHERE n_cur > 0) AS cur_hi",
        ),
        *extra,
    )


def attach_groups(
    long: DataFrame, per_group: DataFrame, keys: Sequence[str] = (), how: str = "inner"
) -> DataFrame:
    """Join a per-group frame to long rows.

    Without extra keys there is exactly one row per feature column, a bound known when the plan is
    built, so broadcasting is safe and saves shuffling the long side. With keys the number of groups
    follows the data, and the choice is left to the size-checked planner.
    """
    if keys:
        return null_safe_join(long, per_group, group_keys(keys), how)
    return long.join(F.broadcast(per_group), "feature", how)


def binned_counts(
    counts: DataFrame,
    limits: DataFrame,
    bins: int = 10,
    keys: Sequence[str] = (),
    carry: Sequence[str] = (),
) -> DataFrame:
    """Weights per non-empty equal-width bin over the combined range of both sides.

    ``carry`` names numeric per-group columns of ``limits`` to keep, which saves a second join.
    """
    kept = dict.fromkeys(["lo", "hi", *carry])
    return (
        attach_groups(counts, limits.select(*group_keys(keys), *kept), keys)
        .withColumn("bin", bin_index(F.col("value"), F.col("lo"), F.col("hi"), bins))
        .groupBy(*group_keys(keys), "bin")
        .agg(*side_sums(), *[F.max(c).alias(c) for c in carry])
    )


def aligned_histogram(
    counts: DataFrame, bins: int = 10, keys: Sequence[str] = (), limits: DataFrame | None = None
) -> DataFrame:
    """Dense aligned histogram with edges; empty bins are present with zero counts."""
    limits = bounds(counts, keys) if limits is None else limits
    last = F.when(F.col("hi") <= F.col("lo"), 0).otherwise(bins - 1)
    grid = limits.select(
        *group_keys(keys), "lo", "hi", F.explode(F.sequence(F.lit(0), last)).alias("bin")
    )
    filled = null_safe_join(
        grid, binned_counts(counts, limits, bins, keys), [*group_keys(keys), "bin"], "left"
    )
    lo, hi, b = F.col("lo"), F.col("hi"), F.col("bin")
    return filled.select(
        *group_keys(keys),
        "bin",
        bin_edge(b, lo, hi, bins).alias("bin_lo"),
        F.when((b == bins - 1) | (hi <= lo), hi)
        .otherwise(bin_edge(b + 1, lo, hi, bins))
        .alias("bin_hi"),
        F.coalesce("n_ref", F.lit(0)).alias("n_ref"),
        F.coalesce("n_cur", F.lit(0)).alias("n_cur"),
    )


# Quantile cuts per feature, and equal parts between two cuts: up to 65,536 cells for a feature's values.
CUTS = 256
PARTS = 256


POSITION = "__position"


def with_position(frame: DataFrame, points: str, size: int) -> DataFrame:
    """Add how many of the ascending ``points``, an array of at most ``size``, are not above the value.

    One projection per halving: each is worked out once, in generated code of its own. Conditions on what
    follows from the position must not be moved below these projections, where each halving would be written
    out again for every use of the one before: filter on aggregates of it, and join on it.
    """
    placed = frame.withColumn(POSITION, F.lit(0))
    at, step = F.col(POSITION), 1 << (size.bit_length() - 1)
    while step:
        further = F.get(F.col(points), at + (step - 1)) <= F.col("value")
        placed = placed.withColumn(POSITION, at + F.when(further, step).otherwise(0))
        step //= 2
    return placed


def with_cells(frame: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Add ``cell``, an order-preserving bucket that spreads each group's distinct values over many tasks.

    Cut points are approximate quantiles of the group's own values, so offset and spread don't matter;
    between two cuts the range is divided evenly. A value and its cell never disagree in order: only balance
    depends on the sketch.
    """
    group = group_keys(keys)
    probs = F.array(*[F.lit(i / CUTS) for i in range(CUTS + 1)])
    sketch = frame.groupBy(*group).agg(F.percentile_approx("value", probs, 10_000).alias("cuts"))
    value, cuts = F.col("value"), F.col("cuts")
    # The last cut that is not above the value; the first one for values below all of them.
    placed = with_position(attach_groups(frame, sketch, keys), "cuts", CUTS + 1).withColumn(
        "__cut", F.greatest(F.col(POSITION) - 1, F.lit(0))
    )
    low, high = F.get(cuts, F.col("__cut")), F.get(cuts, F.col("__cut") + 1)
    part = F.floor(F.try_divide(value - low, high - low) * PARTS)
    inside = F.least(F.greatest(F.coalesce(part, F.lit(0)), F.lit(0)), F.lit(PARTS - 1))
    return placed.withColumn("cell", (F.col("__cut") * PARTS + inside).cast("int")).drop("cuts", "__cut", POSITION)


def running_counts(counts: DataFrame, keys: Sequence[str] = (), keep_cell: bool = False) -> DataFrame:
    """Empirical CDF counts per distinct value, the next larger value, and the group's sizes and limits.

    ``keep_cell`` keeps the column ``cell`` for further sums along the values. A two-level prefix sum: windows run inside (group, cell); the much smaller table of cells is
    accumulated separately and added as offsets. No window spans the values of a whole feature.
    """
    group = group_keys(keys)
    names = ", ".join(f"`{k}`" for k in group)
    celled = with_cells(counts.select(*group, "value", "n_ref", "n_cur"), keys)
    earlier = f"(PARTITION BY {names} ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    whole = f"(PARTITION BY {names})"
    totals = [("ref_n", "sum"), ("cur_n", "sum")]
    totals += [(c, "min" if c.endswith("lo") else "max") for c in LIMITS]
    offsets = bounds(celled, [*keys, "cell"]).selectExpr(
        *group,
        "cell",
        f"coalesce(sum(ref_n) OVER {earlier}, 0) AS before_ref",
        f"coalesce(sum(cur_n) OVER {earlier}, 0) AS before_cur",
        f"lead(lo) OVER (PARTITION BY {names} ORDER BY cell) AS next_cell_value",
        *[f"{f}({c}) OVER {whole} AS {c}" for c, f in totals],
    )
    inside = f"PARTITION BY {names}, cell ORDER BY value"
    so_far = f"({inside} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    local = celled.selectExpr(
        *group,
        "cell",
        "value",
        "n_ref",
        "n_cur",
        f"sum(n_ref) OVER {so_far} AS in_ref",
        f"sum(n_cur) OVER {so_far} AS in_cur",
        f"lead(value) OVER ({inside}) AS next_in_cell",
    )
    return null_safe_join(local, offsets, [*group, "cell"]).selectExpr(
        *group,
        "value",
        "n_ref",
        "n_cur",
        "before_ref + in_ref AS cum_ref",
        "before_cur + in_cur AS cum_cur",
        "coalesce(next_in_cell, next_cell_value) AS next_value",
        *SIZES,
        *LIMITS,
        *(["cell"] if keep_cell else []),
    )


def running_sum(celled: DataFrame, term: Column, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Add the sum of ``term`` over all smaller values of the group: inside cells, then over whole cells."""
    group = group_keys(keys)
    inside = W.partitionBy(*group, "cell").orderBy("value").rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy(*group).orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    marked = celled.withColumn("__term", term)
    cells = marked.groupBy(*group, "cell").agg(F.sum("__term").alias("__cell_sum"))
    offsets = cells.select(*group, "cell", F.coalesce(F.sum("__cell_sum").over(earlier), F.lit(0.0)).alias("__before"))
    local = marked.withColumn(name, F.coalesce(F.sum("__term").over(inside), F.lit(0.0)))
    joined = null_safe_join(local, offsets, [*group, "cell"])
    return joined.withColumn(name, F.col(name) + F.col("__before")).drop("__before", "__term")


# Accuracy of the sketch that places brackets, half a bracket's width in ranks (four times the sketch's own
# bound), and the size up to which a group is one bracket.
ACCURACY = 20_000
HALF_WIDTH = 4 / ACCURACY
WHOLE_ROWS = 20_000


def with_brackets(weighted: DataFrame, probs: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Add ``cell`` and ``part``: where a value lies among brackets around the wanted ranks.

    A bracket runs from a little below to a little above a wanted rank, by an approximate quantile sketch.
    ``cell`` tells the end a value equals or the two ends it lies between, so it grows with the value.
    ``part`` cuts the cells inside brackets evenly by value; it is -1 outside all brackets.
    """
    wanted = sorted({float(p) for p in probs})
    ends = [e for p in wanted for e in (max(p - HALF_WIDTH, 0.0), min(p + HALF_WIDTH, 1.0))]
    found = weighted.groupBy(*group_keys(keys)).agg(
        F.percentile_approx("value", F.array(*[F.lit(e) for e in ends]), ACCURACY).alias("__found"),
        (F.count(F.lit(1)) <= WHOLE_ROWS).alias("__whole"),
    )
    pairs = F.array(*[
        F.struct(F.get("__found", F.lit(2 * i)).alias("low"), F.get("__found", F.lit(2 * i + 1)).alias("high"))
        for i in range(len(wanted))
    ])

    def inside(end: Column) -> Column:
        return F.exists(pairs, lambda pair: (pair["low"] <= end) & (end < pair["high"]))

    sorted_ends = F.array_sort(F.array_distinct("__found"))
    sketch = found.select(
        *group_keys(keys), "__whole", sorted_ends.alias("__ends"), F.transform(sorted_ends, inside).alias("__inside")
    )
    placed = with_position(attach_groups(weighted, sketch, keys), "__ends", len(ends))
    value, at = F.col("value"), F.col(POSITION)
    low, high = F.get("__ends", at - 1), F.get("__ends", at)
    between = F.coalesce(value > low, F.lit(True))
    share = F.coalesce(F.try_divide(value - low, high - low), F.lit(0.0))
    part = F.least(F.floor(share * PARTS), F.lit(PARTS - 1)).cast("int")
    held = ~between | F.coalesce(F.get("__inside", at - 1), F.lit(False))
    return (
        placed.withColumn("cell", F.when(F.col("__whole"), 0).otherwise(2 * at + between.cast("int")))
        .withColumn("part", F.when(F.col("__whole"), 0).when(held, part).otherwise(-1))
        .drop("__ends", "__inside", "__whole", POSITION)
    )


def rank_picks(
    long: DataFrame, probs: Sequence[float], keys: Sequence[str] = (), side: str = "cur"
) -> DataFrame:
    """Exact linearly interpolated quantiles and how many values lie below each.

    One row per group: ``size``, ``quantiles`` and ``below``, two arrays aligned with ``probs``. Raw and
    folded frames both do. A sketch puts a bracket around each wanted rank; one pass then counts what lies
    between brackets and folds the values inside them, and only those few are ordered, in parts. A rank
    that the sketch missed is found among all values of its gap, which are read only in that case: results
    never depend on the sketch. Neither the data nor a feature's distinct values are ever sorted as a whole
    or kept in one place.
    """
    group = group_keys(keys)
    names = ", ".join(f"`{k}`" for k in group)
    wanted = "array(" + ", ".join(f"{float(p)!r}D" for p in probs) + ")"
    ranks = (
        f"array_distinct(concat(transform({wanted}, p -> floor(p * (size - 1))), "
        f"transform({wanted}, p -> ceil(p * (size - 1)))))"
    )
    weighted = long.where(F.col(f"n_{side}") > 0).select(*group, "value", F.col(f"n_{side}").alias("n"))
    placed = with_brackets(weighted, probs, keys)
    on = [*group, "cell", "part"]
    kept = F.when(F.col("part") >= 0, F.col("value")).alias("value")
    folded = placed.select(*on, kept, "n").groupBy(*on, "value").agg(F.sum("n").alias("n"))
    earlier = f"(PARTITION BY {names} ORDER BY cell, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    holding = (
        folded.groupBy(*on)
        .agg(F.sum("n").alias("c"), (F.max("part") >= 0).alias("bracketed"))
        .selectExpr(
            *on,
            "c",
            "bracketed",
            f"coalesce(sum(c) OVER {earlier}, 0) AS before",
            f"sum(c) OVER (PARTITION BY {names}) AS size",
        )
        .where(F.expr(f"exists({ranks}, r -> r >= before AND r < before + c)"))
        .drop("c")
    )

    def held(rows: DataFrame, test: str) -> DataFrame:
        # Without keys at most two parts per wanted rank and feature, a bound known beforehand.
        few = holding.where(test).drop("bracketed")
        return null_safe_join(rows, few if keys else F.broadcast(few), on)

    missed = held(placed, "NOT bracketed").groupBy(*on, "before", "size", "value").agg(F.sum("n").alias("n"))
    near = held(folded, "bracketed").unionByName(missed)
    so_far = f"(PARTITION BY {names}, cell, part ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    found = (
        near.selectExpr(*group, "size", "value", f"before + sum(n) OVER {so_far} AS end", "n")
        .selectExpr(*group, "size", "value", "end - n AS first", "end")
        .selectExpr(
            *group, "size", "value", "first", "end",
            f"filter({ranks}, r -> r >= first AND r < end) AS hits",
        )
        .where(F.expr("size(hits) > 0"))
    )
    entry = "struct(r AS rank, struct(value AS value, first AS first, end AS end) AS at)"
    by_rank = found.groupBy(*group, "size").agg(
        F.expr(f"map_from_entries(flatten(collect_list(transform(hits, r -> {entry})))) AS at")
    )
    low, high = "at[floor(p * (size - 1))]", "at[ceil(p * (size - 1))]"
    # An interpolated quantile lies above its lower neighbour and all of that one's copies.
    looked_up = by_rank.selectExpr(
        *group,
        "size",
        f"""transform({wanted}, p -> struct({low} AS low,
            {low}.value + ({high}.value - {low}.value) * (p * (size - 1) - floor(p * (size - 1))) AS q)) AS z""",
    )
    return looked_up.selectExpr(
        *group,
        "size",
        "transform(z, e -> e.q) AS quantiles",
        "transform(z, e -> if(e.q > e.low.value, e.low.end, e.low.first)) AS below",
    )


def exact_quantiles(
    long: DataFrame, probs: Sequence[float], keys: Sequence[str] = (), side: str = "cur"
) -> DataFrame:
    """Exact linearly interpolated quantiles as one array per group."""
    return rank_picks(long, probs, keys, side).select(*group_keys(keys), "quantiles")
