"""Row-based time-series operators that stay parallel inside one long series.

A plain ``Window.partitionBy(series)`` puts a whole series into one task; a table that is mostly one
series then runs on one core. Here rows are first sorted into slices of about equal numbers of rows,
whatever their times, and each row gets its position in its series from its place in the slice plus the
sizes of the slices before. Positions cut every series into chunks of equal size, and each chunk borrows
the few rows its frames need from its neighbours. Results equal the plain window exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkdrift.functions.timeparts import hours_between
from sparkdrift.operators.frames import null_safe_join, require_columns
from sparkdrift.sources.files import written

ROW, CHUNK, HOME = "__row", "__chunk", "__home"
SLICE, PLACE = "__slice", "__place"
# Chunks of a series whose totals one task accumulates.
SPAN = 1_000


@dataclass(frozen=True)
class Series:
    """How rows form ordered series.

    ``keys`` identify a series (none: the whole table is one), ``time`` and ``tie`` together order it
    without ties. ``chunk_rows`` is the number of rows one task evaluates windows over.
    """

    keys: tuple[str, ...] = ()
    time: str = "timestamp"
    tie: tuple[str, ...] = ()
    chunk_rows: int = 50_000


def slices(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows sorted into ranges, with the range's number and a place that grows in sort order.

    The ranges are cut by a sample of keys and order together, so a long series, a busy day, equal times
    and missing times are all divided by rows. The result is written to the shared folder: what is
    counted and what is read later are the same cut, also after a lost executor.
    """
    by = [*[F.col(k).asc_nulls_first() for k in keys], *order]
    cut = df.repartitionByRange(*by).sortWithinPartitions(*by)
    return written(
        cut.select("*", F.spark_partition_id().alias(SLICE), F.monotonically_increasing_id().alias(PLACE))
    )


def number_rows(df: DataFrame, series: Series) -> DataFrame:
    """Add the 0-based position of every row in its series; rows without a time come last."""
    require_columns(df, [*series.keys, series.time, *series.tie])
    if ROW in df.columns:
        return df
    order = [F.col(c).asc_nulls_last() for c in (series.time, *series.tie)]
    cut = slices(df, series.keys, order)
    cell = [*series.keys, SLICE]
    earlier = W.partitionBy(*series.keys).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    # A slice's rows of one series lie side by side, so their places are consecutive.
    offsets = (
        cut.groupBy(*cell)
        .agg(F.count(F.lit(1)).alias("__size"), F.min(PLACE).alias("__first"))
        .select(*cell, (F.coalesce(F.sum("__size").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift"))
    )
    return (
        null_safe_join(cut, offsets, cell)
        .withColumn(ROW, F.col(PLACE) + F.col("__shift"))
        .drop(SLICE, PLACE, "__shift")
    )


def _chunk_size(series: Series, reach: int) -> int:
    return max(series.chunk_rows, reach + 1, 1)


def in_chunks(df: DataFrame, series: Series, before: int, after: int) -> DataFrame:
    """Numbered rows with their chunk, plus borrowed copies from the neighbouring chunks."""
    size = _chunk_size(series, max(before, after))
    place = F.col(ROW) % size
    own = (F.col(ROW) / size).cast("long")
    homes = [F.struct(own.alias("chunk"), F.lit(True).alias("home"))]
    if before:
        homes.append(
            F.when(place >= size - before, F.struct((own + 1).alias("chunk"), F.lit(False).alias("home")))
        )
    if after:
        homes.append(
            F.when(
                (place < after) & (own > 0),
                F.struct((own - 1).alias("chunk"), F.lit(False).alias("home")),
            )
        )
    numbered = number_rows(df, series)
    if not before and not after:
        return numbered.withColumn(CHUNK, own).withColumn(HOME, F.lit(True))
    return (
        numbered.withColumn("__copy", F.explode(F.array_compact(F.array(*homes))))
        .withColumn(CHUNK, F.col("__copy.chunk"))
        .withColumn(HOME, F.col("__copy.home"))
        .drop("__copy")
    )


def chunk_window(series: Series) -> WindowSpec:
    return W.partitionBy(*series.keys, CHUNK).orderBy(ROW)


def over_series(
    df: DataFrame,
    series: Series,
    build: Callable[[WindowSpec], Mapping[str, Column]],
    before: int = 0,
    after: int = 0,
    keep_position: bool = False,
) -> DataFrame:
    """Add window columns whose frames reach at most ``before`` / ``after`` rows.

    All columns share one window specification: one exchange, one sort.
    """
    rows = in_chunks(df, series, before, after)
    added = build(chunk_window(series))
    computed = rows.select("*", *[c.alias(name) for name, c in added.items()])
    # A recomputed column replaces the one of the same name.
    kept = [c for c in df.columns if c not in added and c != ROW]
    position = [ROW] if keep_position else []
    return computed.where(HOME).select(*kept, *position, *added)


def lag_columns(w: WindowSpec, columns: Sequence[str], lags: Sequence[int]) -> dict[str, Column]:
    return {f"{c}_lag_{n}h": F.lag(c, n).over(w) for c in columns for n in lags}


def rolling_columns(
    w: WindowSpec, columns: Sequence[str], windows: Sequence[int]
) -> dict[str, Column]:
    """Trailing rows including the current one; deviation needs two values."""
    added = {}
    for c in columns:
        for size in windows:
            frame = w.rowsBetween(-(size - 1), 0)
            added[f"{c}_rolling_mean_{size}h"] = F.avg(c).over(frame)
            added[f"{c}_rolling_std_{size}h"] = F.stddev_samp(c).over(frame)
            added[f"{c}_rolling_min_{size}h"] = F.min(c).over(frame)
            added[f"{c}_rolling_max_{size}h"] = F.max(c).over(frame)
    return added


def add_lags(
    df: DataFrame, columns: Sequence[str], series: Series, lags: Sequence[int] = (1, 6, 24)
) -> DataFrame:
    return over_series(df, series, lambda w: lag_columns(w, columns, lags), before=max(lags))


def add_rolling(
    df: DataFrame, columns: Sequence[str], series: Series, windows: Sequence[int] = (6, 24)
) -> DataFrame:
    return over_series(
        df, series, lambda w: rolling_columns(w, columns, windows), before=max(windows) - 1
    )


def add_lags_and_rolling(
    df: DataFrame,
    series: Series,
    columns: Sequence[str],
    lags: Sequence[int],
    rolling: Sequence[str],
    windows: Sequence[int],
    keep_position: bool = False,
) -> DataFrame:
    """Lags and rolling statistics from one exchange and one sort."""

    def build(w: WindowSpec) -> dict[str, Column]:
        return lag_columns(w, columns, lags) | rolling_columns(w, rolling, windows)

    reach = max([*lags, *[size - 1 for size in windows], 0])
    return over_series(df, series, build, before=reach, keep_position=keep_position)


def future_max(
    df: DataFrame,
    column: str,
    series: Series,
    horizon: int = 24,
    target: str = "target",
    min_rows: int | None = None,
    drop_incomplete: bool = True,
) -> DataFrame:
    """Maximum over the next ``horizon`` rows, the current one excluded.

    At least ``min_rows`` rows (half the horizon by default) must follow. Rows without a target are
    dropped unless ``drop_incomplete`` is off.
    """
    needed = horizon // 2 if min_rows is None else min_rows

    def build(w: WindowSpec) -> dict[str, Column]:
        frame = w.rowsBetween(1, horizon)
        enough = F.count(F.lit(1)).over(frame) >= needed
        return {target: F.when(enough, F.max(column).over(frame))}

    out = over_series(df, series, build, after=horizon)
    return out.where(F.col(target).isNotNull()) if drop_incomplete else out


def future_max_lenient(
    df: DataFrame,
    column: str,
    series: Series,
    horizon: int = 24,
    target: str = "next_day_max_temp",
) -> DataFrame:
    """One following row is enough, and rows without a target stay with NULL."""
    return future_max(df, column, series, horizon, target, min_rows=1, drop_incomplete=False)


def carried_values(known: DataFrame, keys: Sequence[str], cell: str, columns: Sequence[str]) -> DataFrame:
    """``__carry_<column>`` per cell: the last value known in earlier cells of the series.

    ``known`` has ``__last_<column>`` per cell. Two levels, cells inside a span and then the spans of a
    series, so that no task walks all cells.
    """
    spanned = known.withColumn("__span", F.floor(F.col(cell) / SPAN))
    before = W.partitionBy(*keys, "__span").orderBy(cell).rowsBetween(W.unboundedPreceding, -1)
    in_span = spanned.select(
        *keys,
        cell,
        "__span",
        *[F.last(f"__last_{c}", ignorenulls=True).over(before).alias(f"__near_{c}") for c in columns],
    )
    per_span = spanned.groupBy(*keys, "__span").agg(
        *[
            F.max_by(f"__last_{c}", F.when(F.col(f"__last_{c}").isNotNull(), F.col(cell))).alias(f"__last_{c}")
            for c in columns
        ]
    )
    spans = W.partitionBy(*keys).orderBy("__span").rowsBetween(W.unboundedPreceding, -1)
    far = per_span.select(
        *keys,
        "__span",
        *[F.last(f"__last_{c}", ignorenulls=True).over(spans).alias(f"__far_{c}") for c in columns],
    )
    return null_safe_join(in_span, far, [*keys, "__span"]).select(
        *keys, cell, *[F.coalesce(f"__near_{c}", f"__far_{c}").alias(f"__carry_{c}") for c in columns]
    )


def last_known(rows: DataFrame, keys: Sequence[str], cell: str, columns: Sequence[str]) -> DataFrame:
    """``__last_<column>`` per cell: the value of the last row that has one."""
    return rows.groupBy(*keys, cell).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ROW))).alias(f"__last_{c}") for c in columns]
    )


@dataclass(frozen=True)
class Target:
    """Maximum of ``source`` over the next ``horizon`` rows, of which ``min_rows`` must exist (half of them)."""

    source: str
    name: str
    horizon: int = 24
    min_rows: int | None = None


def filled_features(
    df: DataFrame,
    series: Series,
    columns: Sequence[str],
    lags: Sequence[int],
    rolling: Sequence[str],
    windows: Sequence[int],
    fillable: Callable[[DataFrame], Sequence[str]],
    target: Target | None = None,
    keep_position: bool = False,
) -> DataFrame:
    """Lags and rolling statistics of the unfilled columns, forward fill, and a target on the filled column,
    from one cut of the rows into chunks.

    The same as adding lags, filling and looking ahead one after another, but a chunk borrows its neighbours'
    rows once, for all of it. Each chunk starts with one more row that holds the last values known before
    the rows it borrows; filling is local then. A filled lag is the lag of the filled column. Where a whole
    rolling frame is missing, the last mean, minimum and maximum were those of the last value alone, so the
    filled column stands in; missing deviations are 0. ``fillable`` names the columns of the widened frame
    that are filled; rows without a target are dropped.
    """
    reach = max([*lags, *[size - 1 for size in windows], 0])
    after = target.horizon if target else 0
    size = _chunk_size(series, max(reach, after))
    numbered = number_rows(df, series)
    rows = in_chunks(numbered, series, reach, after)
    w = chunk_window(series)
    raw = lag_columns(w, columns, lags) | rolling_columns(w, rolling, windows)
    base = [c for c in df.columns if c not in raw and c != ROW]
    filled = set(fillable(rows.select(*base, *[c.alias(n) for n, c in raw.items()])))
    sources = list(dict.fromkeys([*[c for c in base if c in filled], *columns, *rolling]))
    cell = "__cell"
    shifted = numbered.withColumn(cell, F.floor((F.col(ROW) + reach) / size).cast("long"))
    carried = carried_values(last_known(shifted, series.keys, cell, sources), series.keys, cell, sources)
    starts = carried.where(F.col(cell) > 0).select(
        *series.keys,
        F.col(cell).alias(CHUNK),
        F.lit(-1).cast("long").alias(ROW),
        F.lit(False).alias(HOME),
        *[F.col(f"__carry_{c}").alias(c) for c in sources if c not in series.keys],
    )
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    known = [F.last(c, ignorenulls=True).over(so_far).alias(f"__fill_{c}") for c in sources]
    # Both steps use the same window: one exchange and one sort for all of them.
    first = rows.unionByName(starts, True).select("*", *known, *[c.alias(f"__raw_{n}") for n, c in raw.items()])
    out: dict[str, Column] = {c: F.col(f"__fill_{c}") if c in filled else F.col(c) for c in base}
    source_of = {f"{c}_lag_{n}h": F.lag(f"__fill_{c}", n).over(w) for c in columns for n in lags}
    for name in raw:
        value = F.col(f"__raw_{name}")
        if name not in filled:
            out[name] = value
        elif name in source_of:
            out[name] = source_of[name]
        elif "_rolling_std_" in name:
            out[name] = F.coalesce(value, F.lit(0.0))
        else:
            out[name] = F.coalesce(value, F.col(f"__fill_{name[: name.rindex('_rolling_')]}"))
    if target:
        ahead = w.rowsBetween(1, target.horizon)
        needed = target.horizon // 2 if target.min_rows is None else target.min_rows
        looked = f"__fill_{target.source}" if target.source in filled else target.source
        out[target.name] = F.when(F.count(F.lit(1)).over(ahead) >= needed, F.max(looked).over(ahead))
    position = [F.col(ROW)] if keep_position else []
    done = first.select(HOME, *[c.alias(n) for n, c in out.items()], *position).where(HOME).drop(HOME)
    return done.where(F.col(target.name).isNotNull()) if target else done


def forward_fill(
    df: DataFrame, columns: Sequence[str], series: Series, keep_position: bool = False
) -> DataFrame:
    """Replace NULL by the last earlier value of the series.

    Chunks are filled on their own; the last value of every chunk travels to later chunks through a
    small table with one row per chunk.
    """
    rows = in_chunks(df, series, 0, 0)
    w = chunk_window(series).rowsBetween(W.unboundedPreceding, 0)
    cell = [*series.keys, CHUNK]
    span = F.floor(F.col(CHUNK) / SPAN).alias("__span")
    carried = carried_values(last_known(rows, series.keys, CHUNK, columns), series.keys, CHUNK, columns)
    local = rows.select(
        *[c for c in rows.columns if c not in columns],
        *[F.last(c, ignorenulls=True).over(w).alias(c) for c in columns],
    )
    joined = null_safe_join(local, carried, cell)
    position = [ROW] if keep_position else []
    return joined.select(
        *[
            F.coalesce(F.col(c), F.col(f"__carry_{c}")).alias(c) if c in columns else F.col(c)
            for c in df.columns
            if c != ROW
        ],
        *position,
    )


def fill_features(
    df: DataFrame, columns: Sequence[str], series: Series, keep_position: bool = False
) -> DataFrame:
    """Missing rolling deviations become 0, everything else is filled forward."""
    zeroed = df.select(
        *[
            F.coalesce(F.col(c), F.lit(0.0)).alias(c)
            if c in columns and "_rolling_std_" in c
            else F.col(c)
            for c in df.columns
        ]
    )
    return forward_fill(zeroed, columns, series, keep_position)


def time_gaps(
    df: DataFrame,
    series: Series,
    max_gap_hours: float = 2.0,
    groups: Sequence[str] = (),
) -> DataFrame:
    """Intervals, gaps above the limit and the largest interval, per group (or one row).

    Equal times are folded first; they add intervals of length 0. Differences inside a slice come from a
    window over that slice; the step from one slice to the next from the slices' first and last times.
    ``groups`` must be a subset of the series keys or empty.
    """
    t = series.time
    cell = [*series.keys, SLICE]
    folded = (
        df.where(F.col(t).isNotNull())
        .groupBy(*series.keys, F.col(t).alias("__t"))
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    cut = slices(folded, series.keys, [F.col("__t").asc()])
    inside = W.partitionBy(*cell).orderBy("__t")
    stepped = cut.withColumn("__step", hours_between(F.col("__t"), F.lag("__t").over(inside)))
    per_bucket = stepped.groupBy(*cell).agg(
        F.sum("__n").alias("rows"),
        F.max("__n").alias("most"),
        F.min("__t").alias("first_t"),
        F.max("__t").alias("last_t"),
        F.count_if(F.col("__step") > max_gap_hours).alias("gaps"),
        F.max("__step").alias("longest"),
    )
    order = W.partitionBy(*series.keys).orderBy(SLICE)
    bridged = per_bucket.withColumn(
        "__bridge", hours_between(F.col("first_t"), F.lag("last_t").over(order))
    )
    per_series = bridged.groupBy(*series.keys).agg(
        F.sum("rows").alias("rows"),
        (F.sum("gaps") + F.count_if(F.col("__bridge") > max_gap_hours)).alias("gaps"),
        F.greatest(
            F.max("longest"), F.max("__bridge"), F.when(F.max("most") > 1, F.lit(0.0))
        ).alias("longest"),
    )
    return per_series.groupBy(*groups).agg(
        F.coalesce(F.sum(F.greatest(F.col("rows") - 1, F.lit(0))), F.lit(0)).alias("total_intervals"),
        F.coalesce(F.sum("gaps"), F.lit(0)).alias("gaps_found"),
        F.max("longest").alias("max_gap_hours"),
    )


def densify_hourly(
    df: DataFrame, series: Series, measures: Sequence[str], time_unit: str = "hour"
) -> DataFrame:
    """Complete every series to one row per hour between its first and last time.

    Hours are unfolded in two steps, days first, so that no row ever holds a whole series as an array.
    Missing hours carry NULL measures.
    """
    t = series.time
    span = df.groupBy(*series.keys).agg(
        F.min(F.date_trunc(time_unit, t)).alias("__first"),
        F.max(F.date_trunc(time_unit, t)).alias("__last"),
    )
    one_day, one_hour = F.expr("INTERVAL 1 DAY"), F.expr("INTERVAL 1 HOUR")
    days = span.select(
        *series.keys,
        "__first",
        "__last",
        F.explode(
            F.sequence(F.date_trunc("day", "__first"), F.date_trunc("day", "__last"), one_day)
        ).alias("__day"),
    )
    grid = (
        days.withColumn(
            t,
            F.explode(
                F.sequence(F.col("__day"), F.col("__day") + F.expr("INTERVAL 23 HOURS"), one_hour)
            ),
        )
        .where(F.col(t).between(F.col("__first"), F.col("__last")))
        .select(*series.keys, F.col(t).cast(df.schema[t].dataType).alias(t))
    )
    return null_safe_join(grid, df.select(*series.keys, t, *measures), [*series.keys, t], "left")
