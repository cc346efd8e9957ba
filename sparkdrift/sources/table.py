"""The keyed observation table: a date-partitioned Parquet directory with upsert semantics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdrift.functions.numeric import clean_double
from sparkdrift.functions.timeparts import require_utc
from sparkdrift.sources.files import exists
from sparkdrift.sources.payload import reject_reason

# Key, storage columns and their decimal types.
KEY = ("latitude", "longitude", "timestamp")
STORAGE_COLUMNS = (
    "id",
    "location_name",
    "latitude",
    "longitude",
    "timestamp",
    "temperature_2m",
    "relative_humidity_2m",
    "precipitation",
    "wind_speed_10m",
    "surface_pressure",
    "raw_data",
    "batch_id",
    "data_source",
    "ingestion_timestamp",
    "created_at",
    "updated_at",
)
TEXT_COLUMNS = ("id", "location_name", "raw_data", "batch_id", "data_source")
UPDATED_COLUMNS = (
    "temperature_2m",
    "relative_humidity_2m",
    "precipitation",
    "wind_speed_10m",
    "surface_pressure",
    "raw_data",
    "updated_at",
)
DECIMALS = {
    "latitude": (9, 6),
    "longitude": (9, 6),
    "temperature_2m": (5, 2),
    "relative_humidity_2m": (5, 2),
    "precipitation": (8, 2),
    "wind_speed_10m": (6, 2),
    "wind_direction_10m": (5, 2),
    "surface_pressure": (7, 2),
    "cloud_cover": (5, 2),
}
LOCATION_KEY = ("latitude", "longitude")
DATE = "dt"
DATE_FORMAT = "%Y-%m-%d"
RECENT_DAYS = 5


class DuplicateKeyError(ValueError):
    """An append would violate the table key."""


class AmbiguousOrderError(ValueError):
    """Rows of one key arrive at the same place with different values, so none of them is the last."""


class TableTypeError(ValueError):
    """A batch has other fixed-point types than the table it goes to."""


def with_date(df: DataFrame, time_column: str = "timestamp") -> DataFrame:
    return df.withColumn(DATE, F.to_date(time_column))


def to_table_types(df: DataFrame, decimals: Mapping[str, tuple[int, int]] = DECIMALS) -> DataFrame:
    """Measures to fixed-point types; a value that does not fit fails."""
    return df.withColumns(
        {c: F.col(c).cast(T.DecimalType(*ps)) for c, ps in decimals.items() if c in df.columns}
    )


def from_table_types(df: DataFrame) -> DataFrame:
    """Fixed-point columns as doubles for computing."""
    decimals = [f.name for f in df.schema if isinstance(f.dataType, T.DecimalType)]
    return df.withColumns({c: F.col(c).cast("double") for c in decimals})


def clean_measures(df: DataFrame) -> DataFrame:
    """NaN to NULL in every floating column, once, at the door."""
    floating = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: clean_double(F.col(c)) for c in floating})


def _storage_type(column: str) -> str:
    if column in TEXT_COLUMNS:
        return "string"
    return "double" if column in DECIMALS else "timestamp"


def prepare_rows(
    df: DataFrame, batch_id: str, now: Column | None = None, arrival: Sequence[str] = ()
) -> DataFrame:
    """Rows in storage layout: all storage columns, absent ones NULL but for provenance.

    Unknown columns are dropped; the ``arrival`` ones stay for ordering an upsert.
    """
    clock = F.current_timestamp() if now is None else now
    defaults = {
        "id": F.expr("uuid()"),
        "location_name": F.lit("Unknown"),
        "batch_id": F.lit(batch_id),
        "created_at": clock,
        "updated_at": clock,
    }
    missing = [c for c in STORAGE_COLUMNS if c not in df.columns]
    filled = df.withColumns(
        {c: defaults[c] if c in defaults else F.lit(None).cast(_storage_type(c)) for c in missing}
    )
    filled = filled.withColumn("raw_data", F.when(~F.col("raw_data").isin("", "{}"), F.col("raw_data")))
    return filled.select(*STORAGE_COLUMNS, *arrival)


def scan_timerange(
    df: DataFrame,
    start: str | datetime | Column,
    end: str | datetime | Column,
    time_column: str = "timestamp",
    location: str | None = None,
    location_column: str = "location_name",
    ordered: bool = False,
) -> DataFrame:
    """Rows between two instants, both inclusive.

    Bounds become literals of the column's own type, so they reach the Parquet reader; a date
    partition column is restricted as well.
    """
    kind = df.schema[time_column].dataType
    lo, hi = (b if isinstance(b, Column) else F.lit(b).cast(kind) for b in (start, end))
    found = df.where(F.col(time_column).between(lo, hi))
    if DATE in df.columns:
        found = found.where(F.col(DATE).between(F.to_date(lo), F.to_date(hi)))
    if location is not None:
        found = found.where(F.col(location_column) == location)
    return found.orderBy(time_column) if ordered else found


def in_period(
    df: DataFrame,
    days: int,
    start: str | datetime | None = None,
    end: str | datetime | None = None,
    time_column: str = "timestamp",
    location: str | None = None,
    location_column: str = "location_name",
) -> DataFrame:
    """Rows of a period, both ends inclusive: by default the last ``days`` days up to the newest row."""
    chosen = df if location is None else df.where(F.col(location_column) == location)
    kind = df.schema[time_column].dataType
    last = chosen.agg(F.max(time_column)).scalar() if end is None else F.lit(end).cast(kind)
    first = last - F.expr(f"INTERVAL {int(days)} DAYS") if start is None else F.lit(start).cast(kind)
    return scan_timerange(chosen, first, last, time_column)


def latest_timestamp(df: DataFrame, time_column: str = "timestamp") -> DataFrame:
    return df.agg(F.max(time_column).alias("latest_timestamp"))


def record_count(
    df: DataFrame, location: str | None = None, location_column: str = "location_name"
) -> DataFrame:
    chosen = df if location is None else df.where(F.col(location_column) == location)
    return chosen.agg(F.count(F.lit(1)).alias("record_count"))


def latest_hours(
    df: DataFrame, hours: int, now: Column, time_column: str = "timestamp", until_now: bool = False
) -> DataFrame:
    """Rows of the last ``hours`` hours; rows after ``now`` stay unless ``until_now`` is set."""
    if hours <= 0:
        raise ValueError("hours must be positive")
    t = F.col(time_column)
    found = df.where(t >= now - F.expr(f"INTERVAL {int(hours)} HOURS"))
    return found.where(t <= now) if until_now else found


def latest_rows(df: DataFrame, n: int, time_column: str, tie: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.col(time_column).desc(), *tie).limit(n)


def route_source(start: Column, now: Column) -> Column:
    """Which landing area serves a range: old starts come from the archive."""
    return F.when(start < now - F.expr(f"INTERVAL {RECENT_DAYS} DAYS"), "archive").otherwise("recent")


def parse_range(start: str, end: str) -> tuple[datetime, datetime]:
    first, last = (datetime.strptime(d, DATE_FORMAT) for d in (start, end))
    if last < first:
        raise ValueError(f"end date {end} is before start date {start}")
    return first, last


def read_range(
    spark: SparkSession,
    path: str,
    start: str,
    end: str,
    key: Sequence[str] = ("location_name", DATE),
    json_column: str = "payload",
) -> DataFrame:
    """Landed payloads of a date range, from the archive and from the recent landing area.

    The landing directory is partitioned by ``source`` (archive, recent) and ``dt``; the dates prune
    directories. A range that starts long ago ends in days that landed as recent, so both areas are read,
    and recent payloads give way where the archive has a usable payload with their key.
    """
    first, last = parse_range(start, end)
    landed = spark.read.parquet(path).where(F.col(DATE).between(F.lit(first.date()), F.lit(last.date())))
    archived = landed.where(F.col("source") == "archive")
    kept = [c for c in key if c in landed.columns]
    rest = landed.where(F.col("source") != "archive")
    usable = archived.where(reject_reason(F.col(json_column)).isNull())
    return archived.unionByName(rest.join(usable.select(*kept).distinct(), kept, "left_anti"))


# Which landing area's row of an hour is the last: the archive's, whatever landed when.
SOURCE_RANK = "source_rank"


def landed_range(
    spark: SparkSession, path: str, start: str, end: str, location: Sequence[str] = LOCATION_KEY
) -> DataFrame:
    """All landed payloads of a date range from both areas, with the rank of their source.

    For merging row by row: an upsert in the order of the rank takes the archive's row of a location and
    hour where there is one and the recent one elsewhere. That needs to know the location, so a landing
    area without the ``location`` columns is refused.
    """
    first, last = parse_range(start, end)
    landed = spark.read.parquet(path)
    missing = [c for c in location if c not in landed.columns]
    if missing:
        raise ValueError(f"payloads can't be told apart by location, missing columns: {missing}")
    rank = F.when(F.col("source") == "archive", 1).otherwise(0)
    return landed.where(F.col(DATE).between(F.lit(first.date()), F.lit(last.date()))).withColumn(SOURCE_RANK, rank)


def unfit_columns(rows: DataFrame) -> Column:
    """Names of the measures whose value does not fit the table's type."""
    found = [
        F.when(F.col(c).isNotNull() & F.col(c).try_cast(T.DecimalType(*ps)).isNull(), c)
        for c, ps in DECIMALS.items()
        if c in rows.columns
    ]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def append_conflicts(existing: DataFrame | None, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that an append would duplicate, within the batch or against the table."""
    counted = incoming.groupBy(*key).agg(F.count(F.lit(1)).alias("incoming_rows"))
    inside = counted.where(F.col("incoming_rows") > 1).withColumn("in_table", F.lit(False))
    if existing is None:
        return inside
    against = counted.join(existing.select(*key), list(key), "left_semi")
    both = inside.unionByName(against.withColumn("in_table", F.lit(True)))
    return both.groupBy(*key).agg(
        F.max("incoming_rows").alias("incoming_rows"), F.max("in_table").alias("in_table")
    )


def merge_rows(
    existing: DataFrame | None,
    incoming: DataFrame,
    key: Sequence[str],
    updated: Sequence[str],
    order: Sequence[str],
    transient: Sequence[str] = (),
) -> DataFrame:
    """State after upserting ``incoming`` in ``order``: the last row wins for the updated columns, all
    other columns keep their first value. NULLs overwrite like any value.

    Both sides may lack columns of the other. An updated column the batch lacks becomes NULL in the rows
    it writes; rows it doesn't write keep everything. ``transient`` columns order rows and are not kept.
    One aggregation with map-side combining; each side's columns come from a single row.
    """
    types = {} if existing is None else {f.name: f.dataType for f in existing.schema}
    types |= {f.name: f.dataType for f in incoming.schema}
    changing = [c for c in updated if c in types]
    fixed = [c for c in types if c not in {*key, *changing, *transient}]

    def side(df: DataFrame, generation: int) -> DataFrame:
        def value(c: str) -> Column:
            return (F.col(c) if c in df.columns else F.lit(None)).cast(types[c]).alias(c)

        arrival = [value(c) if generation else F.lit(None).cast(types[c]).alias(c) for c in order]
        return df.select(
            *key,
            F.struct(F.lit(generation).alias("__generation"), *arrival).alias("__arrival"),
            F.struct(*[value(c) for c in changing]).alias("__new"),
            *([F.struct(*[value(c) for c in fixed]).alias("__old")] if fixed else []),
        )

    rows = side(incoming, 1)
    if existing is not None:
        rows = side(existing, 0).unionByName(rows)
    picks = [F.max_by("__new", "__arrival").alias("__new")]
    if fixed:
        picks.append(F.min_by("__old", "__arrival").alias("__old"))
    merged = rows.groupBy(*key).agg(*picks)
    return merged.select(
        *key,
        *[F.col(f"__new.{c}").alias(c) for c in changing],
        *[F.col(f"__old.{c}").alias(c) for c in fixed],
    )


def ambiguous_rows(
    incoming: DataFrame, key: Sequence[str], updated: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Keys with rows that ``order`` can't tell apart although their updated columns differ."""
    values = F.struct(*[c for c in updated if c in incoming.columns and c not in order])
    places = list(dict.fromkeys([*key, *order]))
    ends = incoming.groupBy(*places).agg(F.min(values).alias("low"), F.max(values).alias("high"))
    return ends.where(~F.col("low").eqNullSafe(F.col("high"))).select(*key)


def new_rows(existing: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """Incoming rows whose key the table does not hold yet."""
    return incoming.join(existing.select(*key).distinct(), list(key), "left_anti")


def retyped_columns(existing: DataFrame, incoming: DataFrame) -> list[str]:
    """Fixed-point columns that both sides have with different precision or scale."""
    stored = {f.name: f.dataType for f in existing.schema if isinstance(f.dataType, T.DecimalType)}
    return [f.name for f in incoming.schema if isinstance(f.dataType, T.DecimalType) and stored.get(f.name, f.dataType) != f.dataType]


def _write(df: DataFrame, path: str, mode: str) -> None:
    # Rebalancing by date gives few, evenly sized files and splits a date that dominates the batch.
    balanced = df.hint("rebalance", DATE)
    writer = balanced.write.mode(mode).partitionBy(DATE)
    if mode == "overwrite":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def append(spark: SparkSession, path: str, rows: DataFrame, key: Sequence[str] = KEY) -> None:
    """Append; any duplicate key fails before anything is written."""
    require_utc(spark)
    existing = spark.read.parquet(path) if exists(spark, path) else None
    dated = with_date(to_table_types(rows))
    if existing is not None:
        existing = existing.join(dated.select(DATE).distinct(), DATE, "left_semi")
    first = append_conflicts(existing, dated, key).limit(1).collect()
    if first:
        raise DuplicateKeyError(f"duplicate key {[first[0][k] for k in key]}")
    _write(dated, path, "append")


def upsert(
    spark: SparkSession,
    path: str,
    rows: DataFrame,
    key: Sequence[str] = KEY,
    updated: Sequence[str] = UPDATED_COLUMNS,
    order: Sequence[str] = ("updated_at",),
    arrival: Sequence[str] = (),
    decimals: Mapping[str, tuple[int, int]] = DECIMALS,
) -> None:
    """Merge rows into the table, rewriting only the dates they touch.

    Rows of one key are applied by ``order``, then by the ``arrival`` columns, which are not stored. Where
    that leaves rows with different values in the same place, nothing is written and the call fails: no
    partitioning decides which one is last. New partitions replace old ones when the job commits, so a
    lost executor costs a retry, not data.

    ``decimals`` are the table's fixed-point types, for tables whose measures need more digits than weather.
    Untouched dates keep their files, so every call for one table has to name the same types.
    """
    require_utc(spark)
    incoming = with_date(to_table_types(rows, decimals))
    stored = spark.read.parquet(path) if exists(spark, path) else None
    retyped = [] if stored is None else retyped_columns(stored, incoming)
    if retyped:
        raise TableTypeError(f"the table has other types for {', '.join(retyped)}")
    places = [*order, *arrival]
    present = [c for c in updated if c in incoming.columns]
    tied = ambiguous_rows(incoming, [*key, DATE], present, places).limit(1).collect()
    if tied:
        raise AmbiguousOrderError(f"no last row for key {[tied[0][k] for k in key]} by {', '.join(places)}")
    existing = None
    if stored is not None:
        # The distinct dates of the batch prune the table's partitions at run time.
        existing = stored.join(incoming.select(DATE).distinct(), DATE, "left_semi")
    merged = merge_rows(existing, incoming, [*key, DATE], updated, places, arrival)
    _write(merged, path, "overwrite")


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str,
    lower: str,
    upper: str,
    partitions: int,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """A relational table read in parallel slices of its time or id column."""
    reader = spark.read.format("jdbc").options(
        url=url,
        dbtable=table,
        partitionColumn=partition_column,
        lowerBound=lower,
        upperBound=upper,
        numPartitions=partitions,
        **(properties or {}),
    )
    return reader.load()
