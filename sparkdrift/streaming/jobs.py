"""Streaming counterparts of ingestion and drift monitoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sparkdrift.functions.numeric import clean_double
from sparkdrift.operators.drift import psi_term
from sparkdrift.operators.reference import profile_bins
from sparkdrift.sources.snapshots import SnapshotTable
from sparkdrift.sources.table import KEY, UPDATED_COLUMNS, upsert


def read_landed(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """Stream the files of a landing directory."""
    return spark.readStream.schema(schema).format(fmt).load(path)


def upsert_stream(
    rows: DataFrame,
    table_path: str,
    checkpoint: str,
    key: Sequence[str] = KEY,
    updated: Sequence[str] = UPDATED_COLUMNS,
    order: Sequence[str] = ("updated_at",),
    continuous: str | None = None,
    arrival: Sequence[str] = (),
    atomic: bool = False,
) -> StreamingQuery:
    """Upsert every micro-batch; replaying a batch after a failure gives the same table.

    ``order`` and the unstored ``arrival`` columns must put the rows of a key in one order.

    By default all available files are processed and the query stops, which suits a schedule;
    ``continuous`` gives a trigger interval instead. ``atomic`` keeps the table as snapshots, each
    micro-batch being one commit that readers see whole or not at all.
    """

    def merge(batch: DataFrame, _batch_id: int) -> None:
        if batch.isEmpty():
            return
        if atomic:
            SnapshotTable(batch.sparkSession, table_path).upsert(batch, key, updated, order, arrival)
        else:
            upsert(batch.sparkSession, table_path, batch, key, updated, order, arrival)

    writer = rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if continuous is None else {"processingTime": continuous}
    return writer.trigger(**trigger).start()


def drop_overlap(
    rows: DataFrame, key: Sequence[str], time_column: str = "timestamp", overlap: str = "1 hour"
) -> DataFrame:
    """Suppress the rows an overlapping fetch delivers twice; state is bounded by the overlap."""
    return rows.withWatermark(time_column, overlap).dropDuplicatesWithinWatermark(list(key))


def window_bin_counts(
    rows: DataFrame,
    profile: DataFrame,
    features: Sequence[str],
    time_column: str = "timestamp",
    window: str = "168 hours",
    slide: str = "1 day",
    lateness: str = "1 hour",
) -> DataFrame:
    """Counts per sliding window and stored bin of a static profile.

    Values outside the stored range fall into the first or last bin. Rows are counted once per slide;
    the overlapping windows then add up those counts, so no row is copied per window.
    """
    long = (
        rows.withWatermark(time_column, lateness)
        .select(time_column, *[clean_double(F.col(f)).alias(f) for f in features])
        .unpivot([time_column], list(features), "feature", "value")
        .where(F.col("value").isNotNull())
    )
    edges = profile.where(F.col("feature").isin(*features)).select("feature", "bin_edges")
    placed = long.join(F.broadcast(edges), "feature").select(
        time_column, "feature", stored_bin(F.col("value"), F.col("bin_edges")).alias("bin")
    )
    per_slide = placed.groupBy(F.window(time_column, slide).alias("slot"), "feature", "bin").agg(
        F.count(F.lit(1)).alias("n")
    )
    return per_slide.groupBy(F.window("slot", window, slide), "feature", "bin").agg(
        F.sum("n").alias("n_cur")
    )


def stored_bin(value: Column, edges: Column) -> Column:
    """Bin of a value in an ascending edge array, clamped to the outer bins."""
    not_above = F.aggregate(edges, F.lit(0), lambda a, e: a + F.when(e <= value, 1).otherwise(0))
    return F.least(F.greatest(not_above - 1, F.lit(0)), F.size(edges) - 2)


def window_psi(counts: DataFrame, profile: DataFrame) -> DataFrame:
    """PSI per closed window from written bin counts, for a batch or foreachBatch reader."""
    stored = profile_bins(profile).select("feature", "bin", F.col("cnt").alias("n_ref"))
    ends = counts.groupBy("window", "feature").agg(F.sum("n_cur").alias("cur_n"))
    sizes = stored.groupBy("feature").agg(F.sum("n_ref").alias("ref_n"))
    filled = (
        ends.join(stored, "feature")
        .join(counts, ["window", "feature", "bin"], "left")
        .join(sizes, "feature")
    )
    term = psi_term("n_ref / ref_n", "coalesce(n_cur, 0) / cur_n")
    return filled.groupBy("window", "feature").agg(F.expr(f"sum({term})").alias("psi"))
