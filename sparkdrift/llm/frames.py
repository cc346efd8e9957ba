"""Small helpers the corpus operators share: column names, tables in the shared folder, whole groups in
sorted batches, and blocks for groups that are too large for one task."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdrift.sources.files import shared_folder, written

__all__ = ["shared_folder"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores added until no column of the frame has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def col(name: str) -> Column:
    """A column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def stored(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read again: lineage ends there."""
    return written(df)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocked(df: DataFrame, keys: list[str], member: str, block_rows: int) -> DataFrame:
    """Deal the rows of each key to blocks of about ``block_rows`` and repeat them for pairs of blocks.

    Adds ``block_a <= block_b`` and ``own``, the row's own block. Rows of one (keys, block_a, block_b)
    together hold every pair of rows of two blocks, so a group of any size is compared without one task
    holding it whole. Keys with a single row are left out: they have no pairs. Null keys are not allowed.
    """
    frame = stored(df)
    sizes = stored(frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("in_key")).where("in_key > 1"))
    blocks = F.ceil(F.col("in_key") / block_rows).cast("int")
    return (
        frame.join(sizes, keys)
        .withColumn("blocks", blocks)
        .withColumn("own", F.pmod(F.xxhash64(F.col(member), F.lit(17)), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("block_a", F.least("own", "other"))
        .withColumn("block_b", F.greatest("own", "other"))
        .drop("other", "blocks", "in_key")
    )


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold whole groups of a stream sorted by ``keys``, with each group's first row.

    Only the last, possibly unfinished group is carried over to the next table.
    """
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rest.append(batch)
        joined = pa.Table.from_batches(rest).combine_chunks()
        starts = group_starts(joined, keys)
        if len(starts) > 1:
            cut = int(starts[-1])
            yield joined.slice(0, cut), starts[:-1]
            rest = joined.slice(cut).combine_chunks().to_batches()
    if rest:
        joined = pa.Table.from_batches(rest).combine_chunks()
        yield joined, group_starts(joined, keys)


def group_starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(rows.num_rows, dtype=bool)
    new[0] = True
    for key in keys:
        values = rows.column(key).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def map_groups(df: DataFrame, keys: list[str], run: Callable, schema: str, then: list[str] = ()) -> DataFrame:
    """``run(table, starts)`` over whole groups of ``keys``; a task sees many small groups at once.

    ``run`` yields record batches of ``schema``. Rows of a group are ordered by ``then``. Ranges of the keys,
    cut by a sample, spread a few large groups more evenly over the tasks than their hashes would.
    """

    def each(batches):
        for rows, starts in whole_groups(batches, keys):
            yield from run(rows, starts)

    return df.repartitionByRange(*keys).sortWithinPartitions(*keys, *then).mapInArrow(each, schema)


def binary_rows(column: pa.ChunkedArray | pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column as one flat array, and where each row starts (one more at the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = data[int(offsets[0]) : int(offsets[-1])] if data is not None else b""
    width = np.dtype(dtype).itemsize
    return np.frombuffer(raw, dtype=dtype), (offsets - offsets[0]) // width


def to_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )
