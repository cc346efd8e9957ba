"""Embedding columns as flat binary rows that tasks read as one matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdrift.llm.frames import binary_rows, col


def usable_vectors(table: DataFrame, key: str, vector: str) -> tuple[DataFrame, str]:
    """(key, vec) of rows with a key and a vector that is not null, not zero and finite throughout.

    ``vec`` holds the components as they are stored, single or double precision; the second value is their
    dtype. Of rows that share a key, the vector with the smallest bytes is used.
    """
    element = table.schema[vector].dataType.elementType
    dtype = "<f4" if isinstance(element, T.FloatType) else "<f8"
    width = np.dtype(dtype).itemsize
    values = col(vector)
    good = (
        F.col("key").isNotNull()
        & values.isNotNull()
        & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
        & F.exists(values, lambda x: x != 0)
    )
    kind = "float" if dtype == "<f4" else "double"
    chosen = table.withColumn("key", col(key).cast("long")) if key != "key" else table
    chosen = chosen.where(F.coalesce(good, F.lit(False))).select("key", values.cast(f"array<{kind}>").alias("v"))

    def pack(batches):
        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.to_numpy(zero_copy_only=False).astype(dtype)
            ends = (offsets - offsets[0]) * width
            data = flat[offsets[0] : offsets[-1]].tobytes()
            packed = pa.BinaryArray.from_buffers(
                pa.binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)]
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], names=["key", "vec"])

    packed = chosen.mapInArrow(pack, "key long, vec binary")
    return packed.groupBy("key").agg(F.min("vec").alias("vec")), dtype


def matrix(column, dtype: str, width: int) -> np.ndarray:
    """Rows of a ``vec`` column in double precision, shorter ones padded with zeros to ``width``."""
    flat, starts = binary_rows(column, dtype)
    sizes = np.diff(starts)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width).astype(np.float64)
    out = np.zeros((len(sizes), width))
    for row, (start, size) in enumerate(zip(starts, sizes)):
        out[row, :size] = flat[start : start + size]
    return out


def widest(vectors: DataFrame, dtype: str) -> int:
    return (vectors.agg(F.max(F.length("vec"))).first()[0] or 0) // np.dtype(dtype).itemsize
