"""Importance resampling: hashed n-gram models of target and raw text, and a Gumbel top-k sample."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sparkdrift.llm.frames import col, free_name, stored


@dataclass(frozen=True)
class Setting:
    """Hash buckets of the n-gram models, the bound of the target sample, and the sample's share.

    The target model is fitted on at most ``target_rows`` labelled texts, taken by a hash of their id; the
    raw model counts all texts. ``share`` of all rows are sampled.
    """

    buckets: int = 10_000
    target_rows: int = 20_000
    share: float = 0.8
    seed: int = 13
    narrow_rows: int = 10_000


def gram_buckets(text: str | None, buckets: int) -> np.ndarray:
    """The bucket of each word and of each pair of neighbouring words, with A-Z lower-cased."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.int64)
    digest = xxhash.xxh3_64_intdigest
    one = np.fromiter((digest(w) for w in found), np.uint64, len(found))
    two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + (one[1:] ^ (one[1:] >> np.uint64(31)))
    both = np.concatenate([one, two])
    both ^= both >> np.uint64(33)
    return (both % np.uint64(buckets)).astype(np.int64)


def gram_counts(texts: DataFrame, setting: Setting) -> tuple[np.ndarray, np.ndarray]:
    """Counts by bucket over all rows of (text, target), and over its target rows.

    Each task sums its own rows first, so a shuffle carries one row per task and bucket.
    """
    schema = pa.schema([("bucket", pa.int32()), ("raw", pa.int64()), ("target", pa.int64())])

    def run(batches):
        raw, target = np.zeros(setting.buckets, np.int64), np.zeros(setting.buckets, np.int64)
        for batch in batches:
            for text, chosen in zip(batch.column(0), batch.column(1).to_pylist()):
                own = np.bincount(gram_buckets(text.as_py(), setting.buckets), minlength=setting.buckets)
                raw += own
                if chosen:
                    target += own
        used = np.flatnonzero(raw)
        arrays = [pa.array(used.astype(np.int32)), pa.array(raw[used]), pa.array(target[used])]
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    counted = texts.mapInArrow(run, "bucket int, raw long, target long").groupBy("bucket")
    rows = counted.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()  # at most `buckets`
    raw, target = np.zeros(setting.buckets), np.zeros(setting.buckets)
    raw[rows["bucket"]], target[rows["bucket"]] = rows["raw"], rows["target"]
    return raw, target


def log_weights(docs: DataFrame, ratio: np.ndarray, text: str, name: str) -> DataFrame:
    """``docs`` with the sum of the log ratios of each text's n-grams."""
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    place = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            value = [float(ratio[gram_buckets(x.as_py(), len(ratio))].sum()) for x in batch.column(place)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(value, pa.float64())], names=[*batch.schema.names, name]
            )

    return docs.mapInArrow(run, schema)


def kth_largest(values: DataFrame, column: str, k: int, narrow_rows: int) -> float | None:
    """The k-th largest value, by counting cells of a range that narrows around it.

    A pass collects at most 1,024 cell counts; the last one collects the values of one cell with at most
    ``narrow_rows`` rows, or finds that all values of the cell are equal.
    """
    value = col(column)
    low, high, rows = values.agg(F.min(value), F.max(value), F.count(value)).first()
    if rows == 0 or k > rows or k < 1:
        return None
    above = 0
    while rows > narrow_rows and low < high:
        inside = values.where(value.between(low, high))
        cell = F.least(F.floor((value - low) / (high - low) * 1024), F.lit(1023))
        counts = inside.groupBy(cell.alias("cell")).agg(
            F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high")
        )
        for row in sorted(counts.collect(), key=lambda r: -r["cell"]):
            if above + row["n"] >= k:
                low, high, rows = row["low"], row["high"], row["n"]
                break
            above += row["n"]
    if low == high:
        return low
    rest = values.where(value.between(low, high)).select(value.alias("v")).orderBy(F.desc("v")).limit(k - above)
    return rest.agg(F.min("v")).first()[0]


def resample(
    docs: DataFrame,
    targets: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    setting: Setting = Setting(),
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``docs`` with ``log_weight``, ``sample_key`` and ``kept``.

    log_weight is the log of the ratio of two hashed n-gram models, of the texts whose keys are in
    ``targets`` and of all texts. sample_key adds Gumbel noise made from the row's key, and the ``share`` of
    rows with the largest sample keys is kept: a sample without replacement, weighted by the ratio. Rows
    that tie with the last one kept are kept too, so repeated rows stay or go together. Null and empty texts
    have the weight 0. ``keep`` names the columns of ``docs`` that are returned, all by default; the rows are
    written on the way, so leaving out the text saves writing it. Without targets all weights are 0 and the sample is uniform. Columns whose names are
    taken make the new ones end in underscores.
    """
    weight, noisy, kept = (free_name(docs, n) for n in ("log_weight", "sample_key", "kept"))
    chosen = targets.select(col(key).alias("k")).where("k is not null").distinct()
    chosen = chosen.orderBy(F.xxhash64("k", F.lit(setting.seed)), "k").limit(setting.target_rows)
    texts = docs.select(col(key).alias("k"), col(text).cast("string").alias("text"))
    # The limit above bounds the broadcast side.
    flagged = texts.join(F.broadcast(chosen.withColumn("chosen", F.lit(True))), "k", "left").select("text", "chosen")
    raw, target = gram_counts(flagged, setting)
    ratio = np.zeros(setting.buckets)
    if target.sum():
        ratio = np.log((target + 1) / (target.sum() + setting.buckets))
        ratio -= np.log((raw + 1) / (raw.sum() + setting.buckets))
    weighed = log_weights(docs, ratio, text, weight)
    own = docs.columns if keep is None else [key, *[c for c in keep if c != key]]
    weighed = weighed.select(*[col(c) for c in own], col(weight))
    uniform = (F.pmod(F.xxhash64(col(key), F.lit(setting.seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    weighed = stored(weighed.withColumn(noisy, col(weight) - F.log(-F.log(uniform))))
    k = round(setting.share * weighed.count())
    last = kth_largest(weighed.select(noisy), noisy, k, setting.narrow_rows)
    drawn = weighed.withColumn(kept, F.lit(False) if last is None else col(noisy) >= last)
    return drawn if keep is None else drawn.select(*[col(c) for c in (*keep, weight, noisy, kept)])
