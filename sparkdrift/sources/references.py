"""Stored references: profiles, optional raw values and metadata, one partition per reference."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdrift.sources.files import exists, remove

NAME = "reference_name"


class ReferenceNotFoundError(LookupError):
    """The store holds no reference of that name."""


def reference_metadata(
    profile: DataFrame,
    name: str,
    features: Sequence[str],
    extra: Mapping[str, str] | None = None,
    created_at: str | None = None,
) -> DataFrame:
    """One metadata row; ``total_samples`` is the first feature's size unless ``extra`` overrides it."""
    stamp = F.current_timestamp() if created_at is None else F.lit(created_at).cast("timestamp")
    given = {k: str(v) for k, v in (extra or {}).items()}
    pairs = [F.lit(x) for kv in given.items() for x in kv]
    info = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    first = F.max(F.when(F.col("feature") == features[0], F.col("n_samples")))
    if "total_samples" in given:
        first = F.lit(int(given["total_samples"]))
    return profile.agg(
        first.cast("long").alias("total_samples"), F.count(F.lit(1)).alias("n_features")
    ).select(
        F.lit(name).alias(NAME),
        stamp.alias("created_at"),
        F.array(*[F.lit(f) for f in features]).alias("features"),
        "total_samples",
        "n_features",
        info.alias("info"),
    )


def newest_first(metadata: DataFrame) -> DataFrame:
    return metadata.orderBy(F.col("created_at").desc(), NAME)


class ReferenceStore:
    """References under one directory."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path.rstrip("/")

    def _part(self, kind: str, name: str | None = None) -> str:
        return f"{self.path}/{kind}" + (f"/{NAME}={name}" if name is not None else "")

    def _put(self, kind: str, df: DataFrame) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            NAME
        ).parquet(self._part(kind))

    def save(
        self,
        name: str,
        profile: DataFrame,
        features: Sequence[str],
        values: DataFrame | None = None,
        metadata: Mapping[str, str] | None = None,
    ) -> None:
        """Store or replace a reference; the metadata is written last and makes it visible."""
        remove(self.spark, self._part("metadata", name))
        self._put("profiles", profile.withColumn(NAME, F.lit(name)))
        if values is None:
            remove(self.spark, self._part("values", name))
        else:
            self._put("values", values.withColumn(NAME, F.lit(name)))
        stored = self.spark.read.parquet(self._part("profiles", name))
        self._put("metadata", reference_metadata(stored, name, features, metadata))

    def exists(self, name: str) -> bool:
        return exists(self.spark, self._part("metadata", name))

    def _require(self, name: str) -> None:
        if not self.exists(name):
            raise ReferenceNotFoundError(f"reference '{name}' not found")

    def metadata(self, name: str) -> DataFrame:
        self._require(name)
        return self.spark.read.parquet(self._part("metadata")).where(F.col(NAME) == name)

    def load(self, name: str) -> DataFrame:
        """Profiles of one reference."""
        self._require(name)
        return self.spark.read.parquet(self._part("profiles")).where(F.col(NAME) == name).drop(NAME)

    def load_values(self, name: str) -> DataFrame | None:
        """Raw values as ``(feature, value, cnt)``, or None when none were stored."""
        self._require(name)
        if not exists(self.spark, self._part("values", name)):
            return None
        return self.spark.read.parquet(self._part("values")).where(F.col(NAME) == name).drop(NAME)

    def features(self, name: str) -> tuple[list[str], list[str]]:
        """Stored features in their original order, and those listed but lost."""
        listed = self.metadata(name).first()["features"]
        held = {r[0] for r in self.load(name).select("feature").distinct().collect()}
        return [f for f in listed if f in held], [f for f in listed if f not in held]

    def list(self) -> DataFrame | None:
        """Metadata of all references, newest first; None for an empty store."""
        if not exists(self.spark, self._part("metadata")):
            return None
        return newest_first(self.spark.read.parquet(self._part("metadata")))

    def delete(self, name: str) -> bool:
        """Remove a reference; False when there was none."""
        found = remove(self.spark, self._part("metadata", name))
        for kind in ("profiles", "values"):
            remove(self.spark, self._part(kind, name))
        return found

    def export_json(self, name: str, path: str) -> None:
        """One JSON document per feature."""
        self.load(name).write.mode("overwrite").json(path)
