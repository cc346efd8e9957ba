"""Append-only run tables: ingestion log, run metrics, drift reports, feature configuration."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdrift.config import FeatureConfig
from sparkdrift.operators.split import feature_names

# Layout of the ingestion log.
LOG_SCHEMA = T.StructType(
    [
        T.StructField("batch_id", T.StringType(), False),
        T.StructField("start_time", T.TimestampType()),
        T.StructField("end_time", T.TimestampType()),
        T.StructField("records_count", T.LongType()),
        T.StructField("quality_score", T.DecimalType(5, 4)),
        T.StructField("status", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)


def log_rows(batches: DataFrame) -> DataFrame:
    """Shape batch results into log rows; all given columns are kept as JSON metadata."""
    everything = F.to_json(F.struct(*batches.columns))  # unless the metadata is given
    columns = {
        "start_time": F.lit(None),
        "end_time": F.lit(None),
        "records_count": F.lit(None),
        "quality_score": F.lit(None),
        "status": F.lit("unknown"),
        "error_message": F.lit(None),
        "metadata": everything,
        "created_at": F.current_timestamp(),
    }
    picked = []
    for field in LOG_SCHEMA:
        known = field.name in batches.columns
        source = F.col(field.name) if known else columns[field.name]
        if field.name == "status" and known:
            source = F.coalesce(source, F.lit("unknown"))
        picked.append(source.cast(field.dataType).alias(field.name))
    return batches.select(*picked)


def log_ingestion(
    spark: SparkSession, path: str, batch_id: str, metadata: Mapping[str, Any]
) -> bool:
    """Append one log row. A failure to log is reported, not raised."""
    known = {f.name: f.dataType for f in LOG_SCHEMA if f.name in metadata}
    document = F.lit(json.dumps(dict(metadata), default=str))
    try:
        row = spark.range(1).select(
            F.lit(batch_id).alias("batch_id"),
            document.alias("metadata"),
            *[F.lit(metadata[c]).cast(kind).alias(c) for c, kind in known.items() if c != "metadata"],
        )
        append_table(log_rows(row), path)
        return True
    except Exception:  # noqa: BLE001 - logging must never fail a run
        return False


def recent_runs(log: DataFrame, n: int = 5) -> DataFrame:
    return log.orderBy(F.col("created_at").desc(), "batch_id").limit(n)


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def report_json(report: DataFrame, results: DataFrame) -> DataFrame:
    """The full report as one JSON document: header, features by name, advice and warnings."""
    fields = [c for c in results.columns if c != "position"]
    features = results.agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct(F.col("feature_name"), F.struct(*fields))))
        )
    ).scalar()
    with_features = report.withColumn("feature_results", features)
    return with_features.select(
        "report_id", F.to_json(F.struct(*with_features.columns)).alias("report")
    )


def write_drift_report(report: DataFrame, results: DataFrame, path: str) -> None:
    """Append header and feature rows, keyed by report id, to two tables."""
    append_table(report, f"{path}/drift_report")
    identity = report.select("report_id").scalar()
    append_table(results.withColumn("report_id", identity), f"{path}/drift_feature")


def feature_config_row(
    spark: SparkSession,
    config: FeatureConfig = FeatureConfig(),
    split: Mapping[str, Any] | None = None,
) -> DataFrame:
    """Feature configuration, names and split information as one row."""
    document = {
        "feature_config": json.dumps(config.as_dict(), default=list),
        "target_column": config.target,
        "excluded_columns": list(config.excluded),
        "feature_names": feature_names(config),
        "split_info": json.dumps(dict(split), default=str) if split is not None else None,
    }
    schema = (
        "feature_config string, target_column string, excluded_columns array<string>, "
        "feature_names array<string>, split_info string"
    )
    return spark.createDataFrame([document], schema)


def save_feature_config(
    spark: SparkSession,
    path: str,
    config: FeatureConfig = FeatureConfig(),
    split: Mapping[str, Any] | None = None,
) -> None:
    feature_config_row(spark, config, split).coalesce(1).write.mode("overwrite").json(path)

