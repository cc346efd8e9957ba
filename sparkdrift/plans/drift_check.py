"""Drift checks against stored references."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta, timezone

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdrift.config import DriftConfig
from sparkdrift.operators.detect import drift_report, exit_code, feature_drift, select_features
from sparkdrift.operators.history import drift_metrics_long, drift_run_metrics, run_params
from sparkdrift.operators.reference import create_profile, reference_values
from sparkdrift.sources.references import ReferenceStore
from sparkdrift.sources.runs import append_table, write_drift_report
from sparkdrift.sources.table import scan_timerange


class InsufficientDataError(ValueError):
    """The scanned window holds no rows."""


def create_reference(
    store: ReferenceStore,
    name: str,
    df: DataFrame,
    features: Sequence[str],
    n_bins: int = 10,
    keep_values: bool = True,
    metadata: Mapping[str, str] | None = None,
) -> None:
    """Profile a frame and store it, with its folded raw values unless told otherwise."""
    values = reference_values(df, features) if keep_values else None
    store.save(name, create_profile(df, features, n_bins), features, values, metadata)


def current_window(
    table: DataFrame,
    hours: int | None,
    config: DriftConfig = DriftConfig(),
    now: datetime | None = None,
    time_column: str = "timestamp",
) -> DataFrame:
    """Rows of the monitoring window; an empty window is an error."""
    end = now or datetime.now(timezone.utc)
    start = end - timedelta(hours=hours or config.window_hours)
    found = scan_timerange(table, start, end, time_column)
    if found.isEmpty():
        raise InsufficientDataError(f"no data for {start} to {end}")
    return found


def detect_drift(
    store: ReferenceStore,
    reference_name: str,
    current: DataFrame | None = None,
    table: DataFrame | None = None,
    hours: int | None = None,
    features: Sequence[str] | None = None,
    config: DriftConfig = DriftConfig(),
    time_column: str = "timestamp",
    report_id: str | None = None,
    now: datetime | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(report, feature results) of a frame, or of a table's newest window, against a reference."""
    held, lost = store.features(reference_name)
    if current is None and table is None:
        raise ValueError("neither current data nor a table to scan was given")
    from_table = current is None
    frame = current if current is not None else current_window(table, hours, config, now, time_column)
    chosen, warnings = select_features(features, held, frame.columns, from_table)
    warnings += [f"Feature '{f}' is listed in the reference but not stored" for f in lost]
    if not chosen:
        raise ValueError("no features could be analyzed")
    results = feature_drift(
        store.load(reference_name), frame, chosen, store.load_values(reference_name), config
    )
    report = drift_report(
        results,
        frame,
        chosen,
        reference_name,
        time_column,
        config,
        report_id,
        now.isoformat() if now else None,
        warnings,
    )
    return report, results


def log_drift_run(
    root: str,
    report: DataFrame,
    results: DataFrame,
    run_id: str,
    model_name: str = "unassigned",
    model_version: str = "0",
    config: DriftConfig = DriftConfig(),
) -> None:
    """Append a run to the history tables under ``root``.

    Report and results are computed once and shared by the five tables.
    """
    report, results = report.persist(), results.persist()
    try:
        tagged = report.withColumn("run_id", F.lit(run_id))
        run = run_params(tagged).withColumn("timestamp", report.select("timestamp").scalar())
        named = run.select(
            "*",
            F.lit(model_name).alias("model_name"),
            F.lit(model_version).alias("model_version"),
            F.lit(config.method).alias("detection_method"),
        )
        append_table(named, f"{root}/drift_runs")
        append_table(
            drift_run_metrics(tagged, results.withColumn("run_id", F.lit(run_id))),
            f"{root}/drift_run_metrics",
        )
        write_drift_report(report, results, root)
        append_table(
            drift_metrics_long(results, report, model_name, model_version, config),
            f"{root}/drift_metrics",
        )
    finally:
        report.unpersist()
        results.unpersist()


def log_drift_run_safe(*args, **kwargs) -> bool:
    """Same, but a failure to record never stops the caller."""
    try:
        log_drift_run(*args, **kwargs)
        return True
    except Exception:  # noqa: BLE001 - recording is best effort here
        return False


def check(store: ReferenceStore, reference_name: str, **options) -> tuple[int, DataFrame | None]:
    """Run a check for a scheduler: (exit code, report).

    What the data or the reference lacks becomes the error code; faults of the program are raised.
    """
    try:
        report, _ = detect_drift(store, reference_name, **options)
        return exit_code(report.first()["drift_detected"]), report
    except (LookupError, OSError, ValueError, PySparkException, Py4JJavaError):
        return exit_code(None), None
