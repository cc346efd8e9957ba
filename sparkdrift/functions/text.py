"""String expressions used in metric names and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_metric_name(name: Column) -> Column:
    """Blank, dash and dot become underscores."""
    return F.translate(name, " -.", "___")


def sanitize_metric_name(name: Column, max_length: int = 50) -> Column:
    """The cleaned name, cut at ``max_length`` characters."""
    return F.substring(clean_metric_name(name), 1, max_length)


def dataset_metric_name(name: Column) -> Column:
    """Dataset-statistics spelling: underscores become dashes, 20 characters."""
    return F.substring(F.translate(name, "_", "-"), 1, 20)


def importance_metric_name(name: Column) -> Column:
    """Feature-importance spelling: underscores become dashes, 30 characters."""
    return F.substring(F.translate(name, "_", "-"), 1, 30)
