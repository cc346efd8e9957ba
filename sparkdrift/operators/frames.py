"""Small building blocks shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_safe_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join on columns of the same name where NULL matches NULL; keeps the left keys.

    No broadcast hint: the planner and adaptive execution choose by measured size. Without keys the
    right side must be a one-row frame; its values are attached as a scalar subquery.
    """
    if not on:
        attached = left.withColumn("__row", one_row(right))
        return attached.select(*left.columns, *[F.col("__row")[c].alias(c) for c in right.columns])
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in on})
    condition = " AND ".join(f"`{k}` <=> `__r_{k}`" for k in on)
    return left.join(renamed, F.expr(condition), how).drop(*[f"__r_{k}" for k in on])


def exprs(*texts: str) -> list[Column]:
    """SQL expressions as columns."""
    return [F.expr(t) for t in texts]


def one_row(df: DataFrame) -> Column:
    """A one-row frame as a struct-valued scalar subquery: its values act as late-bound literals."""
    return df.select(F.struct("*").alias("row")).scalar()


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
