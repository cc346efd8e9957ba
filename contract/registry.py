"""Registration of queries together with their output columns and their SQL.

Both sides are finished by the same column list, so names, integer widths and rounding always agree.
A column list reads ``name:kind`` with the kinds s(tring), i(nteger), b(oolean), t(ime), d(ate) and
fN, a double rounded to N digits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    columns: tuple[tuple[str, str], ...]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        out = []
        for name, kind in self.columns:
            expr = f"`{name}`"
            if kind == "i":
                expr = f"CAST({expr} AS BIGINT)"
            elif kind == "t":
                expr = f"CAST({expr} AS TIMESTAMP_NTZ)"
            elif kind.startswith("f"):
                expr = f"round(CAST({expr} AS DOUBLE), {kind[1:]})"
            out.append(f"{expr} AS `{name}`")
        return self.build(spark, sf_dir).selectExpr(*out)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        out = []
        for name, kind in self.columns:
            if kind == "i":
                expr = f'CAST("{name}" AS BIGINT)'
            elif kind == "t":
                expr = f'CAST("{name}" AS TIMESTAMP)'
            elif kind.startswith("f"):
                # Adding zero turns a negative zero into the ordinary one.
                expr = f'round(CAST("{name}" AS DOUBLE), {kind[1:]}) + 0.0'
            else:
                expr = f'"{name}"'
            out.append(f'{expr} AS "{name}"')
        return f"SELECT {', '.join(out)} FROM (\n{self.sql}\n) AS result"


QUERIES: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register the decorated builder."""

    def add(build: Build) -> Build:
        parsed = tuple(tuple(item.split(":")) for item in columns.split())
        QUERIES[name] = Query(name, build, parsed, sql)
        return build

    return add
