"""The observation table with atomic commits: data directories that never change, and lists of live ones.

A commit writes the dates it touches as new directories ``data/commit=<id>/dt=<date>`` and then publishes
the next list under ``versions``, which names one live directory per date. Publishing is a single rename:
readers see the old list or the new one, never a part of a commit, and a job that dies leaves files that no
list names. Of two writers that start from the same list, the second to publish fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdrift.functions.timeparts import require_utc
from sparkdrift.sources.files import names, read_text, remove, write_once
from sparkdrift.sources.table import (
    DATE,
    KEY,
    UPDATED_COLUMNS,
    AmbiguousOrderError,
    ambiguous_rows,
    merge_rows,
    to_table_types,
    with_date,
)


class CommitConflictError(RuntimeError):
    """Another writer has published a version since this one read the table."""


@dataclass(frozen=True)
class SnapshotTable:
    spark: SparkSession
    path: str

    def version(self) -> int:
        """The newest published version; 0 before the first one."""
        found = [int(n.removesuffix(".json")) for n in names(self.spark, f"{self.path}/versions") if n.endswith(".json")]
        return max(found, default=0)

    def live(self, version: int | None = None) -> dict[str, str]:
        """Date and data directory of everything a version holds; one entry per date."""
        number = self.version() if version is None else version
        return json.loads(read_text(self.spark, self._list(number)))["live"] if number else {}

    def read(self, version: int | None = None, start: str | None = None, end: str | None = None) -> DataFrame | None:
        """The rows of a version, the newest by default; None when there are none.

        ``start`` and ``end`` (ISO dates, inclusive) leave out directories before any is listed.
        """
        chosen = {
            date: where
            for date, where in self.live(version).items()
            if (start is None or date >= start) and (end is None or date <= end)
        }
        return self._read(chosen)

    def upsert(
        self,
        rows: DataFrame,
        key: Sequence[str] = KEY,
        updated: Sequence[str] = UPDATED_COLUMNS,
        order: Sequence[str] = ("updated_at",),
        arrival: Sequence[str] = (),
        attempts: int = 1,
    ) -> int:
        """Merge rows as ``table.upsert`` does and publish the result; returns the version.

        A batch without rows publishes nothing. After a conflict the merge is repeated on the newer version,
        up to ``attempts`` times in all.
        """
        require_utc(self.spark)
        incoming = with_date(to_table_types(rows))
        places = [*order, *arrival]
        present = [c for c in updated if c in incoming.columns]
        tied = ambiguous_rows(incoming, [*key, DATE], present, places).limit(1).collect()
        if tied:
            raise AmbiguousOrderError(f"no last row for key {[tied[0][k] for k in key]} by {', '.join(places)}")
        dates = incoming.select(F.col(DATE).cast("string")).distinct()
        touched = {row[0] for row in dates.toLocalIterator()}  # one per date
        for attempt in range(attempts):
            base = self.version()
            live = self.live(base)
            existing = self._read({d: live[d] for d in touched & live.keys()})
            merged = merge_rows(existing, incoming, [*key, DATE], updated, places, arrival)
            commit = f"commit=c-{uuid.uuid4().hex}"
            merged.hint("rebalance", DATE).write.partitionBy(DATE).parquet(f"{self.path}/data/{commit}")
            made = [n for n in names(self.spark, f"{self.path}/data/{commit}") if n.startswith(f"{DATE}=")]
            if not made:
                return base
            fresh = {n.removeprefix(f"{DATE}="): f"{commit}/{n}" for n in made}
            text = json.dumps({"version": base + 1, "commit": commit, "live": live | fresh}, sort_keys=True)
            if write_once(self.spark, self._list(base + 1), text):
                return base + 1
            remove(self.spark, f"{self.path}/data/{commit}")
        raise CommitConflictError(f"version {base + 1} of {self.path} was published by another writer")

    def vacuum(self, keep: int = 2) -> int:
        """Remove data that none of the newest ``keep`` versions names; returns the number of directories.

        No writer may be at work: what it has written is not named yet.
        """
        newest = self.version()
        kept = {where for v in range(max(newest - keep + 1, 1), newest + 1) for where in self.live(v).values()}
        removed = 0
        for commit in names(self.spark, f"{self.path}/data"):
            for date in names(self.spark, f"{self.path}/data/{commit}"):
                if date.startswith(f"{DATE}=") and f"{commit}/{date}" not in kept:
                    removed += remove(self.spark, f"{self.path}/data/{commit}/{date}")
        for v in range(1, newest - keep + 1):
            remove(self.spark, self._list(v))
        return removed

    def _list(self, version: int) -> str:
        return f"{self.path}/versions/{version:012d}.json"

    def _read(self, live: dict[str, str]) -> DataFrame | None:
        if not live:
            return None
        base = f"{self.path}/data"
        reader = self.spark.read.option("basePath", base).option("mergeSchema", "true")
        return reader.parquet(*[f"{base}/{where}" for where in live.values()]).drop("commit")
