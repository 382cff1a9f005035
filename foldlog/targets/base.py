"""What a target has to do: commit rows, cursors and dead letters together or not at all."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Refused(Sequence):
    """(position, SQLSTATE) by position out of a written table, which comes to the driver only where someone goes through it."""

    def __init__(self, frame: DataFrame, n: int):
        self.frame, self.n = frame, n
        self._rows: list[tuple[int, str]] | None = None

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, at):
        if self._rows is None and at == 0 and self.n:
            return tuple(self.frame.orderBy("position").first())
        if self._rows is None:
            self._rows = [tuple(r) for r in self.frame.orderBy("position").collect()]
        return self._rows[at]

    def __iter__(self):
        return iter(self[:])

    def __eq__(self, other) -> bool:
        return list(self) == list(other)


@dataclass
class Report:
    """What a commit did. broken: (position, SQLSTATE) of events whose rows a constraint refused."""

    attempted: int = 0
    applied: int = 0
    broken: Sequence[tuple[int, str]] = field(default_factory=list)
    #: position, stream_id, event_type and error_kind of the batch's dead letters; filled where someone listens
    letters: list[dict[str, Any]] = field(default_factory=list)


@dataclass
class Batch:
    """A batch on the way to its target. outcomes: envelopes without metadata, which only handlers read, with result and outcome, evaluated once."""

    identity: tuple[str, int]
    batch_id: int | None
    outcomes: DataFrame
    recorded_at: Any
    known: dict[str, Any] | None = None
    #: whose batch ids are counted
    run: str | None = None

    def stats(self) -> dict[str, Any]:
        """Counts by outcome, how far the batch reaches, and the tables and columns its steps name: one pass."""
        if self.known is None:
            self.known = batch_stats(self.outcomes)
        return self.known


OUTCOMES = ("applied", "skipped", "deduped", "failed", "invalid", "collision")


def _counts() -> list[Column]:
    outcome, n = F.col("outcome"), F.coalesce(F.size("result.steps"), F.lit(0))
    return [
        *(F.count(F.when(outcome == o, 1)).alias(o) for o in OUTCOMES), F.min("position").alias("bottom"), F.max("position").alias("top"), F.max_by(F.unix_micros("occurred_at"), "position").alias("at"),
        F.max(F.when(outcome == "applied", n)).alias("most"), F.max(F.when((outcome == "applied") & (F.col("result.kind") == "multi"), n)).alias("most_multi"),
    ]


def written(outcomes: DataFrame, path: str) -> dict[str, Any]:
    """Write a batch's outcomes; the counts of ``batch_stats``, taken on the way."""
    seen = Observation()
    outcomes.observe(seen, *_counts()).write.mode("overwrite").parquet(path)
    return seen.get


def batch_stats(outcomes: DataFrame, counts: dict[str, Any] | None = None) -> dict[str, Any]:
    """What a batch's outcomes hold; counts: what ``written`` has counted of them already."""
    found = dict(counts or outcomes.agg(*_counts()).first().asDict())
    found["at"] = T.TimestampType().fromInternal(found["at"])
    # which tables and columns: steps that name the same are alike, so a handful of rows comes back
    step = outcomes.where(F.col("outcome").isin("applied", "collision")).select(F.explode("result.steps").alias("step"))
    kinds = step.select("step.action", "step.table", *(F.map_keys(f"step.{m}").alias(m) for m in ("key", "set", "inc"))).distinct().collect()
    named = [(s["action"], s["table"], s["key"] or [], s["set"] or [], s["inc"] or []) for s in kinds]
    found["tables"] = {t for _, t, *_ in named}
    #: tables that are not only inserted into
    found["changed"] = {t for action, t, *_ in named if action != "insert"}
    #: table, columns by which rows are updated or deleted, columns that are written
    found["filters"] = {(t, tuple(sorted(key)), tuple(sorted({*sets, *incs}))) for action, t, key, sets, incs in named if action in ("update", "delete")}
    found["columns"] = {(t, c) for _, t, *maps in named for m in maps for c in m}
    return found


class Wipeout(Exception):
    """All of a batch failed on integrity, and the guard says that this is no accident."""


class Target(ABC):
    @abstractmethod
    def cursors(self, spark: SparkSession, identity: tuple[str, int]) -> DataFrame:
        """stream_id and position of one projection."""

    def cursors_of(self, spark: SparkSession, identity: tuple[str, int], events: DataFrame) -> DataFrame:
        """The cursors of the events' streams at least, for targets that need not read all for that."""
        return self.cursors(spark, identity)

    @abstractmethod
    def commit(self, spark: SparkSession, batch: Batch, guard) -> Report:
        """Commit a batch. guard(report) raises Wipeout before anything is published. Raises on failure."""

    @abstractmethod
    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """A table of the target: positions, dead_letters, progress or a read model."""

    @abstractmethod
    def reset(self, spark: SparkSession, identity: tuple[str, int], dead_letters: bool = False) -> dict[str, int]:
        """Delete cursors and progress (and dead letters) of one version; how many rows of each."""

    def already(self, identity: tuple[str, int], batch_id: int, spark: SparkSession | None = None, run: str | None = None) -> bool:
        """Whether this batch of a run is published, so that a replay is no work."""
        return False
