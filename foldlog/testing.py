"""Trying out projections without a log: call a handler, or run a list of events through a real target."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from foldlog import config, model
from foldlog.functions.failure import BatchCommitError
from foldlog.operators import handlers
from foldlog.sources.logs import MemoryLog
from foldlog.streaming.runtime import Processor
from foldlog.targets.base import Batch, batch_stats

STREAM = "stream-under-test"


def envelope_of(data: Any, position: int = 1, **options: Any) -> model.Event:
    kind = options.pop("type", None) or (data.get("type") if isinstance(data, dict) and "type" in data else type(data).__name__)
    return model.Event(options.pop("id", f"event-{position}"), options.pop("stream_id", STREAM), kind, data, options.pop("position", position), **options)


def handle(projection: config.Projection, data: Any, **meta: Any) -> Any:
    """What the handler returns for one event; an exception is returned, not raised. No retries.

    Rules are evaluated by the active session; values of their rows are texts. None stands for no matching clause.
    """
    event = envelope_of(data, **{k: v for k, v in meta.items() if k in ("id", "stream_id", "type", "position", "occurred_at", "metadata")})
    known = {k: getattr(event, k) for k in ("id", "stream_id", "position", "type", "occurred_at", "metadata")} | meta
    if isinstance(projection.handler, handlers.Rules):
        row = projection.handler.apply(MemoryLog._frame(SparkSession.active(), [event])).select("result").first()["result"]
        return None if row is None else handlers.from_result(row.asDict(recursive=True))
    call = projection.handler if callable(projection.handler) else projection.handler.handle
    try:
        return call(event, known)
    except Exception as e:
        return e


@dataclass(frozen=True)
class Result:
    committed: int
    skipped: int
    failed: int
    invalid: int


def project(spark: SparkSession, projection: config.Projection, items: list[Any], *, stream_id: str = STREAM, start_position: int = 1) -> Result:
    """Run events, each data or (data, options), through handler and target in one commit; raises if that fails.

    Without retries; what fails in the handler is counted, not recorded.
    """
    rows = [envelope_of(*(x if isinstance(x, tuple) else (x, {}))[:1], position=start_position + i, **({"stream_id": stream_id} | (x[1] if isinstance(x, tuple) else {}))) for i, x in enumerate(items)]
    process = Processor(spark, config.declare(**(projection.__dict__ | {"retry": False})))
    outcomes = process._evaluated(MemoryLog._frame(spark, rows), 0)
    most = batch_stats(outcomes)["most_multi"]
    if most:
        outcomes = process._collided(outcomes, most)
    counts = Counter({r[0]: r[1] for r in outcomes.groupBy("outcome").count().collect()})
    good = outcomes.where(F.col("outcome").isin("applied", "skipped"))
    def strict(report) -> None:
        if report.broken:
            raise BatchCommitError(len(report.broken), f"{report.broken[0][1]} at position {report.broken[0][0]}")

    projection.target.commit(spark, Batch(projection.identity, start_position, good, F.lit(None).cast("timestamp")), strict)
    return Result(counts["applied"], counts["skipped"] + counts["deduped"], counts["failed"], counts["invalid"] + counts["collision"])
