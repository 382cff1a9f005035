"""Running projections: one batch at a time, over a bounded frame or as a Structured Streaming query."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections import Counter
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlog import config
from foldlog.functions import failure
from foldlog.operators import events as ops
from foldlog.operators import handlers, inspection
from foldlog.streaming import files
from foldlog.streaming.coordinator import DRAINING, HALTED, INITIALIZING, PAUSED, STOPPED, Budget, Circuit, Coordinator
from foldlog.streaming.lease import Lease
from foldlog.targets.base import OUTCOMES, Batch, Refused, Report, Target, Wipeout, batch_stats, written
from foldlog.telemetry import bus


class Replay(Exception):
    """A batch to be delivered again after a wait."""

    def __init__(self, delay_ms: int, reason: BaseException):
        super().__init__(f"replay in {delay_ms} ms: {reason}")
        self.delay_ms, self.reason = delay_ms, reason


class Halted(Exception):
    def __init__(self, reason: str):
        super().__init__(reason)
        self.reason = reason


def handler_of(projection: config.Projection):
    return projection.handler if hasattr(projection.handler, "apply") else handlers.Function(projection.handler, projection.parallelism)


class Processor:
    """What happens to one batch of envelopes; the body of a foreachBatch.

    What arrives at once is handled and committed in one pass; how much that is the source decides. Inside a pass, runs of ``batch_size``
    positions are the batches in which keys collide and that the wipeout guard judges; so small batches cost no jobs of their own.
    batch_size None: a pass is a batch.
    """

    def __init__(self, spark: SparkSession, projection: config.Projection, circuit: Circuit | None = None, scratch: str | None = None, *, batch_size: int | None = None, run: str | None = None, held=None):
        self.spark, self.projection, self.circuit = spark, projection, circuit or Circuit()
        self.handler, self.retry = handler_of(projection), config.retry_plan(projection.retry)
        #: run: whose batch ids are counted; held: whether this writer still holds the lease
        self.batch_size, self.run, self.held = batch_size, run, held
        base = scratch or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            import tempfile

            base = "file://" + tempfile.mkdtemp(prefix="foldlog-")
        self.scratch = f"{base.rstrip('/')}/evaluated-{projection.name}-{projection.version}-{uuid.uuid4().hex}"

    def __call__(self, events: DataFrame, batch_id: int | None) -> Report | None:
        """batch_id None: the batch belongs to no numbered run; cursors alone keep it from being applied twice."""
        if batch_id is not None and self.projection.target.already(self.projection.identity, batch_id, self.spark, self.run):
            return None
        return self._pass(events, batch_id)

    def _pass(self, events: DataFrame, batch_id: int | None) -> Report:
        target: Target = self.projection.target
        began = time.time()
        path = f"{self.scratch}/{uuid.uuid4().hex}"
        outcomes, counts = self._handled(events, path)
        with ThreadPoolExecutor(1) as pool:  # the steps' columns are looked for beside the keys that collide
            told = pool.submit(batch_stats, outcomes, counts)
            collided = self._collided(outcomes, counts["most_multi"]) if counts.get("most_multi") else None  # an empty pass may have no counts
            known = told.result()
        if collided is not None:
            outcomes, known = collided, batch_stats(collided)
        now = F.lit(datetime.now(timezone.utc).replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp")
        try:
            report = target.commit(self.spark, Batch(self.projection.identity, batch_id, outcomes, now, known, self.run), lambda r: self._guard(r, outcomes))
        except Wipeout as e:
            raise Halted(f"wipeout: {e}") from e
        except Halted:
            raise
        except Exception as e:
            kind = failure.classify(e)
            if kind == failure.TRANSIENT:
                bus.emit("source.batch.failed", {"count": 1}, subscription=self.projection.name, reason=str(e))
                raise Replay(self.circuit.replay_ms(), e) from e
            raise Halted(failure.label(e)) from e
        if report.applied:
            self.circuit.applied()
        self._tell(known, began)
        for x in report.letters:
            bus.emit("dead_letter", projection=self.projection.identity, **x)
        files.remove(self.spark, self.scratch)
        return report

    def _evaluated(self, events: DataFrame, path: str | int) -> DataFrame:
        """Handle each event once: the outcomes are written before anything reads them twice."""
        return self._handled(events, path)[0]

    def _handled(self, events: DataFrame, path: str | int) -> tuple[DataFrame, dict]:
        path = path if isinstance(path, str) else f"{self.scratch}/{path}"
        marked = ops.dedup(events, self.projection.target.cursors_of(self.spark, self.projection.identity, events))
        if getattr(self.handler, "columns_only", False):
            both = self.handler.apply(marked, self.retry).withColumn("result", F.when(~F.col("repeated"), F.col("result")))
            told = self.handler.outcome() if hasattr(self.handler, "outcome") else None
        else:
            told, fresh = None, self.handler.apply(marked.where("not repeated"), self.retry)
            both = fresh.unionByName(marked.where("repeated").withColumn("result", F.lit(None).cast(fresh.schema["result"].dataType)))
        outcome = handlers.outcome(F.col("result"), F.col("repeated")) if told is None else F.when(F.col("repeated"), "deduped").otherwise(told)
        both = both.withColumn("outcome", outcome).drop("metadata")
        counts = written(both, path)
        return self.spark.read.schema(both.schema).parquet(path), counts

    def _cut(self, frame: DataFrame) -> DataFrame:
        """The frame as a table in the shared folder."""
        path = f"{self.scratch}/{uuid.uuid4().hex}"
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def _batch_of(self, position: str = "position") -> Column:
        return F.floor((F.col(position) - 1) / self.batch_size).cast("bigint") if self.batch_size else F.lit(0).cast("bigint")

    def _collided(self, outcomes: DataFrame, most: int) -> DataFrame | None:
        """The outcomes with the events that lose a key; None if none does."""
        multi = outcomes.where("outcome = 'applied' and result.kind = 'multi'")
        if most == 1:
            keyed = multi.select(self._batch_of().alias("batch"), "position", F.col("result.steps")[0]["name"].alias("key"))
            lost = ops.collisions(keyed).where("collides").select("position")
        else:  # a loser's other keys stay free, which takes a batch's order
            lost = ops.lost_claims(multi.select(self._batch_of().alias("batch"), "position", F.transform("result.steps", lambda s: s["name"]).alias("keys")), self._cut).select("position")
        lost = self._cut(lost)
        if lost.isEmpty():
            return None
        marked = outcomes.join(lost.withColumn("__lost", F.lit(True)), "position", "left")
        return marked.withColumn("outcome", F.when(F.col("__lost"), "collision").otherwise(F.col("outcome"))).select(*outcomes.columns)

    def _guard(self, report: Report, outcomes: DataFrame) -> None:
        """The last word before anything is published."""
        if self.held is not None and not self.held():
            raise Halted("the lease was lost")
        if not report.broken:
            return
        tried = [(0, report.attempted)] if self.batch_size is None else [tuple(r) for r in outcomes.where("outcome = 'applied'").groupBy(self._batch_of().alias("batch")).count().orderBy("batch").collect()]
        if self.batch_size is None:
            of = Counter({0: len(report.broken)})
        elif isinstance(report.broken, Refused):
            of = Counter(dict(map(tuple, report.broken.frame.groupBy(self._batch_of().alias("batch")).count().collect())))
        else:
            of = Counter((p - 1) // self.batch_size for p, _ in report.broken)
        for batch, attempted in tried:
            if of[batch] < attempted:
                self.circuit.applied()
            elif self.circuit.wiped(attempted):
                raise Wipeout(f"all {attempted} events failed on integrity, the first with {report.broken[0][1]}")

    def _tell(self, counts: dict, began: float) -> None:
        for outcome, reason in (("deduped", "dedup"), ("skipped", "handler")):
            if counts.get(outcome):
                bus.emit("event.skipped", {"count": counts[outcome]}, projection=self.projection.identity, reason=reason)
        for name, (count, seconds) in self.handler.noted().items() if hasattr(self.handler, "noted") else ():
            bus.emit(name, {"count": count, "duration": seconds}, projection=self.projection.identity)
        bus.emit("batch.stop", {"duration": time.time() - began, "batch_size": sum(counts[o] for o in OUTCOMES)}, projection=self.projection.identity)


#: Positions that a bounded run handles and commits at once.
IN_FLIGHT = 1_000_000


def run_bounded(spark: SparkSession, projection: config.Projection, events: DataFrame | None = None, events_per_batch: int | None = None, in_flight: int = IN_FLIGHT, part: Callable[[int, int], DataFrame] | None = None) -> list[Report]:
    """Catch up with what the log holds now, in passes of about ``in_flight`` positions; a report for each.

    events_per_batch: positions to a batch, for colliding keys and the wipeout guard; a pass is one batch without it.
    part: the events from one position to another, for logs that find these without reading all of themselves.
    """
    frame = projection.source.batch(spark) if events is None else events
    process = Processor(spark, projection, batch_size=events_per_batch)
    size = in_flight if events_per_batch is None else max(1, in_flight // events_per_batch) * events_per_batch
    low, high = frame.agg(F.min("position"), F.max("position")).first()
    if low is None:
        return []
    found = list(ops.ranges(frame, (low - 1) // size * size + 1, high, size))  # where batches begin, too
    part = part or (lambda a, b: frame if len(found) == 1 else frame.where(F.col("position").between(a, b)))
    return [process(part(a, b), None) for a, b in found]


@dataclass(frozen=True)
class Info:
    """A snapshot; what the target cannot tell right now is None."""

    name: str
    version: int
    state: str
    parallelism: int
    stream_positions: dict[str, int] | str | None
    safe_position: int | None
    position: int | None
    event_time: Any
    lag_ms: int | None
    halt_reason: Any


@dataclass
class Running:
    projection: config.Projection
    processor: Processor | None
    coordinator: Coordinator
    checkpoint: str
    after: int | str = "origin"
    query: Any = None
    lease: Lease | None = None
    timer: threading.Thread | None = None
    ended: threading.Event = field(default_factory=threading.Event)
    budget: Budget = field(default_factory=Budget)
    #: held while a batch is on its way
    gate: threading.RLock = field(default_factory=threading.RLock)

    @property
    def hold(self) -> str | None:
        """The file that keeps the source from offering more, for sources that admit rows."""
        return f"{self.checkpoint}/hold" if getattr(self.projection.source, "buffer_size", None) else None


class Engine:
    """Starts, pauses, resumes and stops projections of a session, and answers questions about them.

    Each (name, version) has a checkpoint of its own below ``root``; the checkpoint's offsets, not start_from, decide
    where a projection goes on; what start_from came to is noted there at the first start. A lease keeps a second
    writer off; a projection that loses it halts. ``start`` returns at once: while another writer has the lease, the projection is
    listed as initializing, can be stopped, and takes over when the lease is free. trigger: when a micro-batch begins, every ``batch_timeout_ms`` of
    the projection if not given.
    """

    def __init__(self, spark: SparkSession, root: str, trigger: dict | None = None, lease_seconds: float = 30.0):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.root, self.trigger, self.lease_seconds = spark, root.rstrip("/"), trigger, lease_seconds
        self.running: dict[tuple[str, int], Running] = {}

    def start(self, projection: config.Projection, **overrides: Any) -> Running:
        for name in ("name", "version"):
            if name in overrides:
                raise ValueError(f"{name} belongs to the declaration")
        if overrides:
            projection = config.declare(**(projection.__dict__ | overrides))
        known = self.running.get(projection.identity)
        if known and known.coordinator.state != STOPPED:
            raise ValueError(f"{projection.name} version {projection.version} is started already")
        checkpoint = f"{self.root}/{projection.name}/{projection.version}"
        lease = Lease(self.spark, checkpoint, self.lease_seconds)
        own = Running(projection, None, Coordinator(), checkpoint, lease=lease)
        self.running[projection.identity] = own
        if lease.take():
            bus.emit("source.subscribed", {"attempts": 1}, subscription=checkpoint)
            self._begin(own)
        else:  # another writer has it: stand by, listed as initializing
            own.timer = threading.Thread(target=self._stand_by, args=(own,), daemon=True)
            own.timer.start()
        return own

    def _stand_by(self, own: Running) -> None:
        attempts = own.lease.wait(own.checkpoint, sleep=own.ended.wait, given_up=own.ended.is_set)
        with own.gate:
            if not attempts or own.ended.is_set():
                own.lease.release()
                return
            try:
                self._begin(own)
            except Exception as e:
                own.coordinator.halt(str(e))
                own.lease.release()

    def _begin(self, own: Running) -> None:
        """The lease is ours: go on from the checkpoint."""
        projection = own.projection
        started = self._started(projection, own.checkpoint)
        own.after = started["after"]
        own.processor = Processor(self.spark, projection, batch_size=projection.batch_size, run=started["run"], held=own.lease.held)
        if own.hold:
            files.remove(self.spark, own.hold)  # a pause ends with its engine
        if bus.listens("cursors.loaded"):
            n = projection.target.cursors(self.spark, projection.identity).count()
            bus.emit("cursors.loaded", {"count": n}, projection=projection.identity, source="target" if n else "empty")
        self._launch(own)
        own.timer = threading.Thread(target=self._watch, args=(own,), daemon=True)
        own.timer.start()

    def _started(self, projection: config.Projection, checkpoint: str) -> dict:
        """The checkpoint's own name and its first position, noted once: its offsets and batch ids belong to it."""
        path = f"{checkpoint}/start"
        found = files.read(self.spark, path)
        if found is None:
            files.create(self.spark, path, json.dumps({"run": uuid.uuid4().hex, "after": projection.source.first(self.spark)}))
            found = files.read(self.spark, path)
        return json.loads(found)

    def _launch(self, own: Running) -> None:
        options = {"checkpoint": own.checkpoint, "hold": own.hold} if own.hold else {}
        stream = own.projection.source.stream(self.spark, own.after, **options)
        trigger = self.trigger or {"processingTime": f"{own.projection.batch_timeout_ms} milliseconds"}
        drained = bool(own.hold and trigger.get("availableNow"))  # one batch is not all that is there
        writer = stream.writeStream.foreachBatch(lambda df, n: self._batch(own, df, n)).option("checkpointLocation", own.checkpoint)
        own.query = writer.trigger(**({"processingTime": "0 seconds"} if drained else trigger)).start()
        if drained:
            threading.Thread(target=self._drain, args=(own.query,), daemon=True).start()
        if own.coordinator.ready():
            bus.emit("started", projection=own.projection.identity)

    @staticmethod
    def _drain(query) -> None:
        try:
            query.processAllAvailable()
            query.stop()
        except Exception:  # it failed, which the watcher sees, or was stopped
            pass

    def _batch(self, own: Running, df: DataFrame, batch_id: int) -> None:
        try:
            with own.gate:
                if own.coordinator.state in (DRAINING, STOPPED) or (own.coordinator.state == PAUSED and not own.hold):
                    raise RuntimeError("nothing begins any more")  # the batch is replayed later
                own.processor(df, batch_id)
        except Replay as e:
            time.sleep(e.delay_ms / 1000)
            raise
        except Halted as e:
            if own.coordinator.halt(e.reason):
                bus.emit("halted", projection=own.projection.identity, reason=e.reason, failure=e.reason)
            raise

    def _watch(self, own: Running) -> None:
        """Restart a query that died, within its budget; keep the lease; tell the lag."""
        told = renewed = time.time()
        while not own.ended.wait(0.05):
            own_query = own.query
            dead = own_query is not None and not own_query.isActive
            if dead and own.coordinator.state in ("running", INITIALIZING):
                if own_query.exception() is None:
                    continue  # a bounded trigger has done its work
                own.coordinator.lost()
                if own.budget.spend(time.time()):
                    self._launch(own)
                else:
                    own.coordinator.halt("too many restarts")
            if time.time() - renewed >= own.lease.seconds / 4 and own.coordinator.state != HALTED:
                renewed = time.time()
                try:
                    lost = not own.lease.renew()
                except Exception:  # storage did not answer; the lease runs on until its end
                    lost = not own.lease.held()
                if lost and not own.ended.is_set():
                    self._halt(own, "the lease was lost")
            interval = own.projection.lag_interval_ms / 1000
            if interval and time.time() - told >= interval:
                told = time.time()
                try:
                    found = self.info(own.projection)
                except Exception:  # what cannot be told now is told the next time
                    continue
                if found.lag_ms is not None:
                    bus.emit("lag", {"lag_ms": found.lag_ms, "position": found.position}, projection=own.projection.identity, status=own.coordinator.state)

    def _halt(self, own: Running, reason: str) -> None:
        if own.coordinator.halt(reason):
            bus.emit("halted", projection=own.projection.identity, reason=reason, failure=reason)
        if own.query is not None:
            own.query.stop()

    def _own(self, projection: config.Projection | str, version: int = 1) -> Running:
        key = projection.identity if isinstance(projection, config.Projection) else (projection, version)
        if key not in self.running:
            raise KeyError(f"{key[0]} version {key[1]} was never started")
        return self.running[key]

    def pause(self, projection, version: int = 1) -> None:
        """Begin nothing new; what is in flight commits. A source that admits rows is held while its query lives, any other's query ends after its batch."""
        own = self._own(projection, version)
        own.coordinator.pause()
        if own.hold:
            files.create(self.spark, own.hold, "")
        else:
            with own.gate:
                own.query.stop()
        bus.emit("paused", projection=own.projection.identity)

    def resume(self, projection, version: int = 1) -> None:
        own = self._own(projection, version)
        own.coordinator.resume()
        if own.hold:
            files.remove(self.spark, own.hold)
        if not (own.hold and own.query.isActive):
            self._launch(own)
        bus.emit("resumed", projection=own.projection.identity)

    def stop(self, projection, version: int = 1) -> None:
        own = self._own(projection, version)
        if own.processor is None:  # it stands by
            own.ended.set()
            with own.gate:  # or is just taking over
                if own.processor is None:
                    own.coordinator.stopped()
                    return
        own.coordinator.drain()
        own.ended.set()
        with own.gate:  # what is in flight commits
            if own.query is not None:
                own.query.stop()
        own.lease.release()
        own.coordinator.stopped()

    def await_idle(self, projection, version: int = 1, seconds: float = 60) -> None:
        """Until the log is drained or the projection has halted."""
        own, until = self._own(projection, version), time.time() + seconds
        while time.time() < until:
            if own.coordinator.state == HALTED:
                return
            query = own.query
            try:
                if query is None:
                    pass  # it stands by
                elif query.isActive:
                    query.processAllAvailable()
                    return
                elif query.exception() is None:
                    return
            except Exception:  # the batch failed; the watcher restarts or halts
                pass
            time.sleep(0.05)

    def list(self) -> list[dict]:
        return [{"name": n, "version": v, "state": r.coordinator.state} for (n, v), r in sorted(self.running.items())]

    def info(self, projection, version: int = 1, now: datetime | None = None) -> Info:
        own = self._own(projection, version)
        target, identity = own.projection.target, own.projection.identity
        try:
            rows = target.cursors(self.spark, identity).limit(inspection.STREAMS_SHOWN + 1).collect()
            streams = "truncated" if len(rows) > inspection.STREAMS_SHOWN else {r[0]: r[1] for r in rows}
            safe = inspection.safe_position(target.cursors(self.spark, identity)).first()[0]
        except Exception:
            streams = safe = None
        try:
            at = inspection.of(target.table(self.spark, "progress"), *identity).select("position", "occurred_at").first()
        except Exception:
            at = None
        when = at and at["occurred_at"]
        lag = None if when is None else max(0, int(((now or datetime.now(timezone.utc).replace(tzinfo=None)) - when).total_seconds() * 1000))
        return Info(identity[0], identity[1], own.coordinator.state, own.projection.parallelism, streams, safe, at and at["position"], when, lag, own.coordinator.halt_reason)

    def _target(self, projection: config.Projection | str, version: int = 1) -> tuple[Target, tuple[str, int]]:
        own = projection if isinstance(projection, config.Projection) else self._own(projection, version).projection
        return own.target, own.identity

    def cursor(self, projection, stream_id: str, version: int = 1) -> int | None:
        """One stream's cursor; None if nothing of it was applied."""
        target, identity = self._target(projection, version)
        found = target.cursors(self.spark, identity).where(F.col("stream_id") == str(stream_id)).first()
        return None if found is None else found["position"]

    def watermark(self, projection, version: int = 1) -> tuple[int, Any] | None:
        """Position and event time that a projection has come to; None if it has not begun."""
        target, identity = self._target(projection, version)
        found = inspection.of(target.table(self.spark, "progress"), *identity).select("position", "occurred_at").first()
        return None if found is None else tuple(found)

    def dead_letters(self, projection, version: int = 1, **options) -> DataFrame:
        target, identity = self._target(projection, version)
        return inspection.dead_letter_page(target.table(self.spark, "dead_letters"), *identity, **options)

    def dead_letter_stats(self, projection, version: int = 1) -> DataFrame:
        target, identity = self._target(projection, version)
        return inspection.dead_letter_stats(target.table(self.spark, "dead_letters"), *identity)

    def reset(self, projection: config.Projection, dead_letters: bool = False) -> dict[str, int]:
        """Forget one version's cursors and progress; refused unless it is stopped or was never started."""
        known = self.running.get(projection.identity)
        if known and known.coordinator.state != STOPPED:
            from foldlog.streaming.coordinator import InvalidState

            raise InvalidState(known.coordinator.state)
        return projection.target.reset(self.spark, projection.identity, dead_letters)


def drain(spark: SparkSession, projection: config.Projection, events_per_batch: int | None = None) -> list[Report]:
    """Run a source in memory to its end: take, process, acknowledge what was processed."""
    process, out = Processor(spark, projection), []
    source = projection.source
    while (frame := source.take(spark, events_per_batch or projection.batch_size)) is not None:
        top = frame.agg(F.max("position")).first()[0]
        out.append(process(frame, None))
        source.acknowledge(top)
    return out
