"""Handlers: from an event to its result, as one CASE over columns or as a Python function on executors."""

from __future__ import annotations

import json
import time
import traceback
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldlog import model

_NO_TEXTS = "cast(map() as map<string,string>)"
_NO_LONGS = "cast(map() as map<string,bigint>)"


def _texts(values: dict[str, Any] | None) -> Column:
    pairs = [x for k, v in (values or {}).items() for x in (F.lit(k), (v if isinstance(v, Column) else F.lit(v)).cast("string"))]
    return F.create_map(*pairs).cast("map<string,string>") if pairs else F.expr(_NO_TEXTS)


def _longs(values: dict[str, Any] | None) -> Column:
    pairs = [x for k, v in (values or {}).items() for x in (F.lit(k), (v if isinstance(v, Column) else F.lit(v)).cast("bigint"))]
    return F.create_map(*pairs).cast("map<string,bigint>") if pairs else F.expr(_NO_LONGS)


def step(action: str, table: str, key: dict | None = None, set: dict | None = None, inc: dict | None = None, name: str | Column = "event") -> Column:
    named = name if isinstance(name, Column) else F.lit(name)
    return F.struct(named.alias("name"), F.lit(action).alias("action"), F.lit(table).alias("table"), _texts(key).alias("key"), _texts(set).alias("set"), _longs(inc).alias("inc")).cast(model.STEP)


def result(kind: str, *steps: Column, reason: Column | str | None = None) -> Column:
    why = reason if isinstance(reason, Column) else F.lit(reason)
    return F.struct(F.lit(kind).alias("kind"), F.array(*steps).cast("array<" + model.STEP.simpleString() + ">").alias("steps"), why.cast("string").alias("reason"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("stacktrace")).cast(model.RESULT)


class Rules:
    """Clauses by event type, the first match wins; an event without a clause fails. Compiled to one CASE."""

    #: a result is made of its event's columns only, so events need not be parted to be handled
    columns_only = True

    def __init__(self):
        self.clauses: list[tuple[Column, Column]] = []
        #: by event type, the outcome of clauses for which that is known beforehand; None if there are others
        self.known: list[tuple[str, str]] | None = []

    def on(self, type: str, then: Column, when: Column | None = None, outcome: str | None = None) -> Rules:
        test = F.col("type") == type
        self.clauses.append((test if when is None else test & when, then))
        self.known = None if outcome is None or when is not None or self.known is None else [*self.known, (type, outcome)]
        return self

    def otherwise(self, then: Column) -> Rules:
        self.clauses.append((F.lit(True), then))
        self.known = None
        return self

    def insert(self, type: str, table: str, row: dict) -> Rules:
        return self.on(type, result("insert", step("insert", table, set=row)), outcome="applied" if row else "invalid")

    def update(self, type: str, table: str, where: dict, set: dict) -> Rules:
        return self.on(type, result("update", step("update", table, key=where, set=set)), outcome="applied" if set else "invalid")

    def delete(self, type: str, table: str, where: dict) -> Rules:
        return self.on(type, result("delete", step("delete", table, key=where)), outcome="applied")

    def inc(self, type: str, table: str, where: dict, inc: dict, set: dict | None = None, name: str | Column = "inc") -> Rules:
        return self.on(type, result("multi", step("upsert", table, key=where, set=set, inc=inc, name=name)), outcome="applied")

    def skip(self, type: str) -> Rules:
        return self.on(type, result("skip"), outcome="skipped")

    def error(self, type: str, reason: Column | str) -> Rules:
        return self.on(type, result("error", reason=reason), outcome="failed")

    def apply(self, events: DataFrame, retry: tuple[int, list[int]] = (1, [])) -> DataFrame:
        case = None
        for test, then in self.clauses:
            case = F.when(test, then) if case is None else case.when(test, then)
        return events.withColumn("result", case if case is not None else F.lit(None).cast(model.RESULT))

    def outcome(self) -> Column | None:
        """What ``outcome`` says of the results, told by the events' types; None if a clause's own columns have to be looked at."""
        if self.known is None:
            return None
        return F.coalesce(*(F.when(F.col("type") == type, verdict) for type, verdict in self.known), F.lit("failed"))


def plain(value: Any) -> str | None:
    return None if value is None else value if isinstance(value, str) else json.dumps(value) if isinstance(value, (bool, dict, list)) else str(value)


def to_result(value: Any) -> dict:
    """A handler's return value as a row of model.RESULT; what is none of the accepted shapes is invalid."""
    def one(name: str, x: Any) -> dict:
        row = lambda d: {k: plain(v) for k, v in d.items()}
        if isinstance(x, model.Insert):
            return {"name": name, "action": "insert", "table": x.table, "key": {}, "set": row(x.row), "inc": {}}
        if isinstance(x, model.Update) and (x.set or x.inc):
            return {"name": name, "action": "update", "table": x.table, "key": row(x.where), "set": row(x.set), "inc": dict(x.inc)}
        if isinstance(x, model.Upsert):
            return {"name": name, "action": "upsert", "table": x.table, "key": row(x.key), "set": row(x.set), "inc": dict(x.inc)}
        if isinstance(x, model.Delete):
            return {"name": name, "action": "delete", "table": x.table, "key": row(x.where), "set": {}, "inc": {}}
        raise TypeError(f"not a step: {x!r}")

    empty = {"kind": None, "steps": [], "reason": None, "error": None, "stacktrace": None}
    try:
        if isinstance(value, model.Skip):
            return empty | {"kind": "skip"}
        if isinstance(value, model.Error):
            return empty | {"kind": "error", "reason": str(value.reason)}
        if isinstance(value, model.Multi):
            return empty | {"kind": "multi", "steps": [one(k, v) for k, v in value.steps.items()]}
        if isinstance(value, (model.Insert, model.Delete)) or isinstance(value, model.Update) and value.set and not value.inc:
            return empty | {"kind": type(value).__name__.lower(), "steps": [one("event", value)]}
    except TypeError as e:
        return empty | {"kind": "invalid", "reason": str(e)}
    return empty | {"kind": "invalid", "reason": repr(value)}


def from_result(found: dict) -> Any:
    """A row of model.RESULT as the object that a Python handler would have returned; None if no clause matched."""
    def one(s: dict) -> Any:
        key, set_, inc = (dict(s[k] or {}) for k in ("key", "set", "inc"))
        made = {"insert": lambda: model.Insert(s["table"], set_), "update": lambda: model.Update(s["table"], key, set_, inc), "upsert": lambda: model.Upsert(s["table"], key, set_, inc), "delete": lambda: model.Delete(s["table"], key)}
        return made[s["action"]]()

    kind = found["kind"]
    if kind == "skip":
        return model.Skip()
    if kind == "error":
        return model.Error(found["reason"])
    if kind == "multi":
        return model.Multi({s["name"]: one(s) for s in found["steps"]})
    return one(found["steps"][0]) if kind in ("insert", "update", "delete") else None


def attempt(handle: Callable, event: model.Event, meta: dict, attempts: int, backoff: list[int], note: Callable[[str, dict], None] | None = None) -> dict:
    """Call a handler until it succeeds or attempts run out. Exceptions become results; exits are not caught."""
    found: dict = {}
    watch = dict(meta)
    for k in range(attempts):
        try:
            if note:
                note("event.start", watch)
            found = to_result(handle(event, meta))
            if note:
                note("event.stop", watch)
        except Exception as e:
            if note:
                note("event.exception", watch)
            found = {"kind": "exception", "steps": [], "reason": str(e), "error": f"{type(e).__module__}.{type(e).__qualname__}", "stacktrace": traceback.format_exc()}
        if found["kind"] not in model.FAILURE or k == attempts - 1:
            break
        time.sleep(backoff[k] / 1000)
    return found


class Function:
    """A Python handler ``handle(event, meta)``, run where the events are, each stream in order of position."""

    def __init__(self, handle: Callable[[model.Event, dict], Any], parallelism: int | None = None):
        self.handle, self.parallelism = handle, parallelism
        self._notes: dict[str, list] = {}

    def noted(self) -> dict[str, tuple[int, float]]:
        """Since the last call: how often an event was begun, ended or raised on the executors, and seconds spent.

        Sums of accumulators, so a task that ran twice counts twice.
        """
        found = {}
        for name, (count, seconds, seen) in self._notes.items():
            now = (count.value, seconds.value)
            found[name] = (now[0] - seen[0], now[1] - seen[1])
            seen[:] = now
        return {name: x for name, x in found.items() if x[0]}

    def apply(self, events: DataFrame, retry: tuple[int, list[int]] = (1, [])) -> DataFrame:
        from pyspark.sql import types as T

        handle, (attempts, backoff) = self.handle, retry
        names = events.columns
        if not self._notes:
            sc = events.sparkSession.sparkContext
            self._notes = {name: (sc.accumulator(0), sc.accumulator(0.0), [0, 0.0]) for name in ("event.start", "event.stop", "event.exception")}
        tallies = {name: (x[0], x[1]) for name, x in self._notes.items()}

        def note(name: str, meta: dict) -> None:
            tallies[name][0].add(1)
            if name == "event.start":
                meta["__began"] = time.time()
            else:
                tallies[name][1].add(time.time() - meta.pop("__began", time.time()))

        def run(frames: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in frames:
                rows = batch.to_pylist()
                out = []
                for r in rows:
                    meta = {k: r[k] for k in ("id", "stream_id", "position", "type", "occurred_at")} | {"metadata": dict(r["metadata"] or {})}
                    data = json.loads(r["data"]) if r["data"] else None
                    out.append(attempt(handle, model.Event(r["id"], r["stream_id"], r["type"], data, r["position"], r["occurred_at"], dict(r["metadata"] or {})), meta, attempts, backoff, note))
                for o in out:
                    for s in o["steps"]:
                        for k in ("key", "set", "inc"):
                            s[k] = list(s[k].items())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, type=_arrow_result())], names=[*names, "result"])

        spread = events.repartition(self.parallelism, "stream_id") if self.parallelism else events.repartition("stream_id")
        return spread.sortWithinPartitions("stream_id", "position").mapInArrow(run, T.StructType([*events.schema.fields, T.StructField("result", model.RESULT)]))


def _arrow_result():
    import pyarrow as pa

    texts, longs = pa.map_(pa.string(), pa.string()), pa.map_(pa.string(), pa.int64())
    one = pa.struct([("name", pa.string()), ("action", pa.string()), ("table", pa.string()), ("key", texts), ("set", texts), ("inc", longs)])
    return pa.struct([("kind", pa.string()), ("steps", pa.list_(one)), ("reason", pa.string()), ("error", pa.string()), ("stacktrace", pa.string())])


def valid(found: Column) -> Column:
    """Whether a target can apply a result: one of the five accepted shapes."""
    step_ok = lambda s: s["table"].isNotNull() & F.when(s["action"] == "insert", F.size(s["set"]) > 0).when(s["action"] == "update", F.size(s["set"]) + F.size(s["inc"]) > 0).otherwise(s["action"].isin("delete", "upsert"))
    return F.coalesce(F.when(found["kind"] == "skip", True).when(found["kind"].isin("insert", "update", "delete", "multi"), F.forall(found["steps"], step_ok)).otherwise(False), F.lit(False))


def outcome(found: Column, repeated: Column | None = None) -> Column:
    """deduped, skipped, applied, failed or invalid."""
    kind = found["kind"]
    base = F.when(kind.isNull() | kind.isin(*model.FAILURE), "failed").when(kind == "skip", "skipped").when(valid(found), "applied").otherwise("invalid")
    return base if repeated is None else F.when(repeated, "deduped").otherwise(base)


def error_kind(found: Column) -> Column:
    kind = found["kind"]
    return F.when(kind.isNull(), "no_clause").when(kind == "error", "error").when(kind == "exception", found["error"]).otherwise("invalid_return")


def dead_letter_rows(failed: DataFrame, name: str, version: int, recorded_at: Column) -> DataFrame:
    """Dead letters (without ids) of events whose outcome is failed or invalid, or that have ``failure`` set."""
    given = F.col("failure") if "failure" in failed.columns else F.lit(None).cast("string")
    found = F.col("result")
    return failed.select(
        F.lit(name).alias("projection_name"), F.lit(version).alias("projection_version"), "position", "stream_id", F.col("type").alias("event_type"), event_data(F.col("data")).alias("event_data"),
        F.coalesce(given, error_kind(found)).alias("error_kind"), F.coalesce(found["reason"], F.lit("")).alias("error_message"), found["stacktrace"].alias("error_stacktrace"), recorded_at.alias("occurred_at"),
    )


def event_data(data: Column) -> Column:
    """JSON maps as they are; any other value wrapped as {"value": ...}."""
    return F.when(F.ltrim(data).startswith("{"), data).otherwise(F.to_json(F.struct(data.alias("value"))))
