import datetime
import random
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from foldlog import config, model, testing
from foldlog.functions import failure, scalars
from foldlog.operators import events as ops
from foldlog.operators import folds, handlers, inspection
from foldlog.sources.logs import MemoryLog, ParquetLog
from foldlog.streaming.coordinator import Budget, Circuit, Coordinator, InvalidState
from foldlog.streaming.lease import Lease
from foldlog.streaming.runtime import Engine, Halted, Processor, Replay, drain, run_bounded
from foldlog.targets.epoch import EpochTarget
from foldlog.targets.jdbc import JdbcTarget
from foldlog.targets.memory import MemoryTarget

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have this module
ROWS = model.Table("entries", "event_id string, stream_id string, position bigint", ("event_id",), ("stream_id",))
ACCOUNTS = model.Table("accounts", "id string, balance bigint, seen bigint", ("id",), ("balance",))


def event(position, stream="a", type="add", data=None, **more):
    return model.Event(f"e{position}", stream, type, data or {"n": position}, position, datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=position), **more)


def insert(e, meta):
    if e.type == "bad":
        return model.Error("nope")
    if e.type == "boom":
        raise ValueError("boom")
    if e.type == "odd":
        return "nonsense"
    if e.type == "other":
        return model.Skip()
    return model.Insert("entries", {"event_id": e.id, "stream_id": e.stream_id, "position": e.position})


def declared(target, source=None, handler=insert, **more):
    return config.declare(**({"name": "p", "source": source or MemoryLog([]), "target": target, "handler": handler, "parallelism": 2, "retry": False} | more))


def frame(spark, items):
    return MemoryLog._frame(spark, items)


# ---------------------------------------------------------------- pure parts

@pytest.mark.parametrize("state, kind", [(s, "integrity") for s in ("23505", "23502", "23503", "23514", "22003", "22001")] + [(s, "transient") for s in ("40001", "40P01", "53300", "53200", "57014", "08006", "57P01", "57P02", "57P03", "25006", None)] + [(s, "structural") for s in ("42703", "42P01", "42501", "57P04", "40002", "XX000")])
def test_failures_are_classified(spark, state, kind):
    assert failure.classify(failure.CommitFailure(state)) == kind
    assert spark.createDataFrame([(state,)], "s string").select(scalars.failure_class(F.col("s"))).first()[0] == kind


def test_other_failures():
    assert failure.classify(failure.ConstraintFailure("unique", "rows_pkey")) == "integrity"
    assert failure.classify(ConnectionError()) == "transient"
    assert failure.classify(RuntimeError()) == failure.classify("text") == "structural"
    assert failure.label(failure.CommitFailure("23505")) == "23505 (unique_violation)"
    assert failure.label(failure.ConstraintFailure("unique", "rows_pkey")) == "ConstraintFailure (unique: rows_pkey)"


@pytest.mark.parametrize("flight, committed, acked, left", [
    (range(1, 6), [], None, 5), (range(1, 6), [1, 2, 3], 3, 2), (range(1, 6), range(1, 6), 5, 0), (range(4, 8), [4, 6, 7], 4, 3), (range(1, 8), [1, 2, 3, 4, 6, 7], 4, 3),
    (range(5, 8), [6, 7], None, 3), (range(1, 9), [1, 2, 4, 5, 7, 8], 2, 6), (range(10, 13), [1, 2, 3], None, 3), (range(100, 105), [100, 101], 101, 3),
])
def test_gapless_prefix(spark, flight, committed, acked, left):
    rows = spark.createDataFrame([(p, p in committed) for p in flight], "position bigint, committed boolean")
    assert tuple(ops.gapless_prefix(rows).first()) == (acked, left)


def test_curves(spark):
    assert [scalars.circuit_delay_ms(n) for n in range(1, 9)] == [0, 100, 500, 1000, 5000, 15000, 30000, 30000]
    assert [r[0] for r in spark.range(1, 9).select(scalars.circuit_delay(F.col("id"))).collect()] == [0, 100, 500, 1000, 5000, 15000, 30000, 30000]
    assert [scalars.subscribe_delay_ms(n) for n in range(1, 7)] == [50, 100, 200, 400, 800, 1000]
    assert scalars.subscribe_delay_ms(35) == 1000 and 60001 <= scalars.subscribe_delay_ms(36) <= 65000


def test_partitions_are_even_and_stable(spark):
    counts = [r["count"] for r in spark.range(10_000).select(scalars.partition_of(F.concat(F.lit("stream-"), "id"), 16).alias("p")).groupBy("p").count().collect()]
    assert len(counts) == 16 and all(abs(c - 625) <= 0.25 * 625 for c in counts)
    with pytest.raises(ValueError):
        scalars.partition_of(F.lit("a"), 0)


def test_circuit():
    c = Circuit()
    assert c.wiped(2)
    c = Circuit()
    assert [c.wiped(1) for _ in range(3)] == [False, False, True]
    c.applied()
    assert not c.wiped(1) and c.replay_ms() == 0 and c.replay_ms() == 100
    assert Budget(2, 60).spend(0)


def test_retry_plans():
    assert config.retry_plan(False) == (1, []) and config.retry_plan(None) == config.retry_plan(True) == (3, [100, 1000, 10000])
    assert config.retry_plan({"attempts": 2}) == (2, [100, 1000, 10000])
    for wrong in ({"attempts": 0}, {"attempts": 3, "backoff": [1]}, {"backoff": [-1, 2, 3]}, {"backoff": ["x", 1, 2]}, {"tries": 1}):
        with pytest.raises(ValueError):
            config.retry_plan(wrong)


def test_declaration_errors():
    good = dict(name="p", source=MemoryLog([]), target=MemoryTarget(), handler=insert, parallelism=1)
    for change, said in (({"repo": 1, "zzz": 1}, "repo"), ({"zzz": 1}, "unknown"), ({"parallelism": 0}, "parallelism"), ({"version": 0}, "version"), ({"partition_by": "type"}, "stream_id"), ({"source": 1}, "source"), ({"target": 1}, "target"), ({"handler": 1}, "handler")):
        with pytest.raises(ValueError, match=said):
            config.declare(**(good | change))
    with pytest.raises(ValueError, match="parallelism"):
        config.declare(**{k: v for k, v in good.items() if k != "parallelism"})
    with pytest.warns(UserWarning, match="version"):
        config.declare(**(good | {"name": "p_v2"}))


MATRIX = {"initializing": "", "running": "pause stop", "paused": "resume stop", "draining": "", "halted": "stop", "stopped": ""}


@pytest.mark.parametrize("state", MATRIX)
@pytest.mark.parametrize("command", ["pause", "resume", "stop"])
def test_state_matrix(state, command):
    c = Coordinator(state=state)
    call = c.drain if command == "stop" else getattr(c, command)
    if command in MATRIX[state].split():
        call()
    else:
        with pytest.raises(InvalidState):
            call()


def test_halts_keep_their_first_reason_and_losses_come_back():
    c = Coordinator()
    assert c.ready() and c.state == "running"
    c.pause()
    c.lost()
    assert c.state == "initializing" and not c.ready() and c.state == "paused"
    assert c.halt("one") and not c.halt("two") and c.halt_reason == "one"


def test_claims():
    assert ops.claims([(1, ["a", "b"]), (2, ["b", "c"]), (3, ["c"]), (4, ["position"]), (5, ["merge"]), (6, ["merge"])]) == {2, 4}


def test_dead_letter_queries(spark):
    t = datetime.datetime(2026, 1, 1)
    rows = [(i, "p", 1, pos, s, "x", "{}", k, None, None, t + datetime.timedelta(seconds=i)) for i, (s, pos, k) in enumerate([("a", 1, "error"), ("b", 2, "error"), ("b", 3, "ArgumentError")], 1)]
    table = spark.createDataFrame(rows, model.DEAD_LETTERS)
    page = lambda **o: [r["position"] for r in inspection.dead_letter_page(table, "p", **o).collect()]
    assert page() == [3, 2, 1] and page(order="asc") == [1, 2, 3] and page(order="other") == [3, 2, 1] and page(stream_id="a") == [1] and page(limit=1, offset=1) == [2]
    assert inspection.dead_letter_count(table, "p", error_kind="ArgumentError").first()[0] == 1 and inspection.dead_letter_count(table, "p", 2).first()[0] == 0
    assert inspection.dead_letter_count(table, "p", since=F.lit("2027-01-01").cast("timestamp")).first()[0] == 0
    stats = {r["error_kind"]: r["n"] for r in inspection.dead_letter_stats(table, "p").collect()}
    assert stats == {"error": 2, "ArgumentError": 1, None: 3}


# ---------------------------------------------------------------- batches through targets

def epoch(tmp_path, *tables):
    return EpochTarget(f"file://{tmp_path}/target", tables or (ROWS,))


@pytest.mark.parametrize("kind", ["memory", "epoch"])
def test_a_failed_event_is_recorded_and_passed(spark, tmp_path, kind):
    target = MemoryTarget([ROWS]) if kind == "memory" else epoch(tmp_path)
    p = declared(target)
    items = [event(1), event(2, type="bad"), event(3), event(4, "b", "boom"), event(5, "b", "odd"), event(6, "c", "other")]
    report = Processor(spark, p)(frame(spark, items), 0)
    assert (report.attempted, report.applied) == (2, 2)
    assert {r["event_id"] for r in target.table(spark, "entries").collect()} == {"e1", "e3"}
    assert dict(tuple(r) for r in target.cursors(spark, p.identity).collect()) == {"a": 3, "b": 5}  # a skip moves no cursor
    letters = {r["position"]: r["error_kind"] for r in target.table(spark, "dead_letters").collect()}
    assert letters == {2: "error", 4: "builtins.ValueError", 5: "invalid_return"}
    Processor(spark, p)(frame(spark, items), 1)  # a redelivery changes nothing
    assert target.table(spark, "entries").count() == 2 and target.table(spark, "dead_letters").count() == 3


@pytest.mark.parametrize("kind", ["memory", "epoch", "jdbc"])
def test_integrity_failures_are_isolated(spark, tmp_path, kind):
    target = MemoryTarget([ROWS]) if kind == "memory" else epoch(tmp_path) if kind == "epoch" else JdbcTarget(spark, "jdbc:derby:memory:isolated;create=true", [ROWS])
    if kind == "jdbc":
        target.create_tables()
    p = declared(target, handler=lambda e, m: model.Insert("entries", {"event_id": "same" if e.position < 3 else e.id, "stream_id": e.stream_id, "position": e.position}))
    report = Processor(spark, p)(frame(spark, [event(1), event(2), event(3)]), 0)
    assert report.applied == 2 and report.broken == [(2, "23505")]
    assert [tuple(r) for r in target.cursors(spark, p.identity).collect()] == [("a", 3)]
    kinds = [r[0] for r in target.table(spark, "dead_letters").select("error_kind").collect()]
    assert kinds == ["commit:23505 (unique_violation)"]


def test_transient_failures_replay_and_structural_ones_halt(spark):
    for state, raised in (("40P01", Replay), ("42703", Halted)):
        target = MemoryTarget([ROWS], fail=lambda p, s=state: failure.CommitFailure(s))
        with pytest.raises(raised):
            Processor(spark, declared(target))(frame(spark, [event(1), event(2)]), 0)
        assert not target.log and not target.positions and not target.letters


def test_a_wipeout_halts_before_anything_moves(spark):
    target = MemoryTarget([ROWS], fail=lambda p: failure.CommitFailure("23502"))
    with pytest.raises(Halted):
        Processor(spark, declared(target))(frame(spark, [event(1), event(2)]), 0)
    assert not target.positions and not target.letters


def test_unknown_tables_and_columns_halt(spark, tmp_path):
    for n, op in enumerate((model.Insert("none", {"x": 1}), model.Insert("entries", {"event_id": 1, "zzz": 2}))):
        target = epoch(tmp_path / str(n))
        with pytest.raises(Halted):
            Processor(spark, declared(target, handler=lambda e, m, op=op: op))(frame(spark, [event(1)]), 0)
        assert target.table(spark, "positions").count() == 0


def test_colliding_keys(spark, tmp_path):
    target = epoch(tmp_path, ACCOUNTS)
    p = declared(target, handler=lambda e, m: model.Multi({"same": model.Upsert("accounts", {"id": e.stream_id}, inc={"balance": 1})}))
    Processor(spark, p)(frame(spark, [event(1), event(2)]), 0)
    assert [r["error_kind"] for r in target.table(spark, "dead_letters").collect()] == ["multi_key_collision"]
    assert target.table(spark, "accounts").first()["balance"] == 1 and target.cursors(spark, p.identity).first()[1] == 2


def test_operations_follow_each_other_across_batches(spark, tmp_path):
    target = epoch(tmp_path, ACCOUNTS)

    def ledger(e, m):
        where = {"id": e.stream_id}
        return {"open": model.Insert("accounts", where | {"balance": 0}), "add": model.Multi({f"add-{e.id}": model.Update("accounts", where, inc={"balance": e.data["n"]})}), "see": model.Update("accounts", where, set={"seen": e.position}), "close": model.Delete("accounts", where)}[e.type]

    p = declared(target, handler=ledger)
    kinds = ["see", "open", "add", "see", "add", "close", "add", "open", "add"]
    items = [event(i, type=k, data={"n": 10 * i}) for i, k in enumerate(kinds, 1)]
    run_bounded(spark, p, frame(spark, items[:4]))
    assert tuple(target.table(spark, "accounts").first()) == ("a", 30, 4)
    run_bounded(spark, p, frame(spark, items[4:]), 2)
    assert tuple(target.table(spark, "accounts").first()) == ("a", 90, None)


def test_staged_data_without_a_manifest_is_not_there(spark, tmp_path, monkeypatch):
    target = epoch(tmp_path)
    p = declared(target)
    monkeypatch.setattr(target, "publish", lambda *_: (_ for _ in ()).throw(failure.CommitFailure("40001")))
    with pytest.raises(Replay):
        Processor(spark, p)(frame(spark, [event(1)]), 0)
    monkeypatch.undo()
    assert target.table(spark, "entries").count() == target.table(spark, "positions").count() == 0
    Processor(spark, p)(frame(spark, [event(1)]), 0)
    assert target.table(spark, "entries").count() == 1 and target.already(p.identity, 0, spark)


def test_versions_and_reset_are_apart(spark, tmp_path):
    target = epoch(tmp_path)
    one, two = declared(target), declared(target, version=2, handler=lambda e, m: model.Skip() if e.position > 1 else model.Error("x"))
    for p in (one, two):
        Processor(spark, p)(frame(spark, [event(1), event(2)]), 0)
    assert target.reset(spark, two.identity) == {"positions": 1, "progress": 1}
    assert target.cursors(spark, one.identity).count() == 1 and target.cursors(spark, two.identity).count() == 0
    assert target.table(spark, "dead_letters").count() == 1 and target.reset(spark, two.identity, True)["dead_letters"] == 1


def test_compaction_keeps_everything(spark, tmp_path):
    target = EpochTarget(f"file://{tmp_path}/target", (ROWS,), compact_at=2)
    p = declared(target)
    for i in range(1, 5):
        Processor(spark, p)(frame(spark, [event(i)]), i)
    assert target.table(spark, "entries").count() == 4 and target.cursors(spark, p.identity).first()[1] == 4
    assert all(len(v) <= 3 for v in target.manifest(spark)["live"].values())


def test_retries_run_where_the_handler_runs(spark, tmp_path):
    mark = tmp_path / "calls"

    def flaky(e, m):
        calls = len(mark.read_text()) if mark.exists() else 0
        mark.write_text("x" * (calls + 1))
        return model.Error("again") if calls < 2 else insert(e, m)

    target = MemoryTarget([ROWS])
    Processor(spark, declared(target, handler=flaky, retry={"attempts": 3, "backoff": [1, 1]}))(frame(spark, [event(1)]), 0)
    assert len(mark.read_text()) == 3 and len(target.log) == 1 and target.letters == {("p", 1): []}


@pytest.mark.parametrize("seed", range(3))
def test_order_cursors_and_conservation_hold_for_random_logs(spark, seed):
    rng = random.Random(seed)
    items = [event(i, f"s{rng.randrange(5)}", rng.choice(["add", "add", "bad", "other", "odd"])) for i in range(1, rng.randrange(20, 60))]
    target = MemoryTarget([ROWS])
    source = MemoryLog(items)
    p = declared(target, source)
    drain(spark, p, 16)
    assert source.pending == 0
    last = {}
    for _, stream, position in target.log:
        assert position > last.get(stream, 0)
        last[stream] = position
    cursor = target.positions[p.identity]
    assert all(cursor[s] >= n for s, n in last.items())
    skipped = sum(e.type == "other" for e in items)
    assert len(items) == len(target.log) + len(target.letters[p.identity]) + skipped
    before = (list(target.log), dict(cursor))
    drain(spark, declared(target, MemoryLog(items)), 16)
    assert (target.log, target.positions[p.identity]) == before


@pytest.mark.parametrize("seed", range(2))
def test_inserts_alone_fold_like_any_steps(spark, seed):
    rng = random.Random(seed)
    table = model.Table("t", "a string, b bigint, v string", ("a", "b"), ("v",))
    maps = "map<string,string>"
    rows = []
    for position in rng.sample(range(500), 60):
        for k in range(rng.randrange(1, 4)):
            given = {"a": rng.choice("xyz"), "b": rng.choice("123"), "v": rng.choice(["one", "two", None])}
            if rng.random() < 0.2:
                del given[rng.choice("abv")]
            rows.append((position, "s", k, "insert", rng.choice(["t", "t", "other"]), None, {}, given, {}))
    steps = spark.createDataFrame(rows, f"position bigint, stream_id string, k int, action string, table string, name string, key {maps}, set {maps}, inc map<string,bigint>").repartition(4)
    current = spark.createDataFrame([("x", 1, "old"), ("z", 3, "old")], table.schema)
    as_rows = lambda df: sorted((tuple(map(str, r["id"])), r["there"], tuple(sorted(r["row"].items())), [tuple(b) for b in r["broken"]]) for r in df.collect())
    found = as_rows(folds.inserts(steps, current, table))
    assert found == as_rows(folds.fold(steps, current, table)) and any(r[3] for r in found)
    assert folds.inserts(steps.where("false"), current, table).count() == 0


# ---------------------------------------------------------------- streaming

LOG = "id string, stream_id string, type string, data string, metadata map<string,string>, position bigint, occurred_at timestamp"


def write_log(spark, path, items):
    frame(spark, items).coalesce(1).write.mode("append").parquet(str(path))


def test_a_stream_survives_crashes_and_applies_each_event_once(spark, tmp_path):
    for i in range(4):
        write_log(spark, tmp_path / "log", [event(j, f"s{j % 3}") for j in range(5 * i + 1, 5 * i + 6)])
    target = epoch(tmp_path)
    crashes = iter([True, False, True, False, False, False, False, False])
    whole = target.publish

    def publish(*args):
        if next(crashes, False):
            raise failure.CommitFailure("40P01")
        whole(*args)

    target.publish = publish
    p = declared(target, ParquetLog(f"file://{tmp_path}/log", LOG, max_files=1), name="crashing", lag_interval_ms=0)
    engine = Engine(spark, f"file://{tmp_path}/checkpoints")
    engine.start(p)
    import time

    until = time.time() + 90
    while target.table(spark, "entries").count() < 20 and time.time() < until:
        time.sleep(0.5)
    engine.await_idle(p)
    assert sorted(r["position"] for r in target.table(spark, "entries").collect()) == list(range(1, 21))
    info = engine.info(p)
    assert info.position == 20 and info.stream_positions == {"s0": 18, "s1": 19, "s2": 20} and info.safe_position == 18
    with pytest.raises(ValueError):
        engine.start(p)
    engine.pause(p)
    with pytest.raises(InvalidState):
        engine.pause(p)
    with pytest.raises(InvalidState):
        engine.reset(p)
    write_log(spark, tmp_path / "log", [event(21, "s0")])
    engine.resume(p)
    until = time.time() + 60
    while target.table(spark, "entries").count() < 21 and time.time() < until:
        time.sleep(0.5)
    assert target.table(spark, "entries").count() == 21
    engine.stop(p)
    assert engine.list() == [{"name": "crashing", "version": 1, "state": "stopped"}]
    assert engine.reset(p)["positions"] == 3


def test_leases(spark, tmp_path):
    a, b = (Lease(spark, f"file://{tmp_path}/x") for _ in range(2))
    assert a.take() and not b.take() and a.renew()
    waits = []
    with pytest.raises(TimeoutError):
        b.wait("x", most=3, sleep=waits.append)
    assert waits == [0.05, 0.1]
    a.release()
    assert b.wait("x") == 1


def test_trying_out(spark):
    p = declared(MemoryTarget([ROWS]))
    assert isinstance(testing.handle(p, {"n": 1}, type="bad"), model.Error) and isinstance(testing.handle(p, {"n": 1}, type="boom"), ValueError)
    found = testing.project(spark, p, [{"n": 1}, ({"n": 2}, {"type": "bad"}), ({"n": 3}, {"type": "odd"}), ({"n": 4}, {"type": "other"})])
    assert (found.committed, found.skipped, found.failed, found.invalid) == (1, 1, 1, 1)
    assert p.target.positions[p.identity] == {testing.STREAM: 1}
    same = declared(MemoryTarget([ROWS]), handler=lambda e, m: model.Insert("entries", {"event_id": "x", "stream_id": "s", "position": 1}))
    with pytest.raises(failure.BatchCommitError):
        testing.project(spark, same, [{"n": 1}, {"n": 2}])


def test_envelopes(spark):
    rows = spark.sql("SELECT 7L AS n, 'x' AS s, cast(null AS map<string,string>) AS m, timestamp_ntz'2026-05-14 12:00:00' AS t")
    found = ops.envelope(rows, id=F.col("n"), stream_id=F.col("s"), type=F.lit("k"), position=F.col("n"), occurred_at=F.col("t"), data=F.lit("{}"), metadata=F.col("m")).first()
    assert found["metadata"] == {} and found["occurred_at"] == datetime.datetime(2026, 5, 14, 12) and found["id"] == "7"
    assert handlers.to_result(model.Update("t", {"a": 1}))["kind"] == "invalid"


def test_schema_versions(spark):
    assert model.schema_steps(0, 2) == ["positions", "dead_letters", "progress"] and model.schema_steps(1, 2) == ["progress"]
    for wrong in ((0, 3), (-1, 1), (2, 1)):
        with pytest.raises(ValueError):
            model.schema_steps(*wrong)
    target = JdbcTarget(spark, "jdbc:derby:memory:versions;create=true", [ROWS])
    target.create_tables(0, 1)
    target.create_tables()  # what is there stays
    target.drop_tables()
    assert not target._there("positions") and target._there("entries")


def test_dead_letters_are_told_after_the_commit(spark, tmp_path):
    from foldlog.telemetry import bus

    heard = []
    detach = bus.attach("dead_letter", lambda name, measured, said: heard.append((said["position"], said["error_kind"])))
    try:
        for target in (MemoryTarget([ROWS]), epoch(tmp_path)):
            Processor(spark, declared(target))(frame(spark, [event(1), event(2, type="bad")]), 0)
    finally:
        detach()
    assert heard == [(2, "error")] * 2


# ---------------------------------------------------------------- nothing is lost, nothing comes twice

def positions(spark, target):
    return sorted(r["position"] for r in target.table(spark, "entries").collect())


def test_a_stream_after_a_bounded_run_applies_the_rest(spark, tmp_path):
    for i in range(4):
        write_log(spark, tmp_path / "log", [event(j, f"s{j % 3}") for j in range(5 * i + 1, 5 * i + 6)])
    target = epoch(tmp_path)
    p = declared(target, ParquetLog(f"file://{tmp_path}/log", LOG, max_files=1, buffer_size=2), name="after", lag_interval_ms=0)
    run_bounded(spark, p, p.source.batch(spark).where("position <= 10"))
    assert positions(spark, target) == list(range(1, 11))
    engine = Engine(spark, f"file://{tmp_path}/checkpoints", {"availableNow": True})
    engine.start(p).query.awaitTermination()
    assert positions(spark, target) == list(range(1, 21))
    assert engine.cursor(p, "s1") == 19 and engine.cursor("after", "none") is None and engine.watermark("after")[0] == 20
    assert engine.dead_letters("after").count() == 0 and engine.dead_letter_stats(p).count() == 1
    engine.stop(p)


def test_what_comes_while_paused_arrives_after_a_start_from_current(spark, tmp_path):
    write_log(spark, tmp_path / "log", [event(j) for j in range(1, 6)])
    target = epoch(tmp_path)
    p = declared(target, ParquetLog(f"file://{tmp_path}/log", LOG, start_from="current"), name="current", lag_interval_ms=0)
    engine = Engine(spark, f"file://{tmp_path}/checkpoints")
    engine.start(p)
    write_log(spark, tmp_path / "log", [event(j) for j in range(6, 11)])
    engine.await_idle(p)
    assert positions(spark, target) == list(range(6, 11))
    engine.pause(p)
    write_log(spark, tmp_path / "log", [event(j) for j in range(11, 16)])
    engine.resume(p)
    engine.await_idle(p)
    assert positions(spark, target) == list(range(6, 16))
    engine.stop(p)
    write_log(spark, tmp_path / "log", [event(j) for j in range(16, 21)])
    engine = Engine(spark, f"file://{tmp_path}/checkpoints")  # as after a restart
    engine.start(p)
    engine.await_idle(p)
    engine.stop(p)
    assert positions(spark, target) == list(range(6, 21))


def test_a_second_drain_goes_on(spark, tmp_path):
    target = epoch(tmp_path)
    source = MemoryLog([event(j) for j in range(1, 6)])
    p = declared(target, source)
    drain(spark, p, 5)
    source.items += [event(j) for j in range(6, 11)]
    drain(spark, p, 5)
    assert positions(spark, target) == list(range(1, 11)) and source.acknowledged == 10


def test_small_batches_share_a_pass(spark, tmp_path):
    target = epoch(tmp_path, ACCOUNTS)
    p = declared(target, handler=lambda e, m: model.Multi({"same": model.Upsert("accounts", {"id": e.stream_id}, inc={"balance": 1}), f"own-{e.id}": model.Upsert("accounts", {"id": f"x{e.position}"}, inc={"balance": 1})}))
    reports = run_bounded(spark, p, frame(spark, [event(j) for j in range(1, 8)]), 2)
    assert len(reports) == 1
    # of each two events the second collides
    assert sorted(r["position"] for r in target.table(spark, "dead_letters").collect()) == [2, 4, 6]
    assert target.table(spark, "accounts").where("id = 'a'").first()["balance"] == 4
    # the guard judges batches, too: the first of them fails whole
    rows = epoch(tmp_path / "guard")
    p = declared(rows, handler=lambda e, m: model.Insert("entries", {"event_id": None if e.position < 3 else e.id, "stream_id": e.stream_id, "position": e.position}))
    with pytest.raises(Halted):
        run_bounded(spark, p, frame(spark, [event(j) for j in range(1, 8)]), 2)
    assert rows.table(spark, "entries").count() == 0 and rows.table(spark, "positions").count() == 0


@pytest.mark.parametrize("kind", ["memory", "epoch", "jdbc"])
def test_updates_and_deletes_by_any_filter(spark, tmp_path, kind):
    table = model.Table("items", "id bigint, grp string, n bigint", ("id",))
    target = MemoryTarget([table]) if kind == "memory" else epoch(tmp_path, table) if kind == "epoch" else JdbcTarget(spark, "jdbc:derby:memory:filters;create=true", [table])
    if kind == "jdbc":
        target.create_tables()
    acts = {
        "new": lambda e: model.Insert("items", {"id": e.position, "grp": e.data["v"], "n": 0}), "mark": lambda e: model.Update("items", {"grp": e.data["v"]}, {"n": e.position}),
        "move": lambda e: model.Update("items", {"grp": e.data["v"]}, {"grp": e.data["v"] + "x"}), "gone": lambda e: model.Delete("items", {"grp": e.data["v"]}),
        "both": lambda e: model.Update("items", {"id": e.data["v"], "grp": "g"}, {"n": -1}), "all": lambda e: model.Update("items", {}, {"n": e.position}),
    }
    p = declared(target, handler=lambda e, m: acts[e.type](e))
    todo = [("new", "g"), ("new", "h"), ("mark", "g"), ("new", "g"), ("mark", "g"), ("both", 2), ("both", 1), ("gone", "h"), ("new", "h"), ("mark", "h")]
    Processor(spark, p)(frame(spark, [event(i, type=k, data={"v": d}) for i, (k, d) in enumerate(todo, 1)]), 0)
    rows = lambda: {tuple(r) for r in target.table(spark, "items").select("id", "grp", "n").collect()}
    assert rows() == {(1, "g", -1), (4, "g", 5), (9, "h", 10)}
    more = [("move", "g"), ("mark", "gx"), ("move", "gx"), ("gone", "gxx"), ("new", "k"), ("all", "")]
    Processor(spark, p)(frame(spark, [event(i, type=k, data={"v": d}) for i, (k, d) in enumerate(more, 11)]), 1)
    assert rows() == {(9, "h", 16), (15, "k", 16)}


def test_only_one_of_two_writers_gets_a_lease_or_an_epoch(spark, tmp_path):
    from foldlog.streaming import files

    a, b, c = (Lease(spark, f"file://{tmp_path}/x", seconds=0.3) for _ in range(3))
    assert a.take() and a.held()
    time.sleep(0.4)
    assert not a.held()
    seen = b._newest()
    assert c.take() and not b._next(seen[0], b.owner)  # both saw the same lease expire
    assert not a.renew() and c.renew() and c.holder()[0] == c.owner
    c.release()
    assert c.holder() is None and not c.renew() and b.take()
    assert files.create(spark, f"file://{tmp_path}/f", "one") and not files.create(spark, f"file://{tmp_path}/f", "two") and files.read(spark, f"file://{tmp_path}/f") == "one"
    target = epoch(tmp_path)
    found = target.manifest(spark)
    target.publish(spark, found)
    with pytest.raises(failure.CommitFailure):
        target.publish(spark, found)


def test_a_lost_lease_halts(spark, tmp_path):
    write_log(spark, tmp_path / "log", [event(1)])
    p = declared(epoch(tmp_path), ParquetLog(f"file://{tmp_path}/log", LOG), name="lost", lag_interval_ms=0)
    engine = Engine(spark, f"file://{tmp_path}/checkpoints", lease_seconds=2.0)
    own = engine.start(p)
    engine.await_idle(p)
    number = own.lease._newest()[0]
    while not Lease(spark, own.checkpoint)._next(number, "another"):
        number = own.lease._newest()[0]
    until = time.time() + 20
    while own.coordinator.state != "halted" and time.time() < until:
        time.sleep(0.1)
    assert engine.info(p).halt_reason == "the lease was lost"
    engine.stop(p)


def test_databases_keep_progress_and_whole_dead_letters(spark):
    from foldlog.telemetry import bus

    target = JdbcTarget(spark, "jdbc:derby:memory:parity;create=true", [ROWS])
    target.create_tables()
    p = declared(target)
    heard = []
    detach = bus.attach("event.", lambda name, measured, said: heard.append((name, measured["count"])))
    try:
        Processor(spark, p)(frame(spark, [event(1), event(2, type="bad"), event(3, "b", "boom")]), 0)
    finally:
        detach()
    assert ("event.start", 3) in heard and ("event.exception", 1) in heard
    letters = {r["position"]: r for r in inspection.dead_letter_page(target.table(spark, "dead_letters"), "p").collect()}
    assert set(letters) == {2, 3} and letters[2]["event_data"] and letters[3]["occurred_at"] is not None
    assert "ValueError" in target.table(spark, "dead_letters").where("position = 3").first()["error_stacktrace"]
    assert target.table(spark, "progress").first()["position"] == 3 and target.table(spark, "positions").where("updated_at is not null").count() == 2
    assert target.reset(spark, p.identity, True) == {"positions": 2, "progress": 1, "dead_letters": 2}
