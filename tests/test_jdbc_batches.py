"""Set-based commits into a database: as many statements for ten thousand events as for ten, and failures isolated."""

import random

import pytest
from pyspark.sql import functions as F

from foldlog import config, model
from foldlog.operators import handlers
from foldlog.sources.logs import MemoryLog
from foldlog.streaming.runtime import Processor
from foldlog.targets.epoch import EpochTarget
from foldlog.targets.jdbc import JdbcTarget

ACCOUNTS = model.Table("accounts", "id string, n bigint, seen bigint", ("id",), ("n",))


def database(spark, name):
    target = JdbcTarget(spark, f"jdbc:derby:memory:{name};create=true", [ACCOUNTS])
    target.create_tables()
    return target


def projection(target):
    to = F.get_json_object("data", "$.to")
    rules = (
        handlers.Rules().insert("open", "accounts", {"id": to, "n": F.lit(0)}).inc("add", "accounts", {"id": to}, {"n": F.lit(2)}, name=F.col("id"))
        .update("see", "accounts", {"id": to}, {"seen": F.col("position")}).delete("close", "accounts", {"id": to}).skip("look").error("bad", "no")
    )
    return config.declare(name="p", source=MemoryLog([]), target=target, handler=rules, parallelism=2, retry=False)


def events(rng, n, first=1):
    kinds = ["open", "add", "add", "see", "close", "look", "bad"]
    return [model.Event(f"e{p}", f"s{p % 5}", rng.choice(kinds), {"to": f"k{rng.randrange(max(3, n // 20))}"}, p) for p in range(first, first + n)]


def state(spark, target, p):
    letters = sorted((r["position"], r["error_kind"], r["event_type"]) for r in target.table(spark, "dead_letters").collect())
    return sorted(map(tuple, target.table(spark, "accounts").select("id", "n", "seen").collect())), sorted(map(tuple, target.cursors(spark, p.identity).collect())), letters, target.table(spark, "progress").first()["position"]


def counted(target, monkeypatch):
    calls, run = [], target._run
    monkeypatch.setattr(target, "_run", lambda sql, values: calls.append(sql) or run(sql, values))
    return calls


def test_a_database_says_what_epochs_say_in_as_many_statements_for_many_events(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    target = database(spark, "sets")
    plain = EpochTarget(f"file://{tmp_path}/t", [ACCOUNTS])
    calls, statements, first = counted(target, monkeypatch), [], 1
    for n in (10, 10_000):
        own = MemoryLog._frame(spark, events(rng, n, first))
        first += n
        reports = [Processor(spark, projection(t))(own, None) for t in (target, plain)]
        assert reports[0].broken == reports[1].broken and reports[0].applied == reports[1].applied
        statements.append(len(calls))
        calls.clear()
        calls.clear()
    Processor(spark, projection(target))(own, None)  # again: nothing changes
    assert max(statements) <= 15  # the first one also begins the progress row
    assert state(spark, target, projection(target)) == state(spark, plain, projection(plain))
    assert not [r for r in target._query("SELECT tablename FROM sys.systables", 1, []) if r[0].startswith("STAGED")]


def test_what_only_the_database_knows_is_isolated(spark, monkeypatch):
    target = database(spark, "own")
    target._run("ALTER TABLE accounts ADD CONSTRAINT few CHECK (n < 5)", [])
    target.connection.commit()
    p = projection(target)
    own = [model.Event(f"e{k}", "s", kind, {"to": to}, k) for k, (kind, to) in enumerate([("open", "a"), ("add", "a"), ("add", "a"), ("add", "a"), ("open", "x" * 300), ("open", "b")], 1)]
    report = Processor(spark, p)(MemoryLog._frame(spark, own), None)
    assert [b[0] for b in report.broken] == [4, 5] and report.applied == 4
    rows, cursors, letters, progress = state(spark, target, p)
    assert rows == [("a", 4, None), ("b", 0, None)] and cursors == [("s", 6)] and progress == 6
    assert [(x[0], x[1][:12]) for x in letters] == [(4, "commit:23513"), (5, "commit:22001")]
