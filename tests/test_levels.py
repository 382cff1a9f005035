"""Levels of a table in epochs: what a pass reads of it, what merging keeps, and what is cleared."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from foldlog import config, model
from foldlog.functions.failure import CommitFailure
from foldlog.operators import handlers
from foldlog.sources.logs import MemoryLog
from foldlog.streaming.runtime import Processor
from foldlog.targets.epoch import EpochTarget

ACCOUNTS = model.Table("accounts", "id string, n bigint", ("id",))


def projection(target):
    rules = handlers.Rules().inc("add", "accounts", {"id": F.get_json_object("data", "$.to")}, {"n": F.lit(1)}, name=F.col("id")).delete("drop", "accounts", {"id": F.get_json_object("data", "$.to")})
    return config.declare(name="p", source=MemoryLog([]), target=target, handler=rules, parallelism=2, retry=False)


def run(spark, p, events):
    items = [model.Event(f"e{at}", f"s{at % 7}", kind, {"to": to}, at) for at, kind, to in events]
    Processor(spark, p)(MemoryLog._frame(spark, items), None)


@pytest.mark.parametrize("retain", [0.0, 3600.0])
def test_merged_levels_say_what_the_steps_said(spark, tmp_path, retain):
    rng, wanted, position = random.Random(5), {}, 0
    target = EpochTarget(f"file://{tmp_path}/t", [ACCOUNTS], compact_at=2, buckets=8, retain_seconds=retain)
    p = projection(target)
    for turn in range(10):
        events = []
        for _ in range(8):
            position += 1
            kind, to = rng.choice(["add", "add", "add", "drop"]), f"k{rng.randrange(12)}"
            events.append((position, kind, to))
            if kind == "add":
                wanted[to] = wanted.get(to, 0) + 1
            else:
                wanted.pop(to, None)
        run(spark, p, events)
        if turn in (2, 7):
            run(spark, p, events)  # redelivered
    assert {r["id"]: r["n"] for r in target.table(spark, "accounts").collect()} == wanted
    assert {r["stream_id"]: r["position"] for r in target.cursors(spark, p.identity).collect()} == {f"s{at % 7}": at for at in range(position - 6, position + 1)}
    live = target.manifest(spark)["live"]["accounts"]
    assert any("-L2" in x for x in live) and len(live) <= 5
    there = os.listdir(tmp_path / "t/data/accounts")
    if retain:
        assert len(there) > 10
    else:
        target.compact(spark)
        live = target.manifest(spark)["live"]["accounts"]
        assert sorted(os.listdir(tmp_path / "t/data/accounts")) == sorted(x.rpartition("/")[2] for x in live)
        assert len([n for n in os.listdir(tmp_path / "t/manifests") if n.endswith(".json")]) <= 3


def test_a_pass_reads_only_the_buckets_of_its_keys(spark, tmp_path):
    target = EpochTarget(f"file://{tmp_path}/t", [ACCOUNTS], compact_at=1, buckets=200)
    p = projection(target)
    for k in range(2):
        run(spark, p, [(1 + i + 500 * k, "add", f"k{i}") for i in range(500)])
    found = target.manifest(spark)
    assert [x for x in found["live"]["accounts"] if "-L1" in x]
    keys = spark.createDataFrame([("k3",), ("k77",)], "id string")
    buckets = target.touched(keys, "accounts", found)
    assert len(buckets) <= 2
    pruned = target.table(spark, "accounts", found, buckets)
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    asked = re.search(r"PartitionFilters: \[(.*?)\], ", plan).group(1)
    assert "__bucket" in asked and pruned.count() < 30 < target.table(spark, "accounts").count() and {"k3", "k77"} <= {r["id"] for r in pruned.collect()}
    files = {f.getPath().toString() if hasattr(f, "getPath") else f for f in pruned.inputFiles()}
    assert files
    run(spark, p, [(1001, "add", "k3"), (1002, "drop", "k77"), (1003, "add", "new")])
    rows = {r["id"]: r["n"] for r in target.table(spark, "accounts").collect()}
    assert rows["k3"] == 3 and "k77" not in rows and rows["new"] == 1 and rows["k4"] == 2 and len(rows) == 500
    streams = spark.createDataFrame([("s3",)], "stream_id string")
    assert target.cursors_of(spark, p.identity, streams).where("stream_id = 's3'").first()["position"] == 997 and target.cursors_of(spark, ("other", 1), streams).count() == 0


def test_a_number_that_was_cleared_is_not_taken_again(spark, tmp_path):
    target = EpochTarget(f"file://{tmp_path}/t", [ACCOUNTS])
    p = projection(target)
    old = target.manifest(spark)
    for k in range(3):
        run(spark, p, [(k + 1, "add", "a")])
    os.remove(tmp_path / "t/manifests/000000000001.json")
    with pytest.raises(CommitFailure):
        target.publish(spark, old)
    assert target.table(spark, "accounts").first()["n"] == 3
