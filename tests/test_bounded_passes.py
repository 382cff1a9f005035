"""Bounded passes over a large log: rows of a pass only, one reading of them, refused events left on the executors."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldlog.plans import registry
from foldlog.sources.logs import event_range
from foldlog.streaming.runtime import Processor, run_bounded
from foldlog.targets.base import Refused

SF = "/root/testdata/sf0.001"


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_a_range_skips_by_the_tables_own_ids_and_is_that_part_of_the_log(spark):
    found = event_range(spark, SF, 11, 40)
    assert "GreaterThanOrEqual(event_id,10)" in plan(found)
    assert sorted(found.collect()) == sorted(registry.log(spark, SF).where(F.col("position").between(11, 40)).collect())


def test_rules_read_a_pass_once(spark, tmp_path):
    target, projection = registry._declared(spark, registry.ACCOUNTS, registry.account_rules())
    process = Processor(spark, projection, scratch=f"file://{tmp_path}")
    events = registry.log(spark, SF)
    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda x: seen.add(1) or x)
    process._evaluated(events.withColumn("type", count(F.col("type"))), f"file://{tmp_path}/once")
    assert seen.value == events.count()


def test_refused_events_stay_on_the_executors(spark):
    target, projection = registry._declared(spark, registry.ACCOUNTS, registry.account_rules())
    reports = run_bounded(spark, projection, registry.log(spark, SF), events_per_batch=100, in_flight=500)
    broken = [r.broken for r in reports]
    assert all(isinstance(b, Refused) and b._rows is None for b in broken) and sum(map(len, broken)) > 0
    letters = target.table(spark, "dead_letters").where("error_kind like 'commit:%'").select("position").collect()
    assert sorted(r[0] for r in letters) == sorted(p for b in broken for p, _ in b)
    assert broken[0][0] == broken[0][:1][0] == next(iter(broken[0]))
    # the folders of these positions are dead from the start, so that they are cleared
    dead = [p for p, _ in target.manifest(spark)["dead"]]
    assert len([p for p in dead if p.startswith("data/refused/")]) == sum(len(b) > 0 for b in broken)


def exchanges(frame) -> int:
    return plan(frame).count("Exchange hashpartitioning")


def test_a_pass_is_dealt_out_once(spark):
    from foldlog.operators import events as ops

    target, projection = registry._declared(spark, registry.ACCOUNTS, registry.account_rules())
    events = event_range(spark, SF, 1, 100)
    marked = ops.dedup(events, target.cursors_of(spark, projection.identity, events))
    assert exchanges(marked) == 1  # the search for repeats goes on from it, and no cursors means no join
    assert "from_json" in plan(marked) and "from_json" not in plan(marked.drop("metadata"))


def test_outcomes_told_by_type_are_those_of_the_results(spark, tmp_path):
    from foldlog.operators import handlers

    rules = handlers.Rules().insert("a", "t", {"x": F.lit(1)}).insert("b", "t", {}).update("c", "t", {"x": F.lit(1)}, {}).delete("d", "t", {}).inc("e", "t", {"x": F.lit(1)}, {}).skip("f").error("g", "no").update("h", "t", {}, {"x": F.lit(1)}).skip("a")
    frame = spark.createDataFrame([(t,) for t in [*"abcdefghi", None]], "type string")
    both = rules.apply(frame).select("type", handlers.outcome(F.col("result")).alias("slow"), rules.outcome().alias("fast")).collect()
    assert [r.fast for r in both] == [r.slow for r in both] and {r.fast for r in both} == {"applied", "invalid", "skipped", "failed"}
    assert rules.on("j", handlers.result("skip")).outcome() is None and handlers.Rules().otherwise(handlers.result("skip")).outcome() is None


def test_counts_taken_while_writing_are_those_of_the_table(spark, tmp_path):
    from foldlog.targets.base import batch_stats

    target, projection = registry._declared(spark, registry.ACCOUNTS, registry.account_rules())
    process = Processor(spark, projection, scratch=f"file://{tmp_path}")
    for events in (registry.log(spark, SF), registry.log(spark, SF).where("position < 0")):
        outcomes, counts = process._handled(events, f"file://{tmp_path}/counted")
        assert "metadata" not in outcomes.columns and batch_stats(outcomes, counts) == batch_stats(outcomes)


def test_letters_are_numbered_by_counts_that_are_known(spark):
    from foldlog.operators import events as ops
    from foldlog.operators import inspection

    letters = spark.range(1, 200).where("id % 7 < 3").select(F.col("id").alias("position"))
    found = list(ops.counted_ranges(letters, 1, 199, 20))
    breaks, held = [a for a, _, _ in found], [n for *_, n in found]
    assert sum(held) == letters.count() and len(breaks) > 3
    known = inspection.numbered(letters, 5, breaks, held)
    assert sorted(known.collect()) == sorted(inspection.numbered(letters, 5).collect()) == sorted(inspection.numbered(letters, 5, breaks).collect())


def test_filters_meet_a_rows_own_value_from_its_step_on_and_each_pair_once(spark):
    from foldlog.operators import folds

    step = lambda position, action, key, set: (position, "s", 0, "e", action, "tickets", key, set, {})
    rows = [step(1, "update", {"user": "u"}, {"state": "early"}), step(2, "insert", {}, {"id": "a", "user": "u"}), step(3, "update", {"user": "u"}, {"state": "late"}), step(3, "update", {"user": "w"}, {"state": "other"})]
    steps = spark.createDataFrame(rows, "position bigint, stream_id string, k int, name string, action string, table string, key map<string,string>, set map<string,string>, inc map<string,bigint>")
    current = spark.createDataFrame([("old", "u", "open", None)], registry.TICKETS.schema)
    own = steps.where("action = 'insert'").select(F.array(F.col("set")["id"]).alias("id"), F.struct("position", "k", "action", "key", "set", "inc").alias("step"))
    have = current.select(F.array("id").alias("id"), F.create_map(F.lit("user"), F.col("user")).alias("old"))
    loose = [(("user",), ("state",))]
    pairs = folds._reached(steps.where("action = 'update'"), own, have, registry.TICKETS, loose).select(F.col("id")[0], "step.position").collect()
    assert sorted(map(tuple, pairs)) == [("a", 3), ("old", 1), ("old", 3)]
    done = {r["id"][0]: r["row"]["state"] for r in folds.fold(steps, current, registry.TICKETS, loose).collect()}
    assert done == {"a": "late", "old": "late"}
