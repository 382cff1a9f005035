"""Colliding keys by rounds, dense ids of dead letters, the books with collisions, and handlers tried out."""

import random

import pytest
from pyspark.sql import functions as F

from foldlog import config, model, testing
from foldlog.operators import events as ops
from foldlog.operators import handlers, inspection
from foldlog.sources.logs import MemoryLog
from foldlog.targets.epoch import EpochTarget
from foldlog.targets.memory import MemoryTarget


@pytest.fixture
def cut(spark, tmp_path):
    names = iter(range(10**6))

    def write(frame):
        path = f"file://{tmp_path}/{next(names)}"
        frame.write.parquet(path)
        return spark.read.schema(frame.schema).parquet(path)

    return write


@pytest.mark.parametrize(("seed", "rounds"), [(1, 40), (2, 40), (3, 1), (4, 0)])
def test_claims_by_rounds_are_those_in_order(spark, cut, seed, rounds):
    rng = random.Random(seed)
    names = [f"k{i}" for i in range(25)] + ["merge", "event"]
    rows = [(p % 3, p, [rng.choice(names[:-1] if rng.random() < 0.9 else names) for _ in range(rng.randrange(1, 4))]) for p in rng.sample(range(1000), 120)]
    found = {tuple(r) for r in ops.lost_claims(spark.createDataFrame(rows, "batch long, position long, keys array<string>").repartition(3), cut, rounds).collect()}
    wanted = {(b, p) for b in range(3) for p in ops.claims([(p, k) for x, p, k in rows if x == b])}
    assert found == wanted and wanted


def test_a_chain_of_claims_ends_in_one_task(spark, cut):
    rows = [(0, p, [f"k{p}", f"k{p + 1}"]) for p in range(60)]
    found = ops.lost_claims(spark.createDataFrame(rows, "batch long, position long, keys array<string>"), cut, 3)
    assert sorted(r["position"] for r in found.collect()) == list(range(1, 60, 2))
    assert ops.lost_claims(spark.createDataFrame([], "batch long, position long, keys array<string>"), cut).count() == 0


def test_many_events_of_one_batch_settle_by_rounds(spark, cut):
    n = 200_000
    keys = F.array(*(F.concat(F.lit(c), (F.xxhash64("id", F.lit(c)) % 150_000)) for c in "abc"))
    claimed = spark.range(n).select(F.lit(0).cast("long").alias("batch"), F.col("id").alias("position"), keys.alias("keys"))
    found = {r["position"] for r in ops.lost_claims(claimed, cut).collect()}
    assert found == ops.claims([(r["position"], r["keys"]) for r in claimed.collect()])


def test_ids_have_no_gaps_whatever_the_ranges(spark):
    places = random.Random(7).sample(range(10**6), 500)
    letters = spark.createDataFrame([(p,) for p in places], "position long").repartition(5)
    for breaks in ([], [0], [1000, 5000, 400_000, 999_999], sorted(places)[::50]):
        rows = inspection.numbered(letters, 11, breaks).collect()
        assert [r["id"] for r in sorted(rows, key=lambda r: r["position"])] == list(range(11, 511))


def test_letters_of_a_crowded_pass_are_numbered_in_ranges(spark, tmp_path, monkeypatch):
    from foldlog.streaming.runtime import Processor

    monkeypatch.setattr(inspection, "NUMBERED_TOGETHER", 7)
    target = EpochTarget(f"file://{tmp_path}/t", [model.Table("entries", "id string", ("id",))])
    rules = handlers.Rules().insert("add", "entries", {"id": F.col("id")}).error("bad", "no")
    p = config.declare(name="p", source=MemoryLog([]), target=target, handler=rules, parallelism=2, retry=False)
    items = [model.Event(f"e{k}", "s", "bad" if k % 2 else "add", {}, 10 * k) for k in range(1, 60)]
    Processor(spark, p)(MemoryLog._frame(spark, items), None)
    rows = target.table(spark, "dead_letters").orderBy("position").collect()
    assert [(r["id"], r["position"]) for r in rows] == [(k + 1, 10 * (2 * k + 1)) for k in range(30)]


def test_the_books_close_with_collisions(spark):
    rows = [("applied",), ("collision",), ("skipped",), ("deduped",), ("failed",), ("invalid",), ("collision",)]
    assert tuple(inspection.conservation(spark.createDataFrame(rows, "outcome string")).first()) == (7, 1, 4, 2, True)


def test_rules_can_be_tried_out(spark):
    rules = (
        handlers.Rules().insert("signup", "t", {"id": F.col("stream_id"), "n": F.lit(0)}).inc("buy", "t", {"id": F.col("stream_id")}, {"n": F.lit(3)}, name="more")
        .update("see", "t", {"id": F.lit("x")}, {"n": F.col("position")}).delete("leave", "t", {"id": F.col("stream_id")}).skip("look").error("bad", "no")
    )
    p = config.declare(name="p", source=MemoryLog([]), target=MemoryTarget(), handler=rules, parallelism=1)
    said = lambda kind: testing.handle(p, {}, type=kind, stream_id="s", position=7)
    assert said("signup") == model.Insert("t", {"id": "s", "n": "0"})
    assert said("buy") == model.Multi({"more": model.Upsert("t", {"id": "s"}, {}, {"n": 3})})
    assert said("see") == model.Update("t", {"id": "x"}, {"n": "7"}) and said("leave") == model.Delete("t", {"id": "s"})
    assert said("look") == model.Skip() and said("bad") == model.Error("no") and said("other") is None
