"""A log followed by position: rows admitted, gaps, restarts, and a pause that lets work in flight commit."""

import datetime
import random
import sys
import threading
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldlog import config, model
from foldlog.operators import events as ops
from foldlog.operators import handlers
from foldlog.sources import positions
from foldlog.sources.logs import MemoryLog, ParquetLog
from foldlog.streaming.runtime import Engine, Processor, run_bounded
from foldlog.targets.epoch import EpochTarget

cloudpickle.register_pickle_by_value(sys.modules[__name__])
ROWS = model.Table("entries", "event_id string, position bigint", ("event_id",))


def rules():
    return handlers.Rules().otherwise(handlers.result("insert", handlers.step("insert", "entries", set={"event_id": F.col("id"), "position": F.col("position")})))


def write(spark, path, places, name=None):
    rows = [model.Event(f"e{p}", f"s{p % 3}", "add", {"n": p}, p, datetime.datetime(2026, 1, 1)) for p in places]
    MemoryLog._frame(spark, rows).coalesce(1).write.mode("append").parquet(f"file://{path}")


def declared(tmp_path, buffer_size, **more):
    source = ParquetLog(f"file://{tmp_path}/log", spark_schema(), buffer_size=buffer_size, **more)
    return config.declare(name="p", source=source, target=EpochTarget(f"file://{tmp_path}/model", [ROWS]), handler=rules(), parallelism=2, retry=False, batch_timeout_ms=100, lag_interval_ms=0)


def spark_schema():
    return model.ENVELOPE


def found(spark, p):
    return sorted(r["position"] for r in p.target.table(spark, "entries").collect())


def sizes(monkeypatch):
    """How many rows each pass was given."""
    seen, whole = [], Processor.__call__

    def counted(self, events, batch_id):
        seen.append(events.count())
        return whole(self, events, batch_id)

    monkeypatch.setattr(Processor, "__call__", counted)
    return seen


def test_what_comes_next_is_found_in_footers_and_positions(tmp_path):
    rng = random.Random(4)
    places = rng.sample(range(10_000), 700)
    for k in range(7):
        own = places[100 * k : 100 * k + 100]
        pq.write_table(pa.table({"at": pa.array(own, type=pa.int64()), "x": own}), tmp_path / f"{k}.parquet", row_group_size=30, write_statistics=k % 2 == 0)
    log = positions.Log(f"file://{tmp_path}", "at")
    every = sorted(places)
    for after in (-1, 0, 17, every[300], every[-2], every[-1]):
        for rows in (1, 5, 64, 700, 9_999):
            left = [p for p in every if p > after]
            assert log.ahead(after, rows) == (left[min(rows, len(left)) - 1] if left else after)
    for start in range(0, 700, 50):
        reader = positions.Reader({"path": f"file://{tmp_path}", "order": "at", "after": "-1", "buffer": "50"}, T.StructType([T.StructField("at", T.LongType()), T.StructField("x", T.LongType())]))
        after = every[start - 1] if start else -1
        pieces = reader.partitions({"after": after}, {"after": every[start + 49]})
        rows = [r for p in pieces for b in reader.read(p) for r in b.to_pylist()]
        assert sorted(r["at"] for r in rows) == every[start : start + 50] and all(r["at"] == r["x"] for r in rows) and len(pieces) <= 8


def test_gaps_cost_no_passes(spark, tmp_path, monkeypatch):
    seen = sizes(monkeypatch)
    places = [1 + k * 10**9 for k in range(6)]
    write(spark, tmp_path / "log", places)
    p = declared(tmp_path, 6)
    engine = Engine(spark, f"file://{tmp_path}/checkpoints", {"availableNow": True})
    engine.start(p).query.awaitTermination(60)
    engine.stop(p)
    assert found(spark, p) == places and seen == [6]
    other = declared(tmp_path / "bounded", 6)
    run_bounded(spark, other, p.source.batch(spark), in_flight=6)
    assert found(spark, other) == places and seen[1:] == [6]


def test_a_stream_takes_so_many_rows_at_a_time_and_goes_on_after_a_restart(spark, tmp_path, monkeypatch):
    seen = sizes(monkeypatch)
    write(spark, tmp_path / "log", range(1, 8))
    write(spark, tmp_path / "log", range(8, 12))
    p = declared(tmp_path, 3)
    engine = Engine(spark, f"file://{tmp_path}/checkpoints", {"availableNow": True})
    engine.start(p).query.awaitTermination(90)
    engine.stop(p)
    assert found(spark, p) == list(range(1, 12)) and [n for n in seen if n] == [3, 3, 3, 2]
    write(spark, tmp_path / "log", range(12, 17))
    engine = Engine(spark, f"file://{tmp_path}/checkpoints", {"availableNow": True})  # as after a restart
    engine.start(p).query.awaitTermination(90)
    engine.stop(p)
    assert found(spark, p) == list(range(1, 17)) and [n for n in seen if n] == [3, 3, 3, 2, 3, 2]


def test_a_pause_inside_a_batch_lets_it_commit_and_nothing_after(spark, tmp_path, monkeypatch):
    write(spark, tmp_path / "log", range(1, 10))
    p = declared(tmp_path, 3)
    inside, go = threading.Event(), threading.Event()
    whole = p.target.commit

    def commit(spark, batch, guard):
        inside.set()
        assert go.wait(60)
        return whole(spark, batch, guard)

    monkeypatch.setattr(p.target, "commit", commit)
    engine = Engine(spark, f"file://{tmp_path}/checkpoints")
    own = engine.start(p)
    assert inside.wait(60)
    engine.pause(p)
    go.set()
    until = time.time() + 60
    while not found(spark, p) and time.time() < until:
        time.sleep(0.2)
    time.sleep(3)
    first = found(spark, p)
    # the offset of the next batch may have been planned before the pause; nothing is planned after it
    assert own.query.isActive and first in ([1, 2, 3], [1, 2, 3, 4, 5, 6])
    time.sleep(3)
    assert found(spark, p) == first and engine.list()[0]["state"] == "paused"
    engine.resume(p)
    engine.await_idle(p)
    assert found(spark, p) == list(range(1, 10))
    engine.stop(p)


def test_a_pause_without_row_admission_waits_for_the_batch(spark, tmp_path, monkeypatch):
    write(spark, tmp_path / "log", range(1, 4))
    p = declared(tmp_path, None)
    inside = threading.Event()
    whole = p.target.commit

    def commit(spark, batch, guard):
        inside.set()
        time.sleep(1)
        return whole(spark, batch, guard)

    monkeypatch.setattr(p.target, "commit", commit)
    engine = Engine(spark, f"file://{tmp_path}/checkpoints")
    engine.start(p)
    assert inside.wait(60)
    engine.pause(p)
    assert found(spark, p) == [1, 2, 3]
    write(spark, tmp_path / "log", range(4, 6))
    time.sleep(1)
    assert found(spark, p) == [1, 2, 3]
    engine.resume(p)
    engine.await_idle(p)
    assert found(spark, p) == [1, 2, 3, 4, 5]
    engine.stop(p)


def test_a_log_of_other_columns_needs_its_order(spark, tmp_path):
    with pytest.raises(ValueError):
        ParquetLog("x", buffer_size=5, id=F.col("a"))
    spark.range(40).select(F.col("id").alias("n"), F.lit("u").alias("who")).coalesce(1).write.parquet(f"file://{tmp_path}/log")
    source = ParquetLog(f"file://{tmp_path}/log", buffer_size=7, order="n", shift=1, id=F.col("n"), stream_id=F.col("who"), type=F.lit("add"), position=F.col("n") + 1, occurred_at=F.lit(None), data=F.lit("{}"), start_from=20)
    p = config.declare(name="p", source=source, target=EpochTarget(f"file://{tmp_path}/model", [ROWS]), handler=rules(), parallelism=2)
    engine = Engine(spark, f"file://{tmp_path}/checkpoints", {"availableNow": True})
    engine.start(p).query.awaitTermination(120)
    engine.stop(p)
    assert found(spark, p) == list(range(21, 41))


@pytest.mark.parametrize("size", [1, 7, 100])
def test_ranges_hold_all_rows_and_few_each(spark, monkeypatch, size):
    monkeypatch.setattr(ops, "BLOCKS", 5)
    rng = random.Random(size)
    places = sorted(set(rng.sample(range(1, 400), 90) + [10**9, 10**9 + 1, 10**12] + list(range(5_000, 5_060))))
    parts = list(ops.ranges(spark.createDataFrame([(x,) for x in places], "position bigint"), 1, places[-1], size))
    assert all(b < c for (_, b), (c, _) in zip(parts, parts[1:]))
    held = [[x for x in places if a <= x <= b] for a, b in parts]
    assert [x for h in held for x in h] == places and all(0 < len(h) <= size for h in held)
