"""Two engines on one checkpoint: the second stands by, can be stopped, and takes over."""

import time

from foldlog.streaming.coordinator import INITIALIZING
from foldlog.streaming.runtime import Engine
from test_positions import declared, found, write


def waited(test, seconds=60):
    until = time.time() + seconds
    while not test() and time.time() < until:
        time.sleep(0.2)
    return test()


def test_the_second_engine_stands_by_and_takes_over(spark, tmp_path):
    write(spark, tmp_path / "log", range(1, 5))
    p = declared(tmp_path, 10)
    first, second, third = (Engine(spark, f"file://{tmp_path}/checkpoints") for _ in range(3))
    first.start(p)
    began = time.time()
    standing, other = second.start(p), third.start(p)
    assert time.time() - began < 5 and standing.query is None
    assert [e.list() for e in (second, third)] == [[{"name": "p", "version": 1, "state": INITIALIZING}]] * 2
    first.await_idle(p)
    third.stop(p)
    assert third.list()[0]["state"] == "stopped"
    assert found(spark, p) == [1, 2, 3, 4]
    write(spark, tmp_path / "log", range(5, 8))
    first.await_idle(p)
    first.stop(p)
    assert waited(lambda: second.list()[0]["state"] == "running")
    write(spark, tmp_path / "log", range(8, 12))
    second.await_idle(p)
    assert found(spark, p) == list(range(1, 12)) and other.query is None
    second.stop(p)
    assert standing.coordinator.state == "stopped" and third.list()[0]["state"] == "stopped"
