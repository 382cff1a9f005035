"""Composed steps against the step-by-step fold, for few and for many steps of a key."""

import random

import pytest
from pyspark.sql import functions as F

from foldlog import model
from foldlog.operators import folds, transformers

TABLE = model.Table("t", "a string, b int, n bigint, m bigint, s string", ("a", "b"), ("n",))
STEPS = "position bigint, stream_id string, k int, name string, action string, table string, key map<string,string>, set map<string,string>, inc map<string,bigint>"


def random_steps(rng, n, keys):
    out = []
    for position in range(1, n):
        for k in range(rng.choice([1, 1, 1, 2])):
            key = {"a": rng.choice(keys), "b": str(rng.randrange(2))}
            action = rng.choice(["insert", "update", "upsert", "delete", "update", "upsert"])
            some = {c: rng.choice([None, str(rng.randrange(100)), str(rng.randrange(100))]) for c in ("n", "m", "s") if rng.random() < 0.6}
            inc = {c: rng.randrange(-5, 9) for c in ("n", "m") if rng.random() < 0.3}
            if action == "insert":
                row = (position, "s", k, "event", action, "t", {}, key | some if rng.random() < 0.9 else some, {})
            elif action == "delete":
                row = (position, "s", k, "event", action, "t", key, {}, {})
            else:
                row = (position, "s", k, "event", action, "t", key, some, inc)
            out.append(row)
    out.append((n, "s", 0, "event", "insert", "other", {}, {"a": "x"}, {}))
    return out


def rows_of(rows, faults=None):
    values = folds.typed(rows, TABLE).where("not __deleted").drop("__deleted").collect()
    ids = {(tuple(r["id"]), r["there"]) for r in rows.select("id", "there").collect()}
    broken = [tuple(b) for r in rows.select("broken").collect() for b in r["broken"]]
    return sorted(map(repr, values)), ids, sorted(broken + [tuple(r) for r in (faults.collect() if faults is not None else [])])


@pytest.mark.parametrize(("seed", "hot_steps", "segment"), [(1, 10**6, 10), (2, 0, 7), (3, 30, 40), (4, 0, 1), (5, 60, 1000)])
def test_transformers_agree_with_the_fold(spark, seed, hot_steps, segment):
    rng = random.Random(seed)
    keys = ["hot"] * 6 + [f"k{i}" for i in range(12)]
    steps = spark.createDataFrame(random_steps(rng, 400, keys), STEPS).repartition(3)
    current = spark.createDataFrame([(k, b, rng.randrange(9), rng.choice([None, 4]), "old") for k in ("hot", "k1", "k3", "away") for b in (0, 1)], TABLE.ddl)
    wanted = rows_of(folds.fold(steps, current, TABLE))
    assert any(b[1] == "23505" for b in wanted[2]) and any(b[1] == "23502" for b in wanted[2])
    found = transformers.settle(steps, current, TABLE, hot_steps=hot_steps, segment=segment)
    assert (found.faults is not None) == (hot_steps < 100)
    assert rows_of(found.rows, found.faults) == wanted
    assert rows_of(transformers.settle(steps, current, TABLE, many=False).rows) == wanted


def test_no_steps_and_no_rows(spark):
    none = spark.createDataFrame([], STEPS)
    assert transformers.settle(none, spark.createDataFrame([], TABLE.ddl), TABLE).rows.count() == 0


def test_what_composes():
    assert transformers.composes(TABLE, [(("a", "b"), ("n",)), (("b", "a"), ())])
    assert not transformers.composes(TABLE, [(("a",), ("n",))])
    assert not transformers.composes(TABLE, [(("a", "b", "n"), ("n",))])
    assert not transformers.composes(TABLE, [(("a", "b"), ("a",))])


def test_a_key_of_a_million_steps_is_in_no_one_task(spark):
    n = 1_000_000
    texts, longs = "map<string,string>", "map<string,bigint>"
    steps = spark.range(1, n + 1, 1, 8).select(
        F.col("id").alias("position"), F.lit("s").alias("stream_id"), F.lit(0).alias("k"), F.lit("event").alias("name"),
        F.when(F.col("id") == 1, "insert").when(F.col("id") % 1000 == 0, "insert").otherwise("update").alias("action"), F.lit("t").alias("table"),
        F.when(F.col("id") % 1000 == 0, F.create_map().cast(texts)).when(F.col("id") == 1, F.create_map().cast(texts)).otherwise(F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.lit("0"))).alias("key"),
        F.when((F.col("id") == 1) | (F.col("id") % 1000 == 0), F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.lit("0"), F.lit("n"), F.lit("0"))).otherwise(F.create_map().cast(texts)).alias("set"),
        F.when((F.col("id") == 1) | (F.col("id") % 1000 == 0), F.create_map().cast(longs)).otherwise(F.create_map(F.lit("n"), F.lit(1).cast("bigint"))).alias("inc"),
    )
    found = transformers.settle(steps, spark.createDataFrame([], TABLE.ddl), TABLE, segment=5_000)
    row = folds.typed(found.rows, TABLE).collect()
    assert [(r["a"], r["b"], r["n"]) for r in row] == [("x", 0, n - 1 - n // 1000)]
    assert found.faults.count() == n // 1000 and {r["state"] for r in found.faults.select("state").distinct().collect()} == {"23505"}
    # rows that tasks of the segments have: 200 segments over the partitions
    cut = steps.select(F.array(F.lit("x")).alias("id"), F.floor(F.col("position") / 5_000).alias("segment")).repartition(8, "id", "segment")
    sizes = sorted(r["count"] for r in cut.groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
