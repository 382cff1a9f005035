"""Folding results into read-model rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldlog import model


def steps_of(results: DataFrame) -> DataFrame:
    """A row for each step: position, k (its place in its event), stream_id and the step's fields."""
    return results.select("position", "stream_id", F.posexplode("result.steps").alias("k", "step")).select("position", "stream_id", "k", "step.*")


def sums(events: DataFrame, key: str, amount: Column, *extra: Column) -> DataFrame:
    """The fast path of adding folds: associative, so map-side sums absorb hot keys before the shuffle."""
    return events.groupBy(key).agg(F.sum(amount).cast("bigint").alias("total"), F.max("position").alias("last_position"), *extra)


_STATE = "struct<there:boolean,row:map<string,string>,broken:array<struct<position:bigint,state:string>>>"


def _over(old: Column, new: Column) -> Column:
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def _added(row: Column, inc: Column) -> Column:
    return _over(row, F.transform_values(inc, lambda k, v: (F.coalesce(F.try_element_at(row, k).try_cast("bigint"), F.lit(0)) + v).cast("string")))


def _matches(row: Column, where: Column, table: model.Table) -> Column:
    """Whether a row has the values of a filter, compared as the columns' types compare."""
    typed = lambda text, f: text if isinstance(f.dataType, T.StringType) else text.try_cast(f.dataType)
    tests = [~F.map_contains_key(where, F.lit(f.name)) | typed(F.try_element_at(row, F.lit(f.name)), f).eqNullSafe(typed(F.try_element_at(where, F.lit(f.name)), f)) for f in table.schema]
    return reduce(and_, tests)


def _reached(wide: DataFrame, own: DataFrame, have: DataFrame, table: model.Table, loose: Sequence[tuple[tuple[str, ...], tuple[str, ...]]]) -> DataFrame:
    """(id, step) of the loose steps for every row that each may reach."""
    step = F.struct("position", "k", "action", "key", "set", "inc").alias("step")
    written = {c for _, ws in loose for c in ws}
    kind = {f.name: f.dataType for f in table.schema}
    plain = lambda text, c: text if isinstance(kind[c], T.StringType) else text.try_cast(kind[c]).cast("string")
    out = []
    for names in sorted({cs for cs, _ in loose}):
        asking = wide.where(F.array_sort(F.map_keys("key")) == F.array(*map(F.lit, names)).cast("array<string>")).select("position", "k", "key", step)
        by = next((c for c in names if c not in written), None)
        if by is None:  # to all rows: one list, joined by a constant
            ids = have.select("id").union(own.select("id")).distinct().withColumn("one", F.lit(1))
            out.append(ids.join(asking.select(F.lit(1).alias("one"), "position", "k", "step"), "one").select("id", "position", "k", "step"))
            continue
        given = F.coalesce(F.try_element_at("step.set", F.lit(by)), F.try_element_at("step.key", F.lit(by)))
        # a value that only a row's own step gives holds from that step on: earlier ones that ask for it do not meet the row
        values = have.select("id", plain(F.try_element_at("old", F.lit(by)), by).alias("v"), F.lit(None).cast("bigint").alias("since"), F.lit(True).alias("old"))
        values = values.union(own.select("id", plain(given, by).alias("v"), "step.position", F.lit(False)))
        values = values.groupBy("id", "v").agg(F.when(~F.max("old"), F.min("since")).alias("since"))
        asked = asking.select(plain(F.try_element_at("key", F.lit(by)), by).alias("w"), "position", "k", "step")
        out.append(values.join(asked, F.col("v").eqNullSafe(F.col("w")) & (F.col("since").isNull() | (F.col("position") >= F.col("since")))).select("id", "position", "k", "step"))
    # a step asks by one set of columns and for one value, and a row has that value once: no pair comes twice
    return reduce(DataFrame.union, out).select("id", "step")


def fold(steps: DataFrame, current: DataFrame, table: model.Table, loose: Sequence[tuple[tuple[str, ...], tuple[str, ...]]] = ()) -> DataFrame:
    """Apply steps in order of position to rows of one table.

    Inserts, upserts, and updates and deletes whose filter names the whole primary key find their row by it. ``loose``
    lists the others: by which columns they filter and which they write. Such a step goes, at its turn, to every row
    that may have the value it asks for: in the table, or by a step of the row's own; whether it matches is decided on
    the row as it stands then. If loose steps write the very columns that they filter by, they go to all rows.

    Returns id (the key's values as an array), there, row (column texts) and broken: the positions whose insert met a
    row with its key (23505) or whose row lacks a required value (23502). An update or delete that meets no row is no
    failure. Sequential meaning needs a key's steps together; a batch bounds their number, as batches are bounded.
    """
    ident = lambda m: F.array(*(F.try_element_at(m, F.lit(k)) for k in table.key))
    of = F.when(F.col("action") == "insert", ident(F.col("set"))).otherwise(ident(F.col("key")))
    partial = F.col("action").isin("update", "delete") & ~reduce(and_, [F.map_contains_key("key", F.lit(k)) for k in table.key])
    mine = steps.where(F.col("table") == table.name)
    step = F.struct("position", "k", "action", "key", "set", "inc").alias("step")
    rows = (mine.where(~partial) if loose else mine).select(of.alias("id"), step)
    place = lambda s: F.struct(s["position"], s["k"])  # noqa: E731  maps have no order, so the comparison is spelt out
    in_order = lambda found: F.array_sort(found, lambda a, b: F.when(place(a) < place(b), -1).when(place(a) > place(b), 1).otherwise(0))
    columns = [f.name for f in table.schema]
    have = current.select(F.array(*(F.col(k).cast("string") for k in table.key)).alias("id"), F.create_map(*(x for c in columns for x in (F.lit(c), F.col(c).cast("string")))).alias("old"))
    if loose:
        rows = rows.unionByName(_reached(mine.where(partial), rows, have, table, loose))
    grouped = rows.groupBy("id").agg(F.collect_list("step").alias("steps"))
    joined = grouped.join(have, "id", "left")
    none = F.expr("cast(map() as map<string,string>)")
    start = F.struct(F.col("old").isNotNull().alias("there"), F.coalesce("old", none).alias("row"), F.array().cast("array<struct<position:bigint,state:string>>").alias("broken")).cast(_STATE)
    required = tuple(dict.fromkeys((*table.key, *table.required)))

    def lacks(row: Column) -> Column:
        return reduce(lambda a, b: a | b, [F.try_element_at(row, F.lit(c)).isNull() for c in required])

    def apply(state: Column, s: Column) -> Column:
        fresh = _over(s["key"], s["set"])
        hit = state["there"] & _matches(state["row"], s["key"], table)
        changed = F.when(s["action"] == "insert", s["set"]).when(s["action"] == "upsert", F.when(state["there"], _added(_over(state["row"], s["set"]), s["inc"])).otherwise(_added(fresh, s["inc"]))).otherwise(_added(_over(state["row"], s["set"]), s["inc"]))
        writes = (s["action"].isin("insert", "upsert")) | ((s["action"] == "update") & hit)
        goes = (s["action"] == "delete") & hit
        fault = F.when((s["action"] == "insert") & state["there"], "23505").when(writes & lacks(changed), "23502")
        kept = F.struct(state["there"].alias("there"), state["row"].alias("row"), F.concat(state["broken"], F.array(F.struct(s["position"].alias("position"), fault.alias("state")))).alias("broken")).cast(_STATE)
        done = F.struct(F.when(goes, False).otherwise(state["there"] | writes).alias("there"), F.when(goes, none).when(writes, changed).otherwise(state["row"]).alias("row"), state["broken"].alias("broken")).cast(_STATE)
        return F.when(fault.isNotNull(), kept).otherwise(done)

    return joined.select("id", F.aggregate(in_order(F.col("steps")), start, apply).alias("state")).select("id", "state.*")


def inserts(steps: DataFrame, current: DataFrame, table: model.Table) -> DataFrame:
    """What ``fold`` returns, for a table that the steps only insert into.

    The first step of a key that has all required values makes the row, unless the table has one. So rows meet in a
    minimum that map sides take part in; what a key gathers are places, not rows.
    """
    required = tuple(dict.fromkeys((*table.key, *table.required)))
    lacks = reduce(lambda a, b: a | b, [F.try_element_at("set", F.lit(c)).isNull() for c in required])
    ident = F.array(*(F.try_element_at("set", F.lit(k)) for k in table.key))
    rows = steps.where(F.col("table") == table.name).select(ident.alias("id"), F.struct("position", "k").alias("place"), "set", lacks.alias("lacks"))
    first = F.when(~F.col("lacks"), F.col("place"))
    grouped = rows.groupBy("id").agg(F.min(first).alias("first"), F.min_by("set", first).alias("new"), F.collect_list(F.struct("place", "lacks")).alias("steps"))
    have = current.select(F.array(*(F.col(k).cast("string") for k in table.key)).alias("id"), F.create_map(*(x for f in table.schema for x in (F.lit(f.name), F.col(f.name).cast("string")))).alias("old"))
    fault = lambda s: F.when(F.col("old").isNotNull() | (s["place"] > F.col("first")), "23505").when(s["lacks"], "23502")
    faults = F.filter(F.transform(F.array_sort("steps"), lambda s: F.struct(s["place"]["position"].alias("position"), fault(s).alias("state"))), lambda b: b["state"].isNotNull())
    none = F.expr("cast(map() as map<string,string>)")
    return grouped.join(have, "id", "left").select("id", (F.col("old").isNotNull() | F.col("first").isNotNull()).alias("there"), F.coalesce("old", "new", none).alias("row"), faults.alias("broken"))


def typed(folded: DataFrame, table: model.Table, *extra: str) -> DataFrame:
    """Rows of the table, with ``__deleted`` for those that are gone, and what else is asked for."""
    key_at = {k: i for i, k in enumerate(table.key)}
    columns = []
    for f in table.schema:
        text = F.coalesce(F.try_element_at("row", F.lit(f.name)), F.get("id", F.lit(key_at[f.name]))) if f.name in key_at else F.try_element_at("row", F.lit(f.name))
        columns.append((text if isinstance(f.dataType, T.StringType) else text.cast(f.dataType)).alias(f.name))
    return folded.select(*columns, (~F.col("there")).alias("__deleted"), *extra)
