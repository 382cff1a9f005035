"""Steps as transformers of one row: they compose, so a key's history needs no one place.

A step on a row with the step's key does one of few things, whatever else the row holds: it makes the row (an insert or an upsert
that names all required columns), removes it, or sets and adds to columns of a row that is there. So
- whether a row is there before a step is what the last making or removing step before it says, else what the table says;
- a column's value is what the last step set that took effect, with what later steps added; making a row sets all its columns.
Both are maximums over places, which merge in any grouping. A key with more than HOT_STEPS steps is cut into segments of
positions; a segment tells in one row what it does, the next segments go on from there, and no task has more of a key than a segment.

Steps that ask for more than a key (see folds.fold) don't compose; they go through folds.fold.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldlog import model

#: Steps of a key that one task may have.
HOT_STEPS = 100_000
#: Shares of the keys whose steps are counted first; keys are counted one by one only in those with more than HOT_STEPS.
SHARES = 4096
#: Positions of a segment of a key that has more.
SEGMENT = 20_000


@dataclass(frozen=True)
class Settled:
    """rows: id, there, row (column texts), broken (position, state) as folds.fold returns them; faults: those of keys in segments, else None."""

    rows: DataFrame
    faults: DataFrame | None = None

    def broken(self) -> DataFrame:
        """position and state of every step that a constraint refused."""
        own = self.rows.select(F.explode("broken").alias("b")).select("b.position", "b.state")
        return own if self.faults is None else own.unionByName(self.faults)


def composes(table: model.Table, filters) -> bool:
    """Whether all updates and deletes name just the key, and no update writes it. filters: (columns asked for, columns written)."""
    return all(set(asked) == set(table.key) and not set(table.key) & set(written) for asked, written in filters)


def keys(steps: DataFrame, table: model.Table) -> DataFrame:
    """The keys of the steps' rows, a column of texts each."""
    of = lambda c: F.when(F.col("action") == "insert", F.try_element_at("set", F.lit(c))).otherwise(F.try_element_at("key", F.lit(c)))
    return steps.where(F.col("table") == table.name).select(*(plain(of(f.name), f).alias(f.name) for f in table.schema if f.name in table.key))


def plain(text: Column, f: T.StructField) -> Column:
    """A text as its column's type would write it."""
    return text if isinstance(f.dataType, T.StringType) else text.try_cast(f.dataType).cast("string")


def _given(c: str) -> tuple[Column, Column, Column]:
    """For a column: whether a step sets it, to what, and what it adds."""
    name = F.lit(c)
    return F.map_contains_key("set", name), F.try_element_at("set", name), F.try_element_at("inc", name)


def _marked(steps: DataFrame, table: model.Table) -> DataFrame:
    """id, position, k, action, and what a step does: ``effect`` (makes, removes, or null), lacks (a required column set to null), and the columns' values."""
    ident = lambda m: F.array(*(F.try_element_at(m, F.lit(c)) for c in table.key))
    insert, upsert = F.col("action") == "insert", F.col("action") == "upsert"
    required = tuple(dict.fromkeys((*table.key, *table.required)))
    fresh, nulls = [], []
    for c in required:
        sets, value, inc = _given(c)
        fresh.append(F.when(insert, value.isNotNull()).otherwise(inc.isNotNull() | F.when(sets, value).otherwise(F.try_element_at("key", F.lit(c))).isNotNull()))
        nulls.append(sets & value.isNull() & inc.isNull())
    makes = (insert | upsert) & reduce(and_, fresh)
    effect = F.when(makes, True).when(F.col("action") == "delete", False)
    columns = [
        x for i, f in enumerate(table.schema) for sets, value, inc in [_given(f.name)]
        for x in (sets.alias(f"sets_{i}"), F.coalesce(F.when(sets, value), F.when(upsert, F.try_element_at("key", F.lit(f.name)))).alias(f"given_{i}"), F.when(~insert, inc).alias(f"inc_{i}"))
    ]
    of = F.when(insert, ident(F.col("set"))).otherwise(ident(F.col("key")))
    return steps.where(F.col("table") == table.name).select(of.alias("id"), "position", "k", "action", effect.alias("effect"), reduce(or_, nulls).alias("lacks"), *columns)


def _judged(rows: DataFrame, by: tuple[str, ...], there: Column) -> DataFrame:
    """rows (id, n, effect, before ...) with ``state``, the fault of a step, and ``makes`` and ``changes``, what it does. there: what holds before all of a group."""
    before = F.coalesce("before", there)
    insert, changing = F.col("action") == "insert", F.col("action").isin("update", "upsert")
    makes = ~before & F.coalesce(F.col("effect"), F.lit(False))
    state = F.when(insert & before, "23505").when((insert | (F.col("action") == "upsert")) & ~before & ~makes, "23502").when(changing & before & F.col("lacks"), "23502")
    return rows.select("*", state.alias("state"), makes.alias("makes"), (changing & before & ~F.col("lacks")).alias("changes"))


def _columns(judged: DataFrame, by: tuple[str, ...], table: model.Table) -> DataFrame:
    """For each group: the last effect, faults, and each column's last setting (whether, to what) and what was added after it."""
    whole = Window.partitionBy(*by)
    last, settings = [], []
    for i, f in enumerate(table.schema):
        value, inc = F.col(f"given_{i}"), F.col(f"inc_{i}")
        sets = F.col("makes") | (F.col("changes") & F.col(f"sets_{i}"))
        base = F.when(inc.isNotNull(), (F.coalesce(value.try_cast("bigint"), F.lit(0)) + inc).cast("string")).otherwise(value)
        last.append(F.max(F.when(sets, F.col("n"))).over(whole).alias(f"at_{i}"))
        settings += [
            F.max(f"at_{i}").alias(f"at_{i}"), F.max(F.when(sets & (F.col("n") == F.col(f"at_{i}")), base)).alias(f"value_{i}"),
            F.sum(F.when(F.col("changes") & (F.col("n") > F.coalesce(f"at_{i}", F.lit(0))), inc)).alias(f"added_{i}"),
        ]
    fault = F.when(F.col("state").isNotNull(), F.struct("position", "state"))
    return judged.select("*", *last).groupBy(*by).agg(F.max_by("effect", F.when(F.col("effect").isNotNull(), F.col("n"))).alias("effect"), F.collect_list(fault).alias("broken"), *settings)


def _rows(done: DataFrame, table: model.Table) -> DataFrame:
    """Groups with ``old`` to rows as folds.fold returns them."""
    none = F.expr("cast(map() as map<string,string>)")
    values = []
    for i, f in enumerate(table.schema):
        base = F.when(F.col(f"at_{i}").isNotNull(), F.col(f"value_{i}")).otherwise(F.try_element_at("old", F.lit(f.name)))
        sum_ = (F.coalesce(base.try_cast("bigint"), F.lit(0)) + F.col(f"added_{i}")).cast("string")
        values += [F.lit(f.name), F.when(F.col(f"added_{i}").isNotNull(), sum_).otherwise(base)]
    there = F.coalesce("effect", F.col("old").isNotNull())
    return done.select("id", there.alias("there"), F.when(there, F.create_map(*values)).otherwise(none).alias("row"), F.array_sort("broken").alias("broken"))


def _old(current: DataFrame, table: model.Table) -> DataFrame:
    return current.select(F.array(*(F.col(k).cast("string") for k in table.key)).alias("id"), F.create_map(*(x for f in table.schema for x in (F.lit(f.name), F.col(f.name).cast("string")))).alias("old"))


def _numbered(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """rows with their number in the group and what the last effect before them was."""
    order = Window.partitionBy(*by).orderBy("position", "k")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("n", F.row_number().over(order)).withColumn("before", F.last("effect", ignorenulls=True).over(earlier))


def _together(rows: DataFrame, have: DataFrame, table: model.Table) -> DataFrame:
    """Keys of few steps: one exchange by key serves the order, the table's row and the columns."""
    met = _numbered(rows, ("id",)).join(have, "id", "left")
    judged = _judged(met, ("id",), F.col("old").isNotNull())
    found = _columns(judged, ("id",), table)
    return _rows(found.join(have, "id", "left"), table)


def _segmented(rows: DataFrame, have: DataFrame, table: model.Table, segment: int) -> Settled:
    """Keys of many steps: segments tell their effect, go on from that of the earlier ones, and tell their columns."""
    by = ("id", "segment")
    cut = _numbered(rows.withColumn("segment", F.floor(F.col("position") / segment)), by)
    effects = cut.groupBy(*by).agg(F.max_by("effect", F.when(F.col("effect").isNotNull(), F.col("n"))).alias("effect"))
    earlier = Window.partitionBy("id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    told = effects.withColumn("reached", F.last("effect", ignorenulls=True).over(earlier)).join(have, "id", "left")
    told = told.select(*by, F.coalesce("reached", F.col("old").isNotNull()).alias("there"))
    judged = _judged(cut.join(told, list(by)), by, F.col("there"))
    found = _columns(judged, by, table)
    merged = [F.max_by("effect", F.when(F.col("effect").isNotNull(), F.col("segment"))).alias("effect")]
    whole = Window.partitionBy("id")
    last = found.drop("broken")
    for i, _ in enumerate(table.schema):
        last = last.withColumn(f"last_{i}", F.max(F.when(F.col(f"at_{i}").isNotNull(), F.col("segment"))).over(whole))
        merged += [
            F.max(f"last_{i}").alias(f"at_{i}"), F.max(F.when(F.col("segment") == F.col(f"last_{i}"), F.col(f"value_{i}"))).alias(f"value_{i}"),
            F.sum(F.when(F.col(f"last_{i}").isNull() | (F.col("segment") >= F.col(f"last_{i}")), F.col(f"added_{i}"))).alias(f"added_{i}"),
        ]
    done = last.groupBy("id").agg(*merged).withColumn("broken", F.array().cast("array<struct<position:bigint,state:string>>"))
    faults = judged.where("state is not null").select("position", "state")
    return Settled(_rows(done.join(have, "id", "left"), table), faults)


def settle(steps: DataFrame, current: DataFrame, table: model.Table, *, many: bool = True, hot_steps: int = HOT_STEPS, segment: int = SEGMENT) -> Settled:
    """What ``folds.fold`` returns, for steps that compose. many: whether there may be keys of more than hot_steps steps; these are counted first.

    Rows of the table have their required values. What is broken of a key in segments comes as ``faults``, not in its row.
    """
    rows, have = _marked(steps, table), _old(current, table)
    if not many:
        return Settled(_together(rows, have, table))
    share = F.pmod(F.xxhash64("id"), F.lit(SHARES))
    crowded = [r[0] for r in rows.groupBy(share.alias("share")).count().where(F.col("count") > hot_steps).select("share").collect()]  # a key of many steps stands in one
    if not crowded:
        return Settled(_together(rows, have, table))
    hot = rows.where(share.isin(*crowded)).groupBy("id").count().where(F.col("count") > hot_steps).select("id")
    ids = hot.collect()  # one for each hot_steps steps at most
    if not ids:
        return Settled(_together(rows, have, table))
    hot = F.broadcast(steps.sparkSession.createDataFrame(ids, "id array<string>"))
    parted = _segmented(rows.join(hot, "id", "left_semi"), have.join(hot, "id", "left_semi"), table, segment)
    rest = _together(rows.join(hot, "id", "left_anti"), have, table)
    return Settled(rest.unionByName(parted.rows), parted.faults)
