"""What operators ask: dead letters, cursors, progress, lag, conservation, resets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: More streams than this are not listed one by one.
STREAMS_SHOWN = 1000
PRELOAD = 10_000
#: A page has the columns of a dead letter but its stack trace.
PAGE = ("id", "position", "stream_id", "event_type", "event_data", "error_kind", "error_message", "occurred_at")


def of(table: DataFrame, name: str, version: int) -> DataFrame:
    return table.where((F.col("projection_name") == name) & (F.col("projection_version") == version))


def dead_letters(table: DataFrame, name: str, version: int = 1, *, stream_id: str | None = None, error_kind: str | None = None, since: Column | None = None) -> DataFrame:
    found = of(table, name, version)
    for test in (stream_id and F.col("stream_id") == stream_id, error_kind and F.col("error_kind") == error_kind):
        if test is not None:
            found = found.where(test)
    return found if since is None else found.where(F.col("occurred_at") >= since)


def dead_letter_page(table: DataFrame, name: str, version: int = 1, *, order: str = "desc", limit: int = 50, offset: int = 0, **filters) -> DataFrame:
    """One page by time of recording, then id; any order but ``asc`` is descending."""
    way = F.asc if order == "asc" else F.desc
    found = dead_letters(table, name, version, **filters).orderBy(way("occurred_at"), way("id"))
    return (found.offset(offset) if offset else found).limit(limit).select(*PAGE)


def dead_letter_count(table: DataFrame, name: str, version: int = 1, **filters) -> DataFrame:
    return dead_letters(table, name, version, **filters).agg(F.count("id").alias("n"))


def dead_letter_stats(table: DataFrame, name: str, version: int = 1) -> DataFrame:
    """A row per error kind, and one of kind null for the total with the first and last time."""
    own = of(table, name, version)
    by = own.groupBy("error_kind").agg(F.count("*").alias("n"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"))
    return by.unionByName(own.agg(F.lit(None).cast("string").alias("error_kind"), F.count("*").alias("n"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at")))


def stream_positions(cursors: DataFrame, shown: int = STREAMS_SHOWN) -> DataFrame:
    """All cursors, or one row that says truncated if there are more than ``shown``."""
    n = cursors.agg(F.count("*").alias("n"))
    few = cursors.select("stream_id", "position").join(n.where(F.col("n") <= shown), how="cross").select("stream_id", "position", F.lit(False).alias("truncated"))
    return few.unionByName(n.where(F.col("n") > shown).select(F.lit(None).cast("string").alias("stream_id"), F.lit(None).cast("bigint").alias("position"), F.lit(True).alias("truncated")))


def safe_position(cursors: DataFrame) -> DataFrame:
    """The least cursor, 0 without any. For display: not a place to replay from."""
    return cursors.agg(F.coalesce(F.min("position"), F.lit(0)).cast("bigint").alias("safe_position"))


def preload(cursors: DataFrame, limit: int = PRELOAD) -> DataFrame:
    return cursors.orderBy("stream_id").limit(limit).select("stream_id", "position")


def conservation(outcomes: DataFrame) -> DataFrame:
    """delivered, applied, dead and skipped events, and whether the last three add up to the first."""
    count = lambda *names: F.count(F.when(F.col("outcome").isin(*names), 1))
    found = outcomes.agg(F.count("*").alias("delivered"), count("applied").alias("applied"), count("failed", "invalid", "collision").alias("dead"), count("skipped", "deduped").alias("skipped"))
    return found.withColumn("closed", F.col("delivered") == F.col("applied") + F.col("dead") + F.col("skipped"))


def reset_counts(positions: DataFrame, progress: DataFrame, letters: DataFrame, name: str, version: int, *, dead_letters_too: bool = False) -> DataFrame:
    """How many rows a reset of one version deletes from each table."""
    counts = [of(t, name, version).agg(F.count("*").alias(n)) for n, t in (("cursors", positions), ("progress", progress), ("dead_letters", letters if dead_letters_too else letters.limit(0)))]
    return counts[0].join(counts[1], how="cross").join(counts[2], how="cross")


#: Dead letters that one task may number.
NUMBERED_TOGETHER = 100_000


def numbered(letters: DataFrame, first: int = 1, breaks: Sequence[int] = (), held: Sequence[int] | None = None) -> DataFrame:
    """Dead letters with ids from ``first``, without gaps, in order of position.

    breaks: positions, in order, at which ranges begin; each range is numbered in a task of its own, from the number of letters in earlier ones.
    held: how many letters each range has, for callers that know; else they are counted.
    """
    if not breaks:
        return letters.withColumn("id", (F.row_number().over(Window.orderBy("position")) + (first - 1)).cast("bigint"))
    starts = F.array(*(F.lit(b).cast("bigint") for b in breaks))
    parted = letters.withColumn("__range", F.size(F.filter(starts, lambda b: b <= F.col("position"))))
    place = F.row_number().over(Window.partitionBy("__range").orderBy("position"))
    if held is not None:
        firsts = F.array(*(F.lit(first - 1 + sum(held[:i])).cast("bigint") for i in range(len(breaks))))
        return parted.withColumn("id", F.get(firsts, F.col("__range") - 1) + place).drop("__range")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # over as many rows as there are ranges
    counts = parted.groupBy("__range").agg(F.count("*").alias("__n"))
    counts = counts.select("__range", (F.coalesce(F.sum("__n").over(before), F.lit(0)) + (first - 1)).alias("__first"))
    return parted.withColumn("__place", place).join(F.broadcast(counts), "__range").withColumn("id", (F.col("__first") + F.col("__place")).cast("bigint")).drop("__range", "__place", "__first")
