"""Operators over envelopes: from log rows to what a batch has to process."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def envelope(rows: DataFrame, *, id: Column, stream_id: Column, type: Column, position: Column, occurred_at: Column, data: Column, metadata: Column | None = None) -> DataFrame:
    """Map log rows to envelopes. Missing metadata becomes an empty map, a time without zone counts as UTC."""
    none = F.create_map().cast("map<string,string>")
    return rows.select(
        id.cast("string").alias("id"), stream_id.cast("string").alias("stream_id"), type.cast("string").alias("type"), data.alias("data"),
        (none if metadata is None else F.coalesce(metadata, none)).alias("metadata"), position.cast("bigint").alias("position"), occurred_at.cast("timestamp").alias("occurred_at"),
    )


def start_from(events: DataFrame, after: int | str = "origin") -> DataFrame:
    """Events beyond a position; ``origin`` is all of them, ``current`` what comes after those that are there now."""
    if after == "origin":
        return events
    if after == "current":
        after = events.agg(F.max("position")).first()[0] or 0
    return events.where(F.col("position") > F.lit(int(after)))


def batches(events: DataFrame, size: int) -> DataFrame:
    """Number batches of so many positions each: a stand-in for batching by size and time that replays alike.

    Positions are numbered without gaps by the log; with gaps a batch holds fewer events, never more.
    """
    return events.withColumn("batch", F.floor((F.col("position") - 1) / size).cast("bigint"))


#: Blocks of positions that are counted at once.
BLOCKS = 10_000


def ranges(frame: DataFrame, low: int, high: int, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of positions that hold ``size`` rows at most, or span that many positions; empty ones are left out.

    Counts of BLOCKS blocks tell which ranges have rows; only crowded blocks are looked into, so gaps cost nothing.
    """
    return ((begin, end) for begin, end, _ in counted_ranges(frame, low, high, size))


def counted_ranges(frame: DataFrame, low: int, high: int, size: int, n: int | None = None) -> Iterator[tuple[int, int, int | None]]:
    """``ranges`` and how many rows each holds. n: how many there are in all; None, if nobody knows, comes back for a range that is all of them."""
    width = max(1, -(-(high - low + 1) // (size * BLOCKS))) * size
    if high - low < size:
        yield low, high, n
        return
    block = F.floor((F.col("position") - low) / width).cast("bigint")
    counts = frame.where(F.col("position").between(low, high)).groupBy(block.alias("block")).count().orderBy("block").collect()
    begin, held, end = low, 0, low
    for b, n in counts:
        first, last = low + b * width, min(high, low + (b + 1) * width - 1)
        if held and held + n > size:
            yield begin, end, held
            held = 0
        if n > size:
            yield from counted_ranges(frame, first, last, size, n)
            continue
        begin, held, end = begin if held else first, held + n, last
    if held:
        yield begin, end, held


def dedup(events: DataFrame, cursors: DataFrame) -> DataFrame:
    """Events with ``repeated``: at or before their stream's cursor, or an earlier row of the batch again.

    The cursor side has one row per stream; whether it is small enough to be broadcast is for the optimizer to check.
    """
    known = cursors.select("stream_id", F.col("position").alias("__cursor"))
    first = Window.partitionBy("stream_id", "position").orderBy("id")
    found = events.join(known, "stream_id", "left").withColumn("__n", F.row_number().over(first))
    late = F.coalesce(F.col("position") <= F.col("__cursor"), F.lit(False))
    return found.select(*events.columns, (late | (F.col("__n") > 1)).alias("repeated"))


def advances(outcomes: DataFrame, *by: str) -> DataFrame:
    """The position that each stream advances to: skips don't count, dead letters do."""
    moved = F.col("outcome").isin("skipped", "deduped")
    return outcomes.where(~moved).groupBy(*by, "stream_id").agg(F.max("position").alias("position"))


def merge_cursors(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per stream; a cursor never moves back."""
    return old.select("stream_id", "position").unionByName(new.select("stream_id", "position")).groupBy("stream_id").agg(F.max("position").alias("position"))


def gapless_prefix(in_flight: DataFrame, *by: str) -> DataFrame:
    """The last position before the first uncommitted one in flight; null if that is the first of all.

    in_flight: position, committed. Committed positions that are not in flight play no part.
    """
    gap = F.min(F.when(~F.col("committed"), F.col("position")))
    bounds = in_flight.groupBy(*by).agg(gap.alias("gap"), F.max("position").alias("top"))
    joined = in_flight.join(bounds, list(by)) if by else in_flight.crossJoin(F.broadcast(bounds))  # one row
    inside = F.when(F.col("gap").isNull() | (F.col("position") < F.col("gap")), F.col("position"))
    return joined.groupBy(*by).agg(F.max(inside).alias("acknowledged"), F.sum(F.when(inside.isNull(), 1).otherwise(0)).cast("bigint").alias("left_in_flight"))


def merge_progress(old: DataFrame, new: DataFrame, *by: str) -> DataFrame:
    """Position to the greater; the event time follows the greater position, and the newer row on a tie."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return both.groupBy(*by).agg(F.max("position").alias("position"), F.max_by("occurred_at", F.struct("position", "__new")).alias("occurred_at"))


def order_violations(events: DataFrame, order: str) -> DataFrame:
    """Events that stand after one of a greater position in their stream's log order."""
    before = Window.partitionBy("stream_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("__top", F.max("position").over(before)).where("position < __top").drop("__top")


def stream_prefix(outcomes: DataFrame) -> DataFrame:
    """Rows before their stream's first unresolved event: what a pass event by event may commit."""
    first = outcomes.where("not resolved").groupBy("stream_id").agg(F.min("position").alias("__stop"))
    return outcomes.join(first, "stream_id", "left").where("resolved and (__stop is null or position < __stop)").drop("__stop")


def collisions(steps: DataFrame) -> DataFrame:
    """Mark events of a batch whose key another one claimed before, for one key per event.

    steps: batch, position, key. Keys the engine keeps for itself always lose; the merge key never does.
    """
    from foldlog.model import IGNORED_KEYS, RESERVED_KEYS

    ranked = Window.partitionBy("batch", "key").orderBy("position")
    key = F.col("key")
    return steps.withColumn("collides", F.when(key.isin(*IGNORED_KEYS), False).when(key.isin(*RESERVED_KEYS), True).otherwise(F.row_number().over(ranked) > 1))


def claims(keyed: list[tuple[int, list[str]]]) -> set[int]:
    """Positions that lose in a batch whose events claim several keys each; a loser claims nothing."""
    from foldlog.model import IGNORED_KEYS, RESERVED_KEYS

    taken: set[str] = set()
    lost: set[int] = set()
    for position, keys in sorted(keyed):
        own = [k for k in keys if k not in IGNORED_KEYS]
        if any(k in RESERVED_KEYS or k in taken for k in own):
            lost.add(position)
        else:
            taken.update(own)
    return lost


#: Rounds after which what is still open is settled in one task.
ROUNDS = 40


def lost_claims(keyed: DataFrame, cut: Callable[[DataFrame], DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """batch and position of the losers where events claim several keys each: what ``claims`` finds, for all batches at once.

    keyed: batch, position, keys. cut writes a table and reads it again. In a round, an event wins that has the least position of all open
    events with any of its keys, and whoever shares a key with it loses; both are closed. A round looks at keys by grouped minimums, so no
    batch and no key is gathered. Events that wait for each other in a chain take a round for each two of its links; after ``rounds``,
    the few that are left in such chains are settled in order, in one task.
    """
    from foldlog.model import IGNORED_KEYS, RESERVED_KEYS

    own = F.array_except("keys", F.array(*map(F.lit, IGNORED_KEYS)))  # also makes them distinct
    claimed = keyed.select("batch", "position", own.alias("keys"))
    reserved = F.arrays_overlap("keys", F.array(*map(F.lit, RESERVED_KEYS)))
    lost = claimed.where(reserved).select("batch", "position")
    open_ = cut(claimed.where(~reserved).select("batch", "position", F.explode("keys").alias("key")))
    by, of = ["batch", "key"], ["batch", "position"]
    while rounds and not open_.isEmpty():
        rounds -= 1
        first = open_.groupBy(*by).agg(F.min("position").alias("first"))
        seen = open_.join(first, by)
        wins = cut(seen.groupBy(*of).agg(F.min(F.col("first") == F.col("position")).alias("wins")).where("wins").select(*of))
        taken = open_.join(wins, of, "left_semi").select(*by)
        beaten = cut(open_.join(taken, by, "left_semi").join(wins, of, "left_anti").select(*of).distinct())
        lost = lost.unionByName(beaten)
        open_ = cut(open_.join(wins, of, "left_anti").join(beaten, of, "left_anti"))
    if rounds:
        return lost

    def rest(rows):
        import pyarrow as pa

        found: dict[int, dict[int, list[str]]] = {}
        for batch in rows:
            for b, p, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found.setdefault(b, {}).setdefault(p, []).append(k)
        out = [(b, p) for b, events in found.items() for p in sorted(claims(list(events.items())))]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], type=pa.int64()) for i in (0, 1)], names=of)

    return lost.unionByName(open_.select("batch", "position", "key").coalesce(1).mapInArrow(rest, "batch long, position long"))


def wipeouts(batch_outcomes: DataFrame, *by: str, order: str = "batch") -> DataFrame:
    """Per batch whether all of it failed on integrity, how many such batches end there in a row, and whether that halts.

    batch_outcomes: batch, attempted, committed, integrity.
    """
    from foldlog.functions.scalars import WIPEOUT_STREAK

    wiped = (F.col("attempted") > 0) & (F.col("committed") == 0) & (F.col("integrity") == F.col("attempted"))
    ordered = Window.partitionBy(*by).orderBy(order)
    marked = batch_outcomes.withColumn("wiped", wiped).withColumn("__reset", F.sum(F.when(F.col("committed") > 0, 1).otherwise(0)).over(ordered))
    streak = F.sum(F.col("wiped").cast("bigint")).over(Window.partitionBy(*by, "__reset").orderBy(order))
    return marked.withColumn("streak", F.when(F.col("wiped"), streak).otherwise(0)).withColumn("halts", F.col("wiped") & ((F.col("attempted") > 1) | (F.col("streak") >= WIPEOUT_STREAK))).drop("__reset")
