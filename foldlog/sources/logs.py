"""Event sources: a Parquet log as batch or stream, and a list in memory."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlog import model
from foldlog.operators import events
from foldlog.sources import positions

_BEFORE_ALL = -(1 << 62)


class Source(ABC):
    """Yields envelopes. ``batch`` reads what is there; ``stream`` follows the log."""

    @abstractmethod
    def batch(self, spark: SparkSession, after: int | str = "origin") -> DataFrame: ...

    @abstractmethod
    def stream(self, spark: SparkSession, after: int | str = "origin") -> DataFrame: ...

    def first(self, spark: SparkSession) -> int | str:
        """Where a projection starts that was never started before: ``origin`` or a position; decided once."""
        start = getattr(self, "start", "origin")
        return (self.batch(spark, "origin").agg(F.max("position")).first()[0] or 0) if start == "current" else start


class ParquetLog(Source):
    """A log in Parquet files, mapped to envelopes by columns.

    start_from holds for the first start only: the engine notes beside the checkpoint what it came to, and neither a
    resume nor a changed option moves it. The filter on position is pushed into the scan.

    buffer_size: events in flight, that is, taken up, handled and committed at once. With it, micro-batches are the next so many
    rows by position (see positions.py); order names the log's own column of positions, shift is what the envelope's are ahead of it.
    Without it, Spark's file source takes up what is new; max_files bounds how much at once.
    """

    def __init__(self, path: str, schema: str | None = None, *, start_from: int | str = "origin", max_files: int | None = None, buffer_size: int | None = None, order: str | None = None, shift: int = 0, **columns: Column):
        if buffer_size is not None and (not isinstance(buffer_size, int) or isinstance(buffer_size, bool) or buffer_size < 1):
            raise ValueError("buffer_size has to be a positive integer")
        if buffer_size and columns and not order:
            raise ValueError("buffer_size needs order, the log's column of positions")
        self.path, self.schema, self.start, self.max_files, self.buffer_size, self.columns = path, schema, start_from, max_files, buffer_size, columns
        self.order, self.shift = order or "position", shift

    def batch(self, spark, after=None):
        rows = spark.read.parquet(self.path) if self.schema is None else spark.read.schema(self.schema).parquet(self.path)
        return events.start_from(self._mapped(rows), self.start if after is None else after)

    def stream(self, spark, after=None, **options):
        """options: for a log with buffer_size, where its checkpoint is and which file holds it."""
        after = self.first(spark) if after is None else after
        schema = self.schema or spark.read.parquet(self.path).schema
        if self.buffer_size:
            begin = _BEFORE_ALL if after == "origin" else int(after) - self.shift
            return self._mapped(positions.follow(spark, schema, self.path, self.order, begin, self.buffer_size, **options))
        reader = spark.readStream.schema(schema)
        if self.max_files:
            reader = reader.option("maxFilesPerTrigger", self.max_files)
        return events.start_from(self._mapped(reader.parquet(self.path)), after)

    def _mapped(self, rows: DataFrame) -> DataFrame:
        return events.envelope(rows, **self.columns) if self.columns else rows.select(*model.ENVELOPE.fieldNames())


class MemoryLog(Source):
    """A finite list for tests: delivered in order of position, requeued from the acknowledged position on."""

    def __init__(self, items: list[model.Event], start_from: int = 0):
        self.items, self.acknowledged, self.paused = sorted(items, key=lambda e: e.position), start_from, False

    @property
    def pending(self) -> int:
        return sum(e.position > self.acknowledged for e in self.items)

    def take(self, spark: SparkSession, n: int) -> DataFrame | None:
        """The next n events that are not acknowledged; None while paused or at the end."""
        queue = [] if self.paused else [e for e in self.items if e.position > self.acknowledged][:n]
        return self._frame(spark, queue) if queue else None

    def acknowledge(self, position: int) -> None:
        self.acknowledged = max(self.acknowledged, position)

    def batch(self, spark, after="origin"):
        return events.start_from(self._frame(spark, self.items), after)

    def stream(self, spark, after="origin"):
        raise NotImplementedError("a list in memory is drained by take()")

    @staticmethod
    def _frame(spark: SparkSession, items: list[model.Event]) -> DataFrame:
        from foldlog.operators.handlers import plain

        return spark.createDataFrame([(e.id, str(e.stream_id), e.type, plain(e.data), e.metadata, e.position, e.occurred_at) for e in items], model.ENVELOPE)


def event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's events as envelopes. Their ids start at 0, and position 0 stands for nothing applied: so plus one."""
    return mapped(spark.read.parquet(f"{sf_dir}/events.parquet"))


def event_range(spark: SparkSession, sf_dir: str, low: int, high: int) -> DataFrame:
    """The envelopes from one position to another: the scan skips row groups by the table's own ids.

    Neighbours stand in one place of a file, so rows are dealt out before their payload is written as JSON, and as the search
    for repeats in a pass asks for them, so that this needs no exchange of its own.
    """
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("event_id").between(low - 1, high - 1))
    return mapped(rows.select("*", F.col("user_id").cast("string").alias("stream_id"), (F.col("event_id") + 1).alias("position")).repartition("stream_id", "position"))


def mapped(rows: DataFrame) -> DataFrame:
    dealt = "position" in rows.columns
    return events.envelope(
        rows, id=F.col("event_id"), stream_id=F.col("stream_id" if dealt else "user_id"), type=F.col("event_type"), position=F.col("position") if dealt else F.col("event_id") + 1, occurred_at=F.col("ts"),
        data=F.to_json(F.struct("value", "props")), metadata=F.from_json("props", "map<string,string>"),
    )
