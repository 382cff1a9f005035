"""A streaming source over a log in Parquet whose offsets are positions, with admission by rows.

A micro-batch is the next ``buffer`` rows by position, however far apart they are. What is next is read from the footers' ranges
of positions and, of the row groups at the front only, the column of positions. The row groups that a batch touches are its
partitions; executors read them and keep the batch's range. While the file ``hold`` is there the end offset stays, so the query lives, what
is in flight commits and nothing new begins. After a restart the newest planned offset of the checkpoint is where it goes on.

Rows have to arrive in order: one that is written after a batch went beyond its position is not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pf
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "foldlog_positions"


@dataclass
class Piece(InputPartition):
    """Row groups of files, and the range of positions to keep of them."""

    groups: list[tuple[str, int]]
    after: int
    upto: int


@dataclass(frozen=True)
class Group:
    low: int
    high: int
    file: str
    number: int


def _opened(uri: str) -> tuple[pf.FileSystem, str]:
    return pf.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"/{uri}")


class Log:
    """The row groups of a folder (or file) of Parquet files, by position; footers are read once a file."""

    def __init__(self, uri: str, order: str):
        self.fs, self.root = _opened(uri)
        self.order, self.known, self.held = order, {}, {}

    def groups(self) -> list[Group]:
        at = self.fs.get_file_info(self.root)
        found = [at] if at.type == pf.FileType.File else self.fs.get_file_info(pf.FileSelector(self.root, recursive=True, allow_not_found=True))
        for f in found:
            if f.type == pf.FileType.File and f.path.endswith(".parquet") and not f.base_name.startswith(("_", ".")) and f.path not in self.known:
                self.known[f.path] = list(self._ranges(f.path))
        return sorted((g for gs in self.known.values() for g in gs), key=lambda g: (g.low, g.file, g.number))

    def _ranges(self, path: str) -> Iterator[Group]:
        meta = pq.read_metadata(path, filesystem=self.fs)
        column = meta.schema.names.index(self.order)
        for n in range(meta.num_row_groups):
            if not meta.row_group(n).num_rows:
                continue
            told = meta.row_group(n).column(column).statistics
            if told is not None and told.has_min_max:
                yield Group(told.min, told.max, path, n)
            else:
                held = self.positions(Group(0, 0, path, n))
                yield Group(int(held.min()), int(held.max()), path, n)

    def positions(self, group: Group) -> np.ndarray:
        """The positions of a row group, sorted; a few are kept at hand."""
        key = (group.file, group.number)
        if key not in self.held:
            with self.fs.open_input_file(group.file) as f:
                self.held[key] = np.sort(pq.ParquetFile(f).read_row_group(group.number, columns=[self.order]).column(0).to_numpy())
            while len(self.held) > 8:
                self.held.pop(next(iter(self.held)))
        return self.held[key]

    def ahead(self, after: int, rows: int) -> int:
        """The position of the rows-th row beyond one, or of the last that is there."""
        near = np.zeros(0, dtype=np.int64)
        for g in self.groups():
            if g.high <= after:
                continue
            if len(near) >= rows and near[rows - 1] < g.low:
                break
            own = self.positions(g)
            near = np.sort(np.concatenate([near, own[np.searchsorted(own, after, side="right") :][:rows]]))[:rows]
        return int(near[-1]) if len(near) else after


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.options, self.schema = options, schema
        self.uri, self.order = options["path"], options["order"]
        self.after = int(options["after"])
        self.log = None

    def _log(self) -> Log:
        if self.log is None:
            self.log = Log(self.uri, self.order)
            self.after = max(self.after, self._planned())
        return self.log

    def _planned(self) -> int:
        """The newest offset that the checkpoint has planned."""
        if "checkpoint" not in self.options:
            return self.after
        fs, root = _opened(self.options["checkpoint"])
        found = fs.get_file_info(pf.FileSelector(f"{root}/offsets", allow_not_found=True))
        numbers = [int(f.base_name) for f in found if f.base_name.isdigit()]
        if not numbers:
            return self.after
        with fs.open_input_stream(f"{root}/offsets/{max(numbers)}") as f:
            return int(json.loads(f.read().decode().splitlines()[-1])["after"])

    def _paused(self) -> bool:
        if "hold" not in self.options:
            return False
        fs, path = _opened(self.options["hold"])
        return fs.get_file_info(path).type != pf.FileType.NotFound

    def initialOffset(self) -> dict:
        return {"after": int(self.options["after"])}

    def latestOffset(self) -> dict:
        log = self._log()
        if not self._paused():
            self.after = log.ahead(self.after, int(self.options["buffer"]))
        return {"after": self.after}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        after, upto = start["after"], end["after"]
        touched = [g for g in self._log().groups() if g.high > after and g.low <= upto]
        self.after = max(self.after, upto)
        share = max(1, -(-len(touched) // int(self.options.get("partitions", "8"))))
        return [Piece([(g.file, g.number) for g in touched[k : k + share]], after, upto) for k in range(0, len(touched), share)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        fs, _ = _opened(self.uri)
        wanted = to_arrow_schema(self.schema)
        for file, number in partition.groups:
            with fs.open_input_file(file) as f:
                rows = pq.ParquetFile(f).read_row_group(number, columns=wanted.names)
            order = rows.column(self.order)
            kept = rows.filter(pc.and_(pc.greater(order, partition.after), pc.less_equal(order, partition.upto))).select(wanted.names)
            yield from pa.table([c.cast(f.type, safe=False) for c, f in zip(kept.columns, wanted, strict=True)], schema=wanted).to_batches()

    def commit(self, end: dict) -> None:
        """Nothing to let go of: the log keeps its rows."""


class Positions(DataSource):
    """Options: path, order (the column of positions), after, buffer, and as one likes hold, checkpoint, partitions."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def streamReader(self, schema) -> Reader:
        return Reader(dict(self.options), schema)


def follow(spark: SparkSession, schema, path: str, order: str, after: int, buffer: int, **options: str):
    """The log as a streaming frame of its own columns."""
    spark.dataSource.register(Positions)
    reader = spark.readStream.format(FORMAT).schema(schema)
    given = {"path": path, "order": order, "after": str(after), "buffer": str(buffer), **options}
    for k, v in given.items():
        reader = reader.option(k, v)
    return reader.load()
