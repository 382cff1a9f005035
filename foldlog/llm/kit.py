"""Shared pieces of the text operators: scratch tables, word hashing on Arrow batches, components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that one vectorised step takes; a longer text is a step of its own.
STEP_BYTES = 2_000_000


# ---------------------------------------------------------------- scratch tables

def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. A temporary one is made only where none is configured."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("foldlog.scratch", None)
        if not found:
            found = "file://" + tempfile.mkdtemp(prefix="foldlog-")
            spark.conf.set("foldlog.scratch", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the application is ending; the shared folder's owner clears what is left
        pass


class Scratch:
    """Written tables that cut lineage: a lost executor costs a reread, not a recomputation."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
        self.known: dict[str, str] = {}
        atexit.register(self.clear)

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{len(self.known)}"
        df.write.option("compression", "zstd").parquet(path)
        self.known[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, self.known.pop(name))

    def clear(self) -> None:
        _delete(self.spark, self.root)


def unused(name: str, *frames: DataFrame) -> str:
    """The name, with underscores before it until no column of the frames has it, whatever the case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def packed(df: DataFrame, columns: list[str]) -> Column:
    """The columns as one struct ``row``, whose fields cannot clash with an operator's own columns."""
    own = [F.col(f"`{c}`") for c in columns] or [F.lit(None).cast("int").alias("none")]
    return F.struct(*own).alias("row")


def unpacked(columns: list[str]) -> list[Column]:
    return [F.col(f"row.`{c}`") for c in columns]


def with_text(found: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """The columns of docs out of a struct ``whole`` (which need not hold these), with another text; n_chars follows it."""
    given = {"text": text}
    if "n_chars" in docs.columns:
        given["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return found.select(*(given[c].alias(c) if c in given else F.col(f"whole.`{c}`") for c in docs.columns))


def digests(text: Column) -> list[Column]:
    """h1 and h2: two hashes of a text from different seeds, so that texts clash in both about once in 2^128."""
    return [F.xxhash64(F.lit(1), text).alias("h1"), F.xxhash64(F.lit(2), text).alias("h2")]


def input_bytes(df: DataFrame) -> int:
    """The optimizer's size of the tables that a frame reads; 0 where it knows none. No job is run for it."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 60)  # beyond: what is not in files has no size


#: So many partitions at most, whatever the input: what a driver can keep track of.
MOST_PARTS = 50_000


def parts_for(df: DataFrame, bytes_each: int, least: int = 1) -> int:
    """A partition count that follows the input, and the session's as a floor."""
    spark = df.sparkSession
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(df) // bytes_each))


#: Bytes of a batch that goes to a Python worker, where the session says nothing else.
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A batch function that gives its memory back when its task ends: workers are reused by tasks of other kinds."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _POWERS.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return tidied


def through(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow with batches bounded in bytes, where the session has Spark's default, and workers left tidy."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_SETTING) == "67108864b":
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(tidy(run), schema)


# ---------------------------------------------------------------- hashing

def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers (splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def odd_constants(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) + U64(seed * 0x9E3779B97F4A7C15 % (1 << 64))) | U64(1)


_RADIX = 0x9E3779B97F4A7C15 | 1
_LETTER = odd_constants(7, 256)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, STEP_BYTES)
        for name, base in (("up", _RADIX), ("down", pow(_RADIX, -1, 1 << 64))):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=U64)
    return _POWERS["up"], _POWERS["down"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[i] the polynomial hash of data[:i]; see span_hash."""
    up, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(_LETTER[data] * up[: len(data)], dtype=U64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], equal for equal bytes wherever they stand."""
    _, down = _powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return _LOWER[data]


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some rows: where each starts and ends, its row, its hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True, hashed: bool = True, gaps: np.ndarray = _SPACE):
        """data: UTF-8 bytes of all rows; offsets: where each row starts, and the end; gaps: which bytes part words."""
        self.data, self.offsets = data, offsets
        n = len(data)
        solid = ~gaps[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before = np.empty(n, dtype=bool)
        after = np.empty(n, dtype=bool)
        if n:
            before[0] = after[-1] = True
            before[1:] = ~solid[:-1]
            after[:-1] = ~solid[1:]
        self.starts = np.flatnonzero(solid & (before | edge[:n]))
        self.ends = np.flatnonzero(solid & (after | edge[1:])) + 1
        self.row = np.searchsorted(offsets, self.starts, side="right") - 1
        #: first word of each row, and the end
        self.bounds = np.searchsorted(self.starts, offsets)
        if hashed:
            self.hash = span_hash(prefix_hash(_LOWER[data] if lower else data), self.starts, self.ends)


def text_steps(batch: pa.RecordBatch, column: int = 0, step: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of a string or binary column, some rows at a time; null is empty."""
    texts = batch.column(column)
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, where, data = texts.buffers()
    n = len(texts)
    at = np.frombuffer(where, dtype=wide, count=n + 1, offset=texts.offset * np.dtype(wide).itemsize).astype(np.int64) if n else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + step, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def windows(words: Words, size: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, one for each start that leaves room in its row; and those starts."""
    n = len(words.hash) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    total = np.zeros(n, dtype=U64)
    for j, c in enumerate(odd_constants(seed, size)):
        total += words.hash[j : j + n] * c
    at = np.flatnonzero(words.row[:n] == words.row[size - 1 :])
    return mix(total[at]), at


def sequence_sums(values: np.ndarray) -> np.ndarray:
    """Sums that sequence_hash takes, over 64-bit values."""
    up, _ = _powers(len(values) + 1)
    out = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(mix(values) * up[: len(values)], dtype=U64, out=out[1:])
    return out


def sequence_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end], equal for equal values wherever they stand."""
    _, down = _powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def binaries(parts: list[bytes | None]) -> pa.Array:
    return pa.array(parts, type=pa.binary())


# ---------------------------------------------------------------- components

#: So many edges at most are one task's: about 10 MB.
FEW_EDGES = 200_000


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (u, v) to (id, component), by union and find."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    ids = sorted(root)
    yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array([find(x) for x in ids], type=pa.int64())], names=["id", "component"])


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(id, component): for every end of an edge, the smallest id that is reachable from it.

    edges: columns ``a`` and ``b`` (long, not null). FEW_EDGES at most are united in one task; for more, it alternates the large-star and small-star steps of
    Kiveris et al. (2014) until nothing changes. A node of high degree is met only in grouped minimums and
    in joins whose other side has one row per node, so no neighbourhood is gathered in one place.
    """
    now = scratch.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    if now.count() <= FEW_EDGES:
        return now.coalesce(1).transform(through, _united, "id long, component long")
    k = 0
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.union(low.select("u", F.col("m").alias("v"))).distinct()
        k += 1
        then = scratch.cut(small, f"{name}-{k}")
        same = then.count() == now.count() and then.join(now, ["u", "v"], "left_anti").isEmpty()
        scratch.drop(f"{name}-{k - 1}")
        now = then
        if same:
            break
    found = now.groupBy("u").agg(F.min("v").alias("v"))
    return found.select(F.col("u").alias("id"), F.col("v").alias("component")).union(found.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
