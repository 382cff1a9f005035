"""A draw of documents that leans towards a target: hashed n-gram weights, Gumbel noise, the highest scores.

1. Features are runs of 1 to 3 consecutive words (letters, digits and what is beyond ASCII; A-Z lower-cased), joined by a space. A
   feature's bucket is its CRC-32 modulo BUCKETS. Tasks count buckets in arrays, which are summed for all texts and for the target's.
2. A bucket's gain is ``floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B))))``. The array of gains (10,000 numbers) goes to all tasks; a text's
   weight is the sum over its features, and its score adds Gumbel noise that its id decides.
3. Texts of MIN_WORDS words are eligible. Each task sorts its eligible rows into runs; runs part at ranges of the order that hold like
   numbers of rows, however many scores are equal, and ranges are counted. Ranges within the draw are merged, each from its parts
   of runs, by a tournament tree of losers; the range in which the draw ends stops there, later ones are not read again.
   A rank is the number of rows in earlier ranges and the place in the merge.

Rows of a range are held in one task (about SPAN_ROWS, 24 bytes each); the driver gets a count for each range and the bucket counts.

Defined cases: a null or empty text has no features and weight 0; ties go to the smaller doc_id, a null id comes last and is hashed as
``null``; repeated rows are drawn one by one, in any order among equals; an empty target has no features; an empty table gives no rows. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldlog.llm import kit

BUCKETS, GRAMS, MIN_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
SPAN_ROWS = 500_000
#: Words of more bytes are hashed one at a time.
LONG = 48
_GAP = np.zeros(256, dtype=bool)
_GAP[:0x30] = _GAP[0x3A:0x61] = _GAP[0x7B:0x80] = True


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def _step(state: np.ndarray, byte) -> np.ndarray:
    return _CRC[(state ^ byte) & 255] ^ (state >> np.uint32(8))


def _extended(state: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC registers after one more word each; words are taken byte by byte, all at once."""
    order = np.argsort(-np.minimum(length, LONG + 1).astype(np.int16), kind="stable")
    long = int((length > LONG).sum())
    of = order[long:]
    now, at, size = state[of], start[of], length[of]
    open_ = len(of) - np.cumsum(np.bincount(size, minlength=LONG + 1))  # words of more than k bytes
    for k in range(int(size[0]) if len(size) else 0):
        n = open_[k]
        now[:n] = _step(now[:n], data[at[:n] + k])
    out = np.empty_like(state)
    out[of] = now
    for i in order[:long].tolist():
        out[i] = zlib.crc32(data[start[i] : start[i] + length[i]], int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return out


def feature_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text, and for each length of run the texts and the buckets of its features."""
    data = kit.lowered(data)
    words = kit.Words(data, offsets, hashed=False, gaps=_GAP)
    length = words.ends - words.starts
    found, state, first = [], np.full(len(words.starts), 0xFFFFFFFF, dtype=np.uint32), np.arange(len(words.starts))
    for n in range(GRAMS):
        if n:
            first = first[:-1] if len(first) else first
            going = words.row[first] == words.row[first + n] if len(first) else np.zeros(0, dtype=bool)
            state, first = _step(state[: len(going)][going], np.uint32(32)), first[going]
        word = first + n
        state = _extended(state, data, words.starts[word], length[word])
        found.append((words.row[first], ((state ^ np.uint32(0xFFFFFFFF)) % BUCKETS).astype(np.int64)))
    return np.diff(words.bounds), found


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for _, _, data, offsets in kit.text_steps(batch):
            for _, bucket in feature_buckets(data, offsets)[1]:
                total += np.bincount(bucket, minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "c"])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of all texts fall into each bucket; texts: one column."""
    found = texts.transform(kit.through, _count, "bucket long, c long").groupBy("bucket").agg(F.sum("c").alias("c")).toPandas()
    out = np.zeros(BUCKETS, dtype=np.int64)
    out[found["bucket"].to_numpy(dtype=np.int64)] = found["c"].to_numpy(dtype=np.int64)
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    total, wanted = float(int(source.sum()) + BUCKETS), float(int(target.sum()) + BUCKETS)
    return np.array([math.floor(1000 * math.log(float(t + 1) * total / (float(s + 1) * wanted))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scored(gain: np.ndarray, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in kit.text_steps(batch, 1):
                n_words, found = feature_buckets(data, offsets)
                weight = np.zeros(hi - lo, dtype=np.int64)
                features = np.zeros(hi - lo, dtype=np.int64)
                for row, bucket in found:
                    edges = np.searchsorted(row, np.arange(hi - lo + 1))
                    sums = np.concatenate([[0], np.cumsum(gain[bucket])])
                    weight += sums[edges[1:]] - sums[edges[:-1]]
                    features += np.diff(edges)
                ids = batch.column(0)[lo:hi]
                score = weight + np.array([noise(i, seed) for i in ids.to_pylist()], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(a.astype(np.int64)) for a in (n_words, features, weight, score))], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return run


# ---------------------------------------------------------------- the draw

def _order(down: np.ndarray, doc: np.ndarray, row: np.ndarray) -> np.ndarray:
    return np.lexsort((row, doc, down))


def _runs(rows: int):
    """Rows (down, doc, row) as sorted runs of so many at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def emptied() -> pa.RecordBatch:
            columns = [np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(3)]
            held.clear()
            order = _order(*columns)
            return pa.RecordBatch.from_arrays([pa.array(c[order]) for c in columns], names=["down", "doc", "row"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= rows:
                yield emptied()
        if held:
            yield emptied()

    return run


class Losers:
    """A tournament tree over sorted runs: every inner node keeps the loser of its match, the winner moves up."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at = runs, [0] * len(runs)
        k = max(1, len(runs))
        self.tree = [-1] * k  # tree[0]: the winner; inner nodes from 1; leaf r hangs below (r + k) // 2
        winners = [-1] * k + list(range(len(runs))) + [-1] * (k - len(runs))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.tree[node] = (a, b) if self._before(a, b) else (b, a)
        self.tree[0] = winners[1]

    def _head(self, r: int):
        return self.runs[r][self.at[r]] if r >= 0 and self.at[r] < len(self.runs[r]) else None

    def _before(self, a: int, b: int) -> bool:
        x, y = self._head(a), self._head(b)
        return y is None or (x is not None and x <= y)

    def __iter__(self):
        while (head := self._head(self.tree[0])) is not None:
            yield head
            r = self.tree[0]
            self.at[r] += 1
            node = (r + len(self.tree)) // 2
            while node:
                if not self._before(r, self.tree[node]):
                    r, self.tree[node] = self.tree[node], r
                node //= 2
            self.tree[0] = r


def sorted_runs(columns: list[np.ndarray]) -> list[list[tuple]]:
    """The runs of rows that are in order already, as they came."""
    down, doc, row = columns
    before = (down[:-1] < down[1:]) | ((down[:-1] == down[1:]) & ((doc[:-1] < doc[1:]) | ((doc[:-1] == doc[1:]) & (row[:-1] <= row[1:]))))
    cuts = np.concatenate([[0], np.flatnonzero(~before) + 1, [len(down)]]).tolist()
    rows = list(zip(*(c.tolist() for c in columns), strict=True))
    return [rows[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


def _merged(first: dict[int, int], draw: int):
    """Rows (span, down, doc, row) of whole spans to (row, rank); first: rows before each span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            span = batch.column(0).to_numpy()
            for s in np.unique(span).tolist():
                spans.setdefault(s, []).append(batch.filter(pa.array(span == s)))
        for s, held in spans.items():
            columns = [np.concatenate([b.column(k).to_numpy() for b in held]) for k in (1, 2, 3)]
            tree = Losers(sorted_runs(columns))
            rows = [row for _, (_, _, row) in zip(range(draw - first[s]), tree)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, type=pa.int64()), pa.array(np.arange(1, len(rows) + 1) + first[s])], names=["row", "rank"])

    return run


def draw_highest(scored: DataFrame, draw: int, scratch: kit.Scratch, span_rows: int = SPAN_ROWS) -> DataFrame:
    """(row, rank) of the highest ``draw`` scores; scored: a written table of score, doc_id and a unique row."""
    given = scored.select((-F.col("score")).alias("down"), F.coalesce(F.col("doc_id").cast("long"), F.lit(np.iinfo(np.int64).max)).alias("doc"), "row")
    spans = max(1, min(kit.MOST_PARTS, -(-scored.count() // span_rows)))
    ranged = given.transform(kit.through, _runs(span_rows), given.schema).repartitionByRange(spans, "down", "doc", "row").withColumn("span", F.spark_partition_id())
    ranged = scratch.cut(ranged, "ranged")
    counts = dict(ranged.groupBy("span").count().orderBy("span").collect())
    first = dict(zip(counts, accumulate(counts.values(), initial=0), strict=False))
    within = [s for s, n in first.items() if n < draw]
    if not within:
        return scored.sparkSession.createDataFrame([], "row long, rank long")
    met = ranged.where(F.col("span") <= within[-1]).select("span", "down", "doc", "row").repartition(len(within), "span")
    return met.transform(kit.through, _merged({s: first[s] for s in within}, draw), "row long, rank long")


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, seed: int = SEED, span_rows: int = SPAN_ROWS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, and the rank of those drawn."""
    scratch = kit.Scratch(docs.sparkSession, "resample")
    given = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    gain = gains(bucket_counts(given.select("text")), bucket_counts(target.select(F.col(f"`{target_col}`").alias("text"))))
    scored = given.transform(kit.through, _scored(gain, seed), "doc_id long, n_words long, n_features long, weight long, score long").withColumn("row", F.monotonically_increasing_id())
    scored = scratch.cut(scored, "scored")
    eligible = scored.where(F.col("n_words") >= MIN_WORDS)
    drawn = draw_highest(eligible, percent * eligible.count() // 100, scratch, span_rows)
    return scored.join(drawn, "row", "left").drop("row")


def query(spark, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
