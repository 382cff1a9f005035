"""Benchmark decontamination by spaced seeds: hits under fixed masks, then overlaps that tolerate substitutions.

Texts are lower-cased (A-Z), ASCII punctuation counts as space, and words are hashed. A mask such as ``111011011``
hashes the words under its ones and ignores the others, so a changed word hides under one mask or another. Hashes of
the benchmark's windows are looked up for all windows of all documents. Each hit names a diagonal (document position
less item position); on it, words are compared one by one. An item contaminates a document if on some diagonal
- the best run holds MATCHED equal words at least, where an equal word counts 1 and a different one -2
  (of runs that count the same, the shortest), for items of more than MATCHED words;
- all words but one are equal, for items of 5 to MATCHED words; all words are, for shorter ones.
The masks leave no such overlap out: for each of the 763 ways that equal and different words can follow each other up
to the twelfth equal one, some mask fits somewhere. Items of less than 10 words have masks of their own: the whole
item, with each single word ignored if it has 5 or more.

The documents are only scanned: no shuffle, and no group of theirs is gathered. The benchmark goes to the tasks in
blocks of BLOCK_BYTES of text; a larger benchmark means more blocks, each in a pass of its own that is written before
the next. So passes grow with the benchmark, which is small beside a corpus, and nothing grows with the documents.

Defined cases: a null or empty text is clean; a null or empty item matches nothing; items with equal texts all count;
of an item's diagonals the one with most equal words is told, the first of equals; repeated rows get equal results.
Other columns are kept, whatever their names; one named ``hits`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldlog.llm import kit

#: Fixed masks, found by greedy cover over all overlaps that are accepted; each looks at seven words.
MASKS = ("111011011", "11110101001", "11111000101", "11101110001", "1110110101", "1101100111", "11101011001", "1111111")
MATCHED = 12
#: Items of fewer words than this have masks of their own, and of fewer than that must stand whole.
SHORT, WHOLE = 10, 5
#: A document goes in the pipeline's stage if so many words of an item stand in it: fewer are no passage.
PASSAGE = 5
#: Hits that are taken apart at a time.
HITS = 2_000_000
BLOCK_BYTES = 8 << 20
HIT = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("matched", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType())]))

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 32


def words_of(data: np.ndarray, offsets: np.ndarray) -> kit.Words:
    return kit.Words(_PLAIN[data], offsets, lower=False)


def _spaced(words: kit.Words, mask: str, seed: int) -> tuple[np.ndarray, np.ndarray]:
    span = len(mask)
    n = len(words.hash) - span + 1
    if n <= 0:
        return np.zeros(0, dtype=kit.U64), np.zeros(0, dtype=np.int64)
    total = np.zeros(n, dtype=kit.U64)
    for j, c in enumerate(kit.odd_constants(seed, span)):
        if mask[j] == "1":
            total += words.hash[j : j + n] * c
    at = np.flatnonzero(words.row[:n] == words.row[span - 1 :])
    return kit.mix(total[at]), at


class Index:
    """The windows of a block of items: sorted hashes, with item and position, for each mask."""

    def __init__(self, items: list[tuple[int, str]]):
        data = [t.encode() for _, t in items]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
        words = words_of(np.frombuffer(b"".join(data), dtype=np.uint8), offsets)
        self.ids = np.array([i for i, _ in items], dtype=np.int64)
        self.bounds, self.hash = words.bounds, words.hash
        sizes = np.diff(words.bounds)
        self.tables = []
        own = [(mask, None) for mask in MASKS]
        for n in sorted({int(n) for n in sizes if 0 < n < SHORT}):
            own += [("1" * n, n)] if n < WHOLE else [("1" * i + "0" + "1" * (n - 1 - i), n) for i in range(n)]
        for k, (mask, size) in enumerate(own):
            found, at = _spaced(words, mask, 100 + k)
            mine = sizes[words.row[at]]
            keep = mine == size if size else mine >= SHORT
            found, at = found[keep], at[keep]
            order = np.argsort(found, kind="stable")
            seen = np.zeros(1 << 20, dtype=bool)
            seen[(found >> kit.U64(44)).astype(np.int64)] = True
            self.tables.append((mask, k, found[order], at[order], words.row[at[order]], seen))

    def _diagonals(self, words: kit.Words) -> Iterator[np.ndarray]:
        """Rows (row, item, diagonal) of the hits, some at a time."""
        for mask, k, table, at, item, seen in self.tables:
            if not len(table):
                continue
            found, where = _spaced(words, mask, 100 + k)
            maybe = seen[(found >> kit.U64(44)).astype(np.int64)]
            found, where = found[maybe], where[maybe]
            lo, hi = np.searchsorted(table, found), np.searchsorted(table, found, side="right")
            hit = hi > lo
            lo, where, n = lo[hit], where[hit], (hi - lo)[hit]
            part = np.cumsum(n) // HITS
            for p in np.unique(part):
                own = part == p
                m = n[own]
                pick = np.repeat(lo[own] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
                w = np.repeat(where[own], m)
                yield np.unique(np.stack([words.row[w], item[pick], (w - words.bounds[words.row[w]]) - (at[pick] - self.bounds[item[pick]])], axis=1), axis=0)

    def hits(self, words: kit.Words) -> list[list[tuple[int, int, int, int]]]:
        """For each row: (item id, equal words, first word in the row, words of the item), best run per item."""
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in range(len(words.bounds) - 1)]
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for row, item, diagonal in (x for some in self._diagonals(words) for x in some.tolist()):
            n = int(self.bounds[item + 1] - self.bounds[item])
            matched, first = self._run(words, row, item, diagonal, n)
            if matched >= (MATCHED if n > MATCHED else n - 1 if n >= WHOLE else n):
                have = best.get((row, item))
                if have is None or (matched, -first) > (have[0], -have[1]):
                    best[row, item] = matched, first
        for (row, item), (matched, first) in sorted(best.items()):
            out[row].append((int(self.ids[item]), matched, first, int(self.bounds[item + 1] - self.bounds[item])))
        return out

    def _run(self, words: kit.Words, row: int, item: int, diagonal: int, n: int) -> tuple[int, int]:
        """Equal words on a diagonal, and where they begin: of the best run, or of the whole item if it is no longer."""
        a = self.bounds[item]
        s, e = words.bounds[row], words.bounds[row + 1]
        lo, hi = max(0, -diagonal), min(n, e - s - diagonal)
        same = self.hash[a + lo : a + hi] == words.hash[s + diagonal + lo : s + diagonal + hi]
        start, end = 0, len(same)
        if n > MATCHED:
            worth = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
            end = int(np.argmax(worth - np.minimum.accumulate(worth)))
            start = end - int(np.argmin(worth[: end + 1][::-1]))
        return int(same[start:end].sum()), int(diagonal + lo + start + np.argmax(same[start:end])) if same[start:end].any() else 0


_INDEXES: dict[int, Index] = {}


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        key = hash(tuple(items))
        if key not in _INDEXES:
            _INDEXES.clear()
            _INDEXES[key] = Index(items)
        index = _INDEXES[key]
        names = HIT.elementType.fieldNames()
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in names]))
        for batch in batches:
            for lo, hi, data, offsets in kit.text_steps(batch, 1):
                found = index.hits(words_of(data, offsets))
                hits = [have + [dict(zip(names, h, strict=True)) for h in row] for have, row in zip(batch.column(2)[lo:hi].to_pylist(), found, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(hits, type=kind)], names=["row", "text", "hits"])

    return run


def _item_blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for item, text in items.toLocalIterator():
        block.append((item, text))
        size += len(text)
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminations(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """df with ``hits``: (item_id, matched, first_word, n_words) of every item that a text contains."""
    items = benchmark.where(F.col(item_text).isNotNull() & F.col(item_col).isNotNull()).select(F.col(item_col).cast("long"), F.col(item_text)).orderBy(item_col)
    rest = [c for c in df.columns if c != "hits"]
    out = df.select(kit.packed(df, rest), F.col(text_col).alias("text"), F.array().cast(HIT).alias("hits"))
    blocks = _item_blocks(items)
    block, scratch, k = next(blocks, None), None, 0
    while block:
        following = next(blocks, None)
        shared = df.sparkSession.sparkContext.broadcast(block)
        out = out.transform(kit.through, _scan(shared), out.schema)
        if following:
            scratch = scratch or kit.Scratch(df.sparkSession, "decontaminate")
            out = scratch.cut(out, f"pass{k}")
            shared.unpersist()
            if k:
                scratch.drop(f"pass{k - 1}")
        block, k = following, k + 1
    return out.select(*kit.unpacked(rest), "hits")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contaminations(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no passage of a benchmark item, PASSAGE words at least."""
    found = contaminations(docs.select(F.struct(*docs.columns).alias("whole"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~F.exists("hits", lambda h: h["matched"] >= PASSAGE)).select(*(F.col(f"whole.`{c}`") for c in docs.columns))
