"""Language-model scores from a sharded Elias-Fano n-gram trie.

A word's probability after its predecessor is ``(c(a, b) + MU u(b)) / (c(a) + MU)`` (Dirichlet smoothing), which sums
to one over b. The unigram u gives every word of the training texts its own relative frequency, however rare, and one
unseen word the mass of one count. Texts begin with a mark and end with one that is a token; A-Z are lower-cased;
order 2.

1. Words are counted over all training texts, in shards by their hashes. The VOCABULARY most frequent ones go to all
   tasks with their counts. That list decides only where a count is found, no probability.
2. A block of texts sends each distinct pair once, with its count in training texts, and keeps which pair each of its
   tokens is. A pair whose second word is not on the list goes to the shard of that word, any other to one by the pair's
   own hash. So no word and no pair fills a shard, and a shard knows all occurrences of the other words that it gets.
3. A shard sums its pairs' counts and writes them as a trie (see elias_fano: context and pointer levels, words sought
   relative to their context, smoothed counts quantised to a byte) to a memory map of its own, which a retried task
   makes anew: no file, no folder. It looks up all its pairs there and returns to each block its pairs' numerators, and the counts of the
   words that are not on the list. Those also give what these words divide by as predecessors, and their base scores.
4. A block's answers meet its tokens and are summed by text.
Shards follow the input's size; nothing but the frequent words is sent everywhere, and no word or pair is pruned.
Words are 63-bit hashes.

Defined cases: a null or empty text has one token, its end; a null id is not held out; repeated rows count repeatedly
and score alike; with no training text every count is 0 and all words have the unseen one's mass. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldlog.llm import kit
from foldlog.llm.elias_fano import Trie

VOCABULARY = 300_000
MU = 50.0
FOLDS, FOLD = 7, 2
SHARD_BYTES = 8 << 20
STEP = 2_500_000
BEGIN, END, FIRST = 0, 1, 2
_RARE = kit.U64(1 << 63)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == FOLD, F.lit(False))


def _words(data: np.ndarray, offsets: np.ndarray) -> kit.Words:
    words = kit.Words(data, offsets)
    words.hash |= _RARE
    return words


def _shard(x: np.ndarray, shards: int) -> np.ndarray:
    return ((kit.mix(x) >> kit.U64(32)) * kit.U64(shards) >> kit.U64(32)).astype(np.int64)


def _split(to: np.ndarray, shards: int, arrays: list[np.ndarray]) -> list[tuple[int, list[bytes]]]:
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(shards + 1)).tolist()
    return [(k, [a[order[x:y]].tobytes() for a in arrays]) for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if y > x]


# ---------------------------------------------------------------- unigrams

def _word_blocks(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in kit.text_steps(batch, 0, STEP):
                word, count = np.unique(_words(data, offsets).hash, return_counts=True)
                rows = _split(_shard(word, shards), shards, [word, count.astype(np.uint32)])
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], type=pa.int32()), *(kit.binaries([b[i] for _, b in rows]) for i in (0, 1))], names=["shard", "words", "counts"])

    return run


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, counts = [], []
    for batch in batches:
        words += [np.frombuffer(b, dtype=kit.U64) for b in batch.column(1).to_pylist()]
        counts += [np.frombuffer(b, dtype=np.uint32) for b in batch.column(2).to_pylist()]
    if words:
        word, back = np.unique(np.concatenate(words), return_inverse=True)
        count = np.bincount(back, weights=np.concatenate(counts)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(count)], names=["word", "c"])


class Unigrams:
    """Counts of the frequent words, and the sums over all."""

    def __init__(self, word: np.ndarray, count: np.ndarray, tokens: int, types: int, texts: int):
        order = np.argsort(word)
        self.word, self.count = word[order], count[order]
        self.tokens, self.types, self.texts = tokens, types, texts
        #: by code: the count as predecessor and the count as a token; codes are BEGIN, END, then the words from FIRST
        self.as_context = np.concatenate([[texts, 0], self.count]).astype(np.float64)
        self.as_token = np.concatenate([[0, texts], self.count]).astype(np.float64)

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """The code of a frequent word, the hash (with the top bit) of any other."""
        if not len(self.word):
            return hashes
        own, back = np.unique(hashes, return_inverse=True)
        at = np.minimum(np.searchsorted(self.word, own), len(self.word) - 1)
        return np.where(self.word[at] == own, (at + FIRST).astype(kit.U64), own)[back]


def unigrams(texts: DataFrame, shards: int, n_texts: int, vocabulary: int = VOCABULARY) -> Unigrams:
    scratch = kit.Scratch(texts.sparkSession, "unigrams")
    counted = texts.transform(kit.through, _word_blocks(shards), "shard int, words binary, counts binary").repartitionById(shards, "shard").transform(kit.through, _word_counts, "word long, c long")
    counted = scratch.cut(counted, "counts")
    sizes = counted.groupBy(F.floor(F.log2("c") * 8).alias("size")).agg(F.count("*").alias("n"), F.sum("c").alias("tokens"), F.min("c").alias("least")).orderBy(F.desc("size")).collect()
    least, room = 1 << 62, vocabulary
    for s in sizes:
        room -= s.n
        if room < 0:
            break
        least = s.least
    frequent = counted.where(F.col("c") >= least).toArrow()
    scratch.clear()
    return Unigrams(frequent["word"].to_numpy().view(kit.U64), frequent["c"].to_numpy(), sum(s.tokens for s in sizes) + n_texts, sum(s.n for s in sizes) + (n_texts > 0), n_texts)


# ---------------------------------------------------------------- pairs

_BLOCK = "block long, shard int, kind int, ids array<long>, a binary, b binary, c binary, d binary"
_KINDS = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("kind", pa.int32()), ("ids", pa.list_(pa.int64())), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
PAIRS, TEXTS, ANSWERS = 0, 1, 2  # kinds of rows
_LOW = kit.U64(0xFFFFFFFF)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(_KINDS)], schema=_KINDS)


def _planes(x: np.ndarray) -> bytes:
    """All first bytes, then all second ones, and so on: small numbers compress well this way."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplanes(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    flat = np.frombuffer(data, dtype=np.uint8).reshape(size, len(data) // size)
    return np.ascontiguousarray(flat.T).view(dtype).ravel()


def _pair_blocks(shards: int, shared):
    """Of each block of texts: its distinct pairs to their shards, and a row of what it knows itself.

    A shard's pairs are those of two frequent words, as one number each, then the others, as two numbers each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known: Unigrams = shared.value
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in kit.text_steps(batch, 2, STEP):
                block += 1
                words = _words(data, offsets)
                rows, n = hi - lo, np.diff(words.bounds)
                code = known.codes(words.hash)
                # tokens: the mark that begins each text, its words, the mark that ends it
                tokens = np.full(len(code) + 2 * rows, BEGIN, dtype=kit.U64)
                tokens[np.arange(len(code)) + 2 * words.row + 1] = code
                ends = words.bounds[1:] + 2 * np.arange(rows) + 1
                tokens[ends] = END
                first = np.ones(len(tokens), dtype=bool)
                first[ends] = False
                at = np.flatnonzero(first)
                own, rank = np.unique(tokens, return_inverse=True)
                pair, of = np.unique(rank[at].astype(kit.U64) << kit.U64(32) | rank[at + 1].astype(kit.U64), return_inverse=True)
                a, b = own[(pair >> kit.U64(32)).astype(np.int64)], own[(pair & _LOW).astype(np.int64)]
                count = np.bincount(of, weights=np.repeat(~out[lo:hi], n + 1), minlength=len(pair)).astype(np.uint32)
                wide = (a | b) & _RARE > 0
                to = 2 * _shard(np.where(b & _RARE > 0, b, a * kit.U64(0x9E3779B97F4A7C15) + b), shards) + wide
                order = np.argsort(to, kind="stable")
                a, b, count = a[order], b[order], count[order]
                place = np.empty(len(order), dtype=np.uint32)
                place[order] = np.arange(len(order), dtype=np.uint32)
                cuts = np.searchsorted(to[order], np.arange(2 * shards + 1)).tolist()
                sent = []
                for k, (x, y, z) in enumerate(zip(cuts[:-2:2], cuts[1::2], cuts[2::2], strict=True)):
                    if z > x:
                        sent.append((block, k, PAIRS, None, _planes(a[x:y] << kit.U64(32) | b[x:y]), _planes(a[y:z]), _planes(b[y:z]), _planes(count[x:z])))
                seen = code & _RARE == 0
                row, c = words.row[seen], known.as_context[code[seen].astype(np.int64)]
                base = np.bincount(row, weights=np.log10(c + 1), minlength=rows) + np.log10(known.texts + 1)
                below = np.bincount(row, weights=np.log10(c + MU), minlength=rows) + np.log10(known.texts + MU)
                n_known = np.bincount(row, minlength=rows) + (known.texts > 0)
                own_sums = np.stack([n + 1.0, base, n_known, below])
                sent.append((block, int(_shard(np.array([block], dtype=kit.U64), shards)[0]), TEXTS, ids[lo:hi], own_sums.tobytes(), _planes(place[of]), out[lo:hi].astype(np.uint8).tobytes(), None))
                yield _rows(sent)

    return run


def _score_shard(shared):
    """Of a shard's blocks: an answer to each pair, in the order of the question; rows of texts pass.

    a: log10 of the pair's smoothed count; b: of the pairs that are two numbers, how often the second word stands in
    training texts, -1 where that is known everywhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Unigrams = shared.value
        blocks, a, b, counts = [], [], [], []
        for batch in batches:
            passed = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[2] == TEXTS:
                    passed.append(row)
                    continue
                narrow, wide = _unplanes(row[4], kit.U64), _unplanes(row[5], kit.U64)
                a += [narrow >> kit.U64(32), wide]
                b += [narrow & _LOW, _unplanes(row[6], kit.U64)]
                counts.append(_unplanes(row[7], np.uint32))
                blocks.append((row[0], row[1], len(narrow), len(wide)))
            if passed:
                yield _rows(passed)
        if not blocks:
            return
        contexts, rank = np.unique(np.concatenate(a), return_inverse=True)
        lexicon, word = np.unique(np.concatenate(b), return_inverse=True)
        del a, b
        key, pair = np.unique(rank.astype(kit.U64) << kit.U64(32) | word.astype(kit.U64), return_inverse=True)
        del rank, word
        count = np.bincount(pair, weights=np.concatenate(counts), minlength=len(key))
        which, word = (key >> kit.U64(32)).astype(np.int64), (key & _LOW).astype(np.int64)
        del key, counts
        rare = lexicon & _RARE > 0
        # all pairs of a rare second word are here
        times = np.bincount(word, weights=count, minlength=len(lexicon))
        times[~rare] = known.as_token[lexicon[~rare].astype(np.int64)]
        smooth = MU * np.maximum(times, 1) / (known.tokens + 1)
        value = np.log10(smooth)[word]
        trained = count > 0
        trie = Trie(Trie.build(contexts[which[trained]], word[trained], np.log10(count[trained] + smooth[word[trained]])))
        per = np.bincount(which, minlength=len(contexts))
        ends = np.cumsum(per)
        lo = 0
        while lo < len(contexts):  # some contexts at a time, about 50,000 pairs
            begin = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, begin + 50_000, side="right")))
            hit, found = trie.find(contexts[lo:hi], per[lo:hi], word[begin : int(ends[hi - 1])])
            value[begin : begin + len(hit)][hit] = found[hit]
            lo = hi
        del trie
        value, times = value.astype(np.float32), np.where(rare, times, -1).astype(np.int64)
        at = 0
        for block, shard, narrow, wide in blocks:
            asked = pair[at : at + narrow + wide]
            at += narrow + wide
            yield _rows([(block, shard, ANSWERS, None, _planes(value[asked]), _planes(times[word[asked[narrow:]]]), None, None)])

    return run


def _gathered(shared_base: float):
    """Rows sorted by block and shard to (doc_id, held_out, n_tokens, n_known, base_score, score)."""

    def finish(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        _, _, _, ids, own_sums, of, out, _ = next(r for r in rows if r[2] == TEXTS)
        n, base, known, below = np.frombuffer(own_sums).reshape(4, -1).copy()
        of = _unplanes(of, np.uint32)
        starts = (np.cumsum(n) - n).astype(np.int64)
        values, times = [], []
        for r in rows:
            if r[2] == ANSWERS:
                values.append(_unplanes(r[4], np.float32))
                wide = _unplanes(r[5], np.int64)
                times += [np.full(len(values[-1]) - len(wide), -1), wide]
        score = np.add.reduceat(np.concatenate(values).astype(np.float64)[of], starts)
        c = np.concatenate(times)[of]
        rare = c >= 0
        if rare.any():
            c = np.maximum(c, 0)
            base += np.add.reduceat(np.where(rare, np.log10(c + 1), 0), starts)
            known += np.add.reduceat(rare & (c > 0), starts, dtype=np.int64)
            below += np.add.reduceat(np.where(rare, np.log10(c + MU), 0), starts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, type=pa.int64()), pa.array(np.frombuffer(out, dtype=np.uint8).astype(bool)), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base - n * shared_base), pa.array(score - below)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][0] != row[0]:
                    yield from finish(held)
                    held = []
                held.append(row)
        if held:
            yield from finish(held)

    return run


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = VOCABULARY) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shards = kit.parts_for(df, SHARD_BYTES)
    n_texts = rows.where("not held_out").count()
    known = unigrams(rows.where("not held_out").select("text"), shards, n_texts, vocabulary)
    shared = spark.sparkContext.broadcast(known)
    pairs = rows.transform(kit.through, _pair_blocks(shards, shared), _BLOCK).repartitionById(shards, "shard").transform(kit.through, _score_shard(shared), _BLOCK)
    share = float(np.log10(known.tokens + known.types + 1))
    gathered = pairs.repartition(shards, "block").sortWithinPartitions("block", "shard").transform(kit.through, _gathered(share), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return gathered.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(known.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
