"""Removal of every byte that lies in a 400-byte string which also starts elsewhere, by run-length indexes.

Texts are UTF-8 bytes. Each window of WINDOW bytes is assigned to the least-hashed SEED-gram in it (the leftmost of
equals), a choice that depends on the window's bytes only: equal windows have equal anchors at equal places.
Neighbouring windows of one anchor make a context, the bytes that they cover together; the contexts of an anchor hold
all windows that can be equal. Contexts found twice or more are settled by their digests. Anchors with different
contexts are indexed: per block of such anchors a Burrows-Wheeler transform of the contexts is built and kept as
runs, with the suffix positions of run ends sampled. Left out are contexts that cannot match: an equal window reaches
equally far left of the anchor in both, so both hold all bytes that any window of such reach (in REACHES classes) holds. A suffix whose letter before it continues a run matches its
neighbour one byte less far than the suffix before it, so match lengths are computed at run ends only and streamed on
from there (the permuted LCP of an r-index, to both neighbours). Windows that match over WINDOW bytes are marked.

Anchors with more than VARIANTS contexts (a passage in very many places) are not gathered: their windows are dealt out
by their own digests and counted, which is exact as well. Equal texts are one text with a count; if it has WINDOW
bytes, all of it occurs elsewhere. Nothing is capped.

A passage that is shorter than WINDOW shows in a column of its own, which removes nothing: of a text's marks (strings of
MARK bytes that content chooses in the same way, one at least in any 2 * MARK - 1 bytes), how many another row holds too.

Defined cases: a null text counts as empty; texts under WINDOW bytes lose nothing; repeated rows are repeated texts; texts
under 2 * MARK - 1 bytes have no marks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldlog.llm import kit

WINDOW, SEED = 400, 24
#: Bytes of a mark: passages of 2 * MARK - 1 bytes that two rows share always have one, those under MARK bytes never.
MARK = 128
VARIANTS = 1_000
#: Bytes of contexts that one index is built over.
INDEX_BYTES = 1_000_000
#: Classes of how far a window reaches left of its anchor; more leave fewer contexts without a match to the index.
REACHES = 8
_PLACE = 28


# ---------------------------------------------------------------- anchors

def _least(prefix: np.ndarray, offsets: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows; where the least-hashed seed-gram of each starts, the leftmost of equals; hashes of all seed-grams."""
    n = len(prefix) - 1
    empty = np.zeros(0, dtype=np.int64)
    starts = np.concatenate([np.arange(a, b - window + 1) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) if b - a >= window] or [empty])
    if not len(starts):
        return starts, empty, empty.view(kit.U64)
    at = np.arange(n - seed + 1)
    grams = kit.span_hash(prefix, at, at + seed)
    packed = grams >> kit.U64(_PLACE) << kit.U64(_PLACE) | at.astype(kit.U64)
    w = window - seed + 1
    pad = -len(packed) % w
    grid = np.concatenate([packed, np.full(pad, np.iinfo(np.uint64).max, dtype=kit.U64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[starts], ahead[starts + w - 1])
    return starts, (least & kit.U64((1 << _PLACE) - 1)).astype(np.int64), grams


def marks_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """row and hash of all marks, those of a row once each. The hashes are mixed: the least ones begin alike and would go to one shard."""
    _, place, grams = _least(kit.prefix_hash(data), offsets, 2 * MARK - 1, MARK)
    place = np.unique(place)
    row, mark = np.searchsorted(offsets, place, side="right") - 1, kit.mix(grams[place])
    order = np.lexsort((mark, row))
    row, mark = row[order], mark[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (mark[1:] != mark[:-1])
    return row[new], mark[new]


def contexts_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """row, anchor hash, digest, first window, last window (both from the row's start), of all contexts."""
    prefix = kit.prefix_hash(data)
    starts, anchor, grams = _least(prefix, offsets, WINDOW, SEED)
    if not len(starts):
        return starts, grams, grams, starts, starts
    first = np.ones(len(starts), dtype=bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    lo = starts[first]
    hi = starts[np.append(np.flatnonzero(first)[1:], len(starts)) - 1]
    place = anchor[first]
    row = np.searchsorted(offsets, lo, side="right") - 1
    digest = kit.mix(kit.span_hash(prefix, lo, hi + WINDOW) + (place - lo).astype(kit.U64) * kit.U64(0x9FB21C651E98DF25))
    return row, grams[place], digest, lo - offsets[row], hi - offsets[row]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for lo, hi, data, offsets in kit.text_steps(batch, 1):
            row, anchor, digest, first, last = contexts_of(data, offsets)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(digest.view(np.int64)), pa.array(ids[lo:hi][row]), pa.array(first), pa.array(last)], names=["anchor", "digest", "id", "first", "last"])


# ---------------------------------------------------------------- the index

def suffix_order(letters: np.ndarray, ends: np.ndarray, longest: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Starts of all suffixes in order, each up to its string's end, equal ones by position; and the ranks on the way.

    letters: the strings one after another; ends: for each letter, where its string ends. Ranks come by lengths 7, 14,
    28, ...: two suffixes have one rank if they agree over so many letters, or to both their ends.
    """
    n = len(letters)
    at = np.arange(n)
    room = ends - at
    key = np.zeros(n, dtype=kit.U64)
    wide = np.append(letters.astype(kit.U64) + kit.U64(1), np.zeros(7, dtype=kit.U64))
    for j in range(7):
        key <<= kit.U64(9)
        key |= np.where(j < room, wide[j : j + n], kit.U64(0))
    h, levels = 7, []
    while True:
        order = np.argsort(key)
        ranked = key[order]
        steps = np.ones(n, dtype=bool)
        np.not_equal(ranked[1:], ranked[:-1], out=steps[1:])
        rank = np.empty(n, dtype=np.int32)
        rank[order] = np.cumsum(steps, dtype=np.int32)
        levels.append((h, rank))
        if h >= longest or steps.all():
            return np.argsort(rank.astype(np.int64) * n + at), levels
        key = rank.astype(kit.U64) * kit.U64(n + 1)
        key[: n - h] += np.where(room[: n - h] > h, rank[h:], 0).astype(kit.U64)
        h *= 2


def common(letters: np.ndarray, ends: np.ndarray, levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far the suffixes at a and b are equal, inside their strings."""
    room = np.minimum(ends[a] - a, ends[b] - b)
    out = np.zeros(len(a), dtype=np.int64)
    top = len(letters) - 1
    for h, rank in reversed(levels):
        same = (rank[np.minimum(a + out, top)] == rank[np.minimum(b + out, top)]) & (out < room)
        out = np.minimum(out + h * same, room)
    going = out < room
    for _ in range(levels[0][0] - 1):
        going &= (out < room) & (letters[np.minimum(a + out, top)] == letters[np.minimum(b + out, top)])
        out += going
    return out


class RunLengthIndex:
    """A run-compressed Burrows-Wheeler transform of some strings with its run ends sampled."""

    def __init__(self, strings: list[bytes]):
        self.sizes = np.array([len(s) for s in strings], dtype=np.int64)
        self.letters = np.frombuffer(b"".join(strings), dtype=np.uint8)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.ends = np.repeat(self.begins + self.sizes, self.sizes)
        order, levels = suffix_order(self.letters, self.ends, int(self.sizes.max()))
        before = np.where(order == np.repeat(self.begins, self.sizes)[order], -1, self.letters[order - 1].astype(np.int64))
        head = np.ones(len(order), dtype=bool)
        head[1:] = (before[1:] != before[:-1]) | (before[1:] < 0)
        heads = np.flatnonzero(head)
        tails = np.append(heads[1:], len(order)) - 1
        #: the transform: a letter (-1 where a string starts) and a length for each run
        self.run_letters, self.run_lengths = before[heads], np.diff(np.append(heads, len(order)))
        #: sampled positions of run heads and run ends, and how far each matches the suffix beyond the run
        self.samples = []
        for inside, outside in ((heads, heads - 1), (tails, tails + 1)):
            there = (outside >= 0) & (outside < len(order))
            length = np.zeros(len(inside), dtype=np.int64)
            length[there] = common(self.letters, self.ends, levels, order[inside[there]], order[outside[there]])
            self.samples.append((order[inside], length))

    def matches(self) -> np.ndarray:
        """For each position, the longest match with another suffix: streamed from the samples in text order."""
        n = len(self.letters)
        at = np.arange(n)
        best = np.zeros(n, dtype=np.int64)
        for where, length in self.samples:
            value = np.zeros(n, dtype=np.int64)
            value[where] = length
            last = np.zeros(n, dtype=np.int64)
            last[where] = where
            last = np.maximum.accumulate(last)
            np.maximum(best, value[last] - (at - last), out=best)
        return best


def promising(rows: list[tuple]) -> list[tuple]:
    """Of all contexts (anchor, id, first, c, bytes) of some anchors, those that can share a window with one found once.

    Windows of one class of reaches have the bytes between the class's least reach to the left and to the right in
    common, and equal windows have these equal. So a context whose bytes there are its own, class by class, has no match.
    """
    anchor = np.array([r[0] for r in rows], dtype=np.int64).view(kit.U64)
    once = np.array([r[3] for r in rows]) == 1
    sizes = np.array([len(r[4]) for r in rows], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    prefix = kit.prefix_hash(np.frombuffer(b"".join(r[4] for r in rows), dtype=np.uint8))
    # the anchor lies in the first window and in the last one; it is the leftmost of its hash
    more, room = sizes - WINDOW, WINDOW - SEED
    tried = room + 1 - more
    owner = np.repeat(np.arange(len(rows)), tried)
    at = np.arange(len(owner)) + np.repeat(begins + more - (np.cumsum(tried) - tried), tried)
    at = at[kit.span_hash(prefix, at, at + SEED) == anchor[owner]]
    place = at[np.searchsorted(at, begins)]
    reach = place - begins
    keep = np.zeros(len(rows), dtype=bool)
    for k in range(REACHES):
        least, most = k * (room + 1) // REACHES, (k + 1) * (room + 1) // REACHES - 1
        own = np.flatnonzero((reach >= least) & (reach - more <= most))
        _, group, counts = np.unique(kit.span_hash(prefix, place[own] - least, place[own] + WINDOW - most), return_inverse=True, return_counts=True)
        keep[own] |= (counts > 1)[group] & (np.bincount(group, once[own], len(counts)) > 0)[group]
    return [r for r, k in zip(rows, keep.tolist(), strict=True) if k]


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by anchor to (id, start, end): covered bytes of those that were found once."""

    def search(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows = promising(rows)
        if not rows:
            return
        index = RunLengthIndex([r[4] for r in rows])
        long = index.matches() >= WINDOW
        out = []
        for (_, ident, first, c, blob), begin in zip(rows, index.begins.tolist(), strict=True):
            if c == 1:
                out += [(ident, first + a, first + b - 1 + WINDOW) for a, b in _ranges(long[begin : begin + len(blob)])]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], type=pa.int64()) for i in range(3)], names=["id", "start", "end"])

    rows, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size >= INDEX_BYTES and row[0] != rows[-1][0]:
                yield from search(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[4])
    if rows:
        yield from search(rows)


# ---------------------------------------------------------------- contexts on the way

def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, wanted = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for lo, hi, data, offsets in kit.text_steps(batch, 1):
            rows = [(w["anchor"], ids[r], w["first"], w["c"], data[b + w["first"] : b + w["last"] + WINDOW].tobytes()) for r, b in zip(range(lo, hi), offsets.tolist(), strict=False) for w in wanted[r]]
            for k in range(0, len(rows), 4_000):
                part = rows[k : k + 4_000]
                yield pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in part], type=pa.int64()) for i in range(4)), kit.binaries([x[4] for x in part])], names=["anchor", "id", "first", "c", "context"])


def _cut_windows(shards: int):
    """Blocks (shard, digests, ids, starts) of the windows of wanted contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, wanted = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for lo, hi, data, offsets in kit.text_steps(batch, 1):
                prefix = kit.prefix_hash(data)
                digests, owners, starts = [], [], []
                for r, b in zip(range(lo, hi), offsets.tolist(), strict=False):
                    for w in wanted[r]:
                        own = np.arange(w["first"], w["last"] + 1)
                        digests.append(kit.span_hash(prefix, b + own, b + own + WINDOW))
                        owners.append(np.full(len(own), ids[r]))
                        # a context that was found twice is a target only
                        starts.append(own if w["c"] == 1 else np.full(len(own), -1))
                if digests:
                    digest, owner, start = map(np.concatenate, (digests, owners, starts))
                    yield _dealt(shards, digests=digest, ids=owner, starts=start)

    return run


def _dealt(shards: int, **columns: np.ndarray) -> pa.RecordBatch:
    """A row a shard: its number and the bytes of its part of each column; the first column, of hashes, decides."""
    digest = next(iter(columns.values()))
    to = ((digest >> kit.U64(32)) * kit.U64(shards) >> kit.U64(32)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    own, firsts = np.unique(to[order], return_index=True)
    parts = [(x, y) for x, y in zip(firsts.tolist(), [*firsts[1:].tolist(), len(order)], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(own, type=pa.int32()), *(kit.binaries([a[order[x:y]].tobytes() for x, y in parts]) for a in columns.values())], names=["shard", *columns])


def _cut_marks(shards: int):
    """Blocks (shard, marks, owners) of (id, text, m). A mark that several rows of a step hold goes out once, owned by -1; its owners go without it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            for lo, hi, data, offsets in kit.text_steps(batch, 1):
                row, mark = marks_of(data, offsets)
                if not len(row):
                    continue
                own, back, counts = np.unique(mark, return_inverse=True, return_counts=True)
                known = (counts + np.bincount(back, m[lo:hi][row] > 1, len(own))) > 1
                again, owner = known[back], ids[lo:hi][row]
                yield _dealt(shards, marks=np.concatenate([own[known], mark[~again]]), owners=np.concatenate([np.full(known.sum(), -1), owner[~again]]))
                if again.any():
                    yield pa.RecordBatch.from_arrays([pa.array([ids[lo] % shards], type=pa.int32()), kit.binaries([b""]), kit.binaries([owner[again].tobytes()])], names=["shard", "marks", "owners"])

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All blocks of some marks to (id, n_shared): how many of them another row holds too."""
    marks, owners, settled = [np.zeros(0, dtype=kit.U64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for batch in batches:
        for mark, owner in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            (owners if mark else settled).append(np.frombuffer(owner, dtype=np.int64))
            marks.append(np.frombuffer(mark, dtype=kit.U64))
    mark, owner = np.concatenate(marks), np.concatenate(owners)
    order = np.argsort(mark)
    mark, owner = mark[order], owner[order]
    firsts = np.flatnonzero(np.diff(mark, prepend=~mark[:1]))
    counts = np.diff(np.append(firsts, len(mark)))
    shared = np.repeat((counts > 1) | (owner[firsts] < 0), counts) & (owner >= 0)
    ids, n = np.unique(np.concatenate([*settled, owner[shared]]), return_counts=True)
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], names=["id", "n_shared"])


def _recounted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [[np.frombuffer(b, dtype=t) for b in row] for batch in batches for row, t in ((batch.column(i).to_pylist(), t) for i, t in ((1, kit.U64), (2, np.int64), (3, np.int64)))]
    if not parts:
        return
    digest, owner, start = (np.concatenate([x for p in parts[i::3] for x in p]) for i in range(3))
    _, back, counts = np.unique(digest, return_inverse=True, return_counts=True)
    again = (counts[back] > 1) & (start >= 0)
    owner, start = owner[again], start[again]
    order = np.lexsort((start, owner))
    owner, start = owner[order], start[order]
    cuts = np.flatnonzero(np.diff(owner)) + 1
    rows = [(int(owner[x]), start[x:y].tobytes()) for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(owner)], strict=True) if y > x]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], type=pa.int64()), kit.binaries([r[1] for r in rows])], names=["id", "starts"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, h2, m, text, spans, blocks of starts, n_shared) to (h1, h2, n_bytes, n_removed, n_spans, n_shared, kept)."""
    for batch in batches:
        h1, h2, m, spans, blocks, shared = (batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5, 6))
        for lo, hi, data, offsets in kit.text_steps(batch, 3):
            rows = []
            for r, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True), lo):
                own = data[a:b]
                if m[r] > 1 and len(own) >= WINDOW:
                    gone = np.ones(len(own), dtype=bool)
                else:
                    delta = np.zeros(len(own) + 1, dtype=np.int64)
                    for s in spans[r] or ():
                        delta[s["start"]] += 1
                        delta[s["end"]] -= 1
                    for block in blocks[r] or ():
                        starts = np.frombuffer(block, dtype=np.int64)
                        np.add.at(delta, starts, 1)
                        np.add.at(delta, starts + WINDOW, -1)
                    gone = np.cumsum(delta)[:-1] > 0
                rows.append((h1[r], h2[r], len(own), int(gone.sum()), len(_ranges(gone)), shared[r], own[~gone].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], type=pa.binary() if i == 6 else pa.int64()) for i in range(7)], names=["h1", "h2", "n_bytes", "n_removed", "n_spans", "n_shared", "kept"])


def remove_repeats(df: DataFrame, text_col: str = "text") -> DataFrame:
    """A row for each distinct text: h1 and h2 (its two digests, see ``keys``), n_bytes, n_removed, n_spans, n_shared, kept (binary)."""
    scratch = kit.Scratch(df.sparkSession, "run-length-index")
    rows = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    once = rows.select(*keys("text"), "text").groupBy("h1", "h2").agg(F.first("text").alias("text"), F.count("*").alias("m"))
    # the id is never null; said here, the joins below need no filters of their own, and all use one exchange of the texts
    texts = scratch.cut(once.withColumn("id", F.monotonically_increasing_id()), "texts").select("id", "text", "h1", "h2", "m").where("id is not null")
    found = scratch.cut(texts.where(F.octet_length("text") >= WINDOW).select("id", "text").transform(kit.through, _anchors, "anchor long, digest long, id long, first long, last long"), "anchors")

    kinds = found.groupBy("anchor", "digest").agg(F.count("*").alias("c"), F.min("id").alias("id"))
    open_ = kinds.groupBy("anchor").agg(F.count("*").alias("v"), F.min("c").alias("least")).where("v > 1 and least = 1").select("anchor", "v")
    kinds = scratch.cut(kinds.join(open_, "anchor", "left").where("c > 1 or v is not null").select("anchor", "digest", "c", F.coalesce("v", F.lit(1)).alias("v"), "id"), "kinds")
    settled = found.join(kinds.where("c > 1").select("anchor", "digest"), ["anchor", "digest"]).select("id", F.col("first").alias("start"), (F.col("last") + WINDOW).alias("end"))

    # of a context that stands several times, one place in its least text is enough as a target
    first_of = found.join(kinds.where("v > 1"), ["anchor", "digest", "id"]).groupBy("anchor", "digest", "id").agg(F.min("first").alias("first"), F.max(F.col("last") - F.col("first")).alias("more"), F.first("c").alias("c"), F.first("v").alias("v"))
    variants = scratch.cut(first_of.select("id", "v", F.struct("anchor", "first", (F.col("first") + F.col("more")).alias("last"), "c").alias("w")), "variants")
    n = kit.parts_for(df, 16 << 20)

    def wanted(condition: str) -> DataFrame:
        return texts.join(variants.where(condition).groupBy("id").agg(F.collect_list("w").alias("wanted")), "id").select("id", "text", "wanted", "h1", "h2", "m")

    contexts = wanted(f"v <= {VARIANTS}").transform(kit.through, _cut_contexts, "anchor long, id long, first long, c long, context binary")
    marked = contexts.repartition(n, "anchor").sortWithinPartitions("anchor").transform(kit.through, _marked, "id long, start long, end long")
    spans = settled.union(marked).groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    windows = wanted(f"v > {VARIANTS}").transform(kit.through, _cut_windows(n), "shard int, digests binary, ids binary, starts binary")
    recounted = windows.repartition(n, "shard").transform(kit.through, _recounted, "id long, starts binary").groupBy("id").agg(F.collect_list("starts").alias("blocks"))
    marks = texts.where(F.octet_length("text") >= 2 * MARK - 1).select("id", "text", "m").transform(kit.through, _cut_marks(n), "shard int, marks binary, owners binary")
    met = marks.repartition(n, "shard").transform(kit.through, _met, "id long, n_shared long").groupBy("id").agg(F.sum("n_shared").alias("n_shared"))
    whole = texts.join(spans, "id", "left").join(recounted, "id", "left").join(met, "id", "left").select("h1", "h2", "m", "text", "spans", "blocks", F.coalesce("n_shared", F.lit(0)).alias("n_shared"))
    return whole.transform(kit.through, _removed, "h1 long, h2 long, n_bytes long, n_removed long, n_spans long, n_shared long, kept binary")


def keys(text_col: str) -> list:
    return kit.digests(F.coalesce(F.col(text_col), F.lit("")))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = remove_repeats(docs).select("h1", "h2", "n_bytes", "n_removed", "n_spans", "n_shared", F.sha2("kept", 256).alias("kept_sha256"))
    return docs.select("doc_id", *keys("text")).join(found, ["h1", "h2"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared")
