"""Jaccard self-join on 5-word shingles by a grouped prefix join, and the components of its links.

Two texts link if ``100 * |A & B| >= 75 * |A | B|``. In any fixed order of shingles, linked sets share one of their
first ``n - ceil(0.75 n) + 1``. The order here is by hash, except that frequent shingles come last, so shared
passages are seldom in a prefix. (Which shingles count as frequent is a bounded list of the most frequent ones; any
list gives the same links, so its bound costs time at worst.)

1. Equal texts are one node: the least doc_id of those that hold it.
2. Nodes with equal size and prefix form a group; groups, not nodes, are listed under the shingles of their prefix.
   Shingles that have the same groups make one list.
3. First pass: a list is led by its most central group, the one whose shingles are in the most lists' places; each
   group is paired with the leader of most of its lists, and each member with its group's first. Pairs are verified
   on whole sets and give components. A large group of near copies mostly ends here.
4. Rounds, for whatever is apart: a list whose groups lie in several components (and a group whose members do) is
   dealt out to cells. In a cell, pairs of groups are filtered by size; those that fit are expanded to their members,
   and members of different components by a bound on the overlap (the parity bitmaps of both sets differ in no more
   places than the sets). Of what passes, pairs that would join two components are verified, and a few more for each
   node, so a cell names about as many pairs as it has nodes; where a pair fails and others were not named, the next
   round names more of the rest. The rounds end when no pair is left that could link: every pair with a shared prefix shingle is then linked, in one
   component by other links, or refuted. No list, bucket or partner count is capped.

Posting lists travel as binary blocks, one per step and shard, with 32-bit shingle keys within a shard; a clash adds
a candidate and is refuted by the verification, for which the texts travel compressed and sets are made anew. A list's
cells hold about CELL_SHINGLES of shingles each, whatever the list's length.

Defined cases: a null or empty text, or one without words, has no shingles and links with nothing; a text of one to
four words has one shingle, itself; rows with one doc_id are one document with the links of all of them; a row without
a doc_id gets a null component. Repeated rows give repeated result rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldlog.llm import kit

#: Bytes of texts that a verification task takes apart at a time.
VERIFY_BYTES = 2_000_000
WORDS = 5
#: Shingles in at least so many nodes are candidates for the list of frequent ones, which has at most HOT_MAX entries.
HOT_LEAST, HOT_MAX = 12, 1_000_000
#: Bytes of text that one shard of posting lists answers for.
SHARD_BYTES = 16 << 20
#: Messages that one verification task gets for a pivot.
FAN = 2_000
#: So many pairs at most are sent to all tasks that hold texts: about 5 MB.
FEW = 100_000
#: Shingles of the sets on either side of a cell.
CELL_SHINGLES = 4_000_000
#: Bytes of the least bitmap, and what all are folded to for a first look.
FOLDED = 64
#: Cells of so many rows at most have all their pairs looked at together with those of other cells.
SMALL = 32
#: Each round may name so many times as many partners of a node as the last.
MORE = 8


def need(n):
    """The overlap that a set of n needs with any partner."""
    return -(-3 * n // 4)


def sets_of(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    words = kit.Words(data, offsets)
    found, at = kit.windows(words, WORDS)
    where = np.searchsorted(at, words.bounds)
    out = []
    for r, count in enumerate(np.diff(words.bounds).tolist()):
        if count >= WORDS:
            out.append(np.unique(found[where[r] : where[r + 1]]))
        elif count:
            own = words.hash[words.bounds[r] : words.bounds[r + 1]]
            out.append(kit.mix(np.array([(own * kit.odd_constants(13 + count, count)).sum(dtype=kit.U64)], dtype=kit.U64)))
        else:
            out.append(np.zeros(0, dtype=kit.U64))
    return out


def parity(own: np.ndarray) -> bytes:
    """A bitmap of two bits a shingle or more (a power of two): which places an odd number of shingles falls in."""
    size = max(8 * FOLDED, 1 << int(2 * len(own) - 1).bit_length())
    odd = np.bincount((own & kit.U64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def _shard(tokens: np.ndarray, shards: int) -> np.ndarray:
    return ((tokens >> kit.U64(32)) * kit.U64(shards) >> kit.U64(32)).astype(np.int64)


def _blocks(shard: np.ndarray, arrays: list[np.ndarray]) -> Iterator[tuple[int, list[bytes]]]:
    order = np.argsort(shard, kind="stable")
    ranked = shard[order]
    cuts = np.flatnonzero(np.diff(ranked)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ranked)], strict=True):
        if hi > lo:
            yield int(ranked[lo]), [a[order[lo:hi]].tobytes() for a in arrays]


def _counted(shards: int):
    """Blocks of the first half of each set in hash order, for the list of frequent shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in kit.text_steps(batch, 1):
                firsts = [s[: 2 * (len(s) - need(len(s)) + 1)] for s in sets_of(data, offsets) if len(s)]
                if firsts:
                    tokens = np.concatenate(firsts)
                    rows = list(_blocks(_shard(tokens, shards), [tokens.astype(np.uint32)]))
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], type=pa.int32()), kit.binaries([b[0] for _, b in rows])], names=["shard", "tokens"])

    return run


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [np.frombuffer(b, dtype=np.uint32).astype(kit.U64) | kit.U64(k) << kit.U64(32) for batch in batches for k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
    if parts:
        found, counts = np.unique(np.concatenate(parts), return_counts=True)
        often = counts >= HOT_LEAST
        yield pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(counts[often])], names=["token", "n"])


def _most_frequent(counted: DataFrame) -> np.ndarray:
    """The shingles of all counts down to the least that keeps the list within HOT_MAX."""
    sizes = counted.groupBy(F.floor(F.log2("n") * 4).alias("size")).agg(F.count("*").alias("shingles"), F.min("n").alias("least")).orderBy(F.desc("size")).collect()
    room, least = HOT_MAX, 1 << 62
    for s in sizes:
        room -= s.shingles
        if room < 0:
            break
        least = s.least
    return np.sort(counted.where(F.col("n") >= least).select("token").toArrow()["token"].to_numpy().view(kit.U64))


def _prefixes(data, offsets, ids: np.ndarray, shards: int, hot: np.ndarray):
    """For each row: id, size, group, prefix and parity bitmap."""
    for doc, s in zip(ids.tolist(), sets_of(data, offsets), strict=True):
        n = len(s)
        if not n:
            yield doc, 0, 0, s, b""
            continue
        k = n - need(n) + 1
        if len(hot):
            key = _shard(s, shards).astype(kit.U64) << kit.U64(32) | s & kit.U64(0xFFFFFFFF)
            at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
            late = hot[at] == key
            first = np.concatenate([s[~late][:k], s[late][: max(0, k - int((~late).sum()))]])
        else:
            first = s[:k]
        group = kit.mix(np.array([(kit.mix(first + kit.U64(n))).sum(dtype=kit.U64)], dtype=kit.U64)).view(np.int64)[0]
        yield doc, n, int(group), first, parity(s)


def _signed(shards: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in kit.text_steps(batch, 1):
                rows = list(_prefixes(data, offsets, ids[lo:hi], shards, shared.value))
                yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], type=pa.int64()) for i in range(3)), kit.binaries([r[4] for r in rows]), kit.binaries([r[3].tobytes() for r in rows])], names=["doc", "n", "g", "bits", "first"])

    return run


def _listed(shards: int):
    """Rows (g, prefix) to blocks (shard, tokens, groups); a group's prefix once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {g: np.frombuffer(first, dtype=kit.U64) for g, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)}
            if seen:
                tokens = np.concatenate(list(seen.values()))
                groups = np.repeat(np.fromiter(seen, dtype=np.int64, count=len(seen)), [len(x) for x in seen.values()])
                rows = list(_blocks(_shard(tokens, shards), [tokens.astype(np.uint32), groups]))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], type=pa.int32()), kit.binaries([b[0] for _, b in rows]), kit.binaries([b[1] for _, b in rows])], names=["shard", "tokens", "groups"])

    return run


def _live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(list, g, df, times) of the shingles that more than one group has in its prefix.

    A list is named by a hash of its groups, so shingles with the same groups are one list, met ``times`` times. Two
    lists that share a name become one with the groups of both, which names more candidates and loses none.
    """
    tokens, groups = [], []
    for batch in batches:
        for k, t, g in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            tokens.append(np.frombuffer(t, dtype=np.uint32).astype(kit.U64) | kit.U64(k) << kit.U64(32))
            groups.append(np.frombuffer(g, dtype=np.int64))
    if not tokens:
        return
    token, group = np.concatenate(tokens), np.concatenate(groups)
    del tokens, groups
    order = np.lexsort((group, token))
    token, group = token[order], group[order]
    new = np.ones(len(token), dtype=bool)
    new[1:] = (token[1:] != token[:-1]) | (group[1:] != group[:-1])
    token, group = token[new], group[new]
    same = token[1:] == token[:-1]
    more = np.zeros(len(token), dtype=bool)
    more[1:] |= same
    more[:-1] |= same
    token, group = token[more], group[more]
    if not len(token):
        return
    edges = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    sizes = np.diff(np.append(edges, len(token)))
    name = kit.mix(np.add.reduceat(kit.mix(group.view(kit.U64)), edges) + sizes.astype(kit.U64))
    _, first, times = np.unique(name, return_index=True, return_counts=True)
    pick = np.repeat(edges[first] - np.concatenate([[0], np.cumsum(sizes[first])[:-1]]), sizes[first]) + np.arange(sizes[first].sum())
    columns = (np.repeat(name[first].view(np.int64), sizes[first]), group[pick], np.repeat(sizes[first], sizes[first]), np.repeat(times, sizes[first]))
    for lo in range(0, len(pick), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + 100_000]) for x in columns], names=["list", "g", "df", "times"])


class Cell:
    """Some nodes of a list: those that ask (role 1 and 2) are held against those that are held (role 0 and 2)."""

    def __init__(self, rows: list[tuple]):
        self.role, self.g, self.doc, self.n, self.comp = (np.array([r[i] for r in rows], dtype=np.int64) for i in (1, 2, 3, 4, 5))
        self.bits = [np.frombuffer(r[6], dtype=np.uint8) for r in rows]
        self.refuted = [r[7] or () for r in rows]
        self.any_refuted = any(len(x) for x in self.refuted)
        self.place: dict[int, list[int]] = {}
        for i, d in enumerate(self.doc.tolist()):
            self.place.setdefault(d, []).append(i)
        held = np.flatnonzero(self.role != 1)
        size = np.array([len(b) for b in self.bits])
        #: held nodes by the size of their bitmaps
        self.held = {int(s): held[size[held] == s] for s in np.unique(size[held])}
        self.matrix = {s: np.stack([self.bits[i] for i in at.tolist()]) for s, at in self.held.items()}

    def partners(self, i: int, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Held nodes that node i may link with and is not joined to, and how far apart they are at least."""
        own, at, far = self.bits[i], [], []
        for size in (len(own) // 2, len(own), 2 * len(own)):
            held = self.held.get(size)
            if held is None:
                continue
            # groups first: all members of a group have its size
            groups, back = np.unique(self.n[held], return_inverse=True)
            fits = 4 * np.minimum(groups, self.n[i]) >= 3 * np.maximum(groups, self.n[i])
            pick = np.flatnonzero(fits[back] & (root[self.comp[held]] != root[self.comp[i]]))
            if not len(pick):
                continue
            theirs = self.matrix[size][pick]
            mine = own.reshape(-1, min(size, len(own)))
            theirs = theirs.reshape(len(pick), -1, min(size, len(own)))
            apart = np.bitwise_count(np.bitwise_xor.reduce(theirs, axis=1) ^ np.bitwise_xor.reduce(mine, axis=0)).sum(axis=1, dtype=np.int64)
            near = 7 * apart <= self.n[held[pick]] + self.n[i]
            at.append(held[pick[near]])
            far.append(apart[near] / (self.n[held[pick[near]]] + self.n[i]))
        if not at:
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        found, far = np.concatenate(at), np.concatenate(far)
        if not self.any_refuted:
            return found, far
        known = {p for d in self.refuted[i] for p in self.place.get(d, ())}
        ok = np.array([j not in known for j in found.tolist()], dtype=bool)
        return found[ok], far[ok]

    def pairs(self, quota: int) -> tuple[list[tuple[int, int]], bool]:
        """Pairs to verify, and whether there are others, which matter if one of these does not link.

        For each asking node the nearest partner in every component that no pair named so far would join it to; and
        quota - 1 of its other nearest partners, so that not much is left to ask if a pair fails.
        """
        names, self.comp = np.unique(self.comp, return_inverse=True)
        apart, root = np.arange(len(names)), np.arange(len(names))
        out, more = [], False
        for i in np.flatnonzero(self.role != 0).tolist():
            found, far = self.partners(i, apart)
            own = found[np.lexsort((self.doc[found], far))]
            named: list[int] = []
            while len(other := own[root[self.comp[own]] != root[self.comp[i]]]):
                named.append(int(other[0]))
                root[root == root[self.comp[other[0]]]] = root[self.comp[i]]
            named += own[~np.isin(own, named)][: quota - 1].tolist()
            out += [(int(self.doc[i]), int(self.doc[j])) for j in named]
            more |= len(named) < len(own)
        return out, more


def folded(column: pa.Array) -> np.ndarray:
    """Bitmaps of any size as rows of FOLDED bytes: places that fall together cancel as parity does."""
    sizes = np.array(pc.binary_length(column))
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    data = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8)
    out = np.empty((len(sizes), FOLDED), dtype=np.uint8)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        out[at] = np.bitwise_xor.reduce(data[begins[at][:, None] + np.arange(size)].reshape(len(at), -1, FOLDED), axis=1)
    return out


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.view(kit.U64) ^ b.view(kit.U64)).sum(axis=1, dtype=np.int64)


def _worth_a_look(cell: np.ndarray, n: np.ndarray, comp: np.ndarray, bits: np.ndarray) -> Iterator[tuple[int, int]]:
    """(begin, end) of the cells in which a pair may link: all pairs of small cells are looked at together."""
    begins = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    sizes = np.diff(np.append(begins, len(cell)))
    look = sizes > SMALL
    for size in range(2, SMALL + 1):
        own = np.flatnonzero(sizes == size)
        left, right = np.triu_indices(size, 1)
        for lo in range(0, len(own), max(1, 200_000 // len(left))):
            some = own[lo : lo + max(1, 200_000 // len(left))]
            i, j = ((begins[some][:, None] + x).ravel() for x in (left, right))
            of = np.repeat(some, len(left))
            fits = (comp[i] != comp[j]) & (4 * np.minimum(n[i], n[j]) >= 3 * np.maximum(n[i], n[j]))
            i, j, of = i[fits], j[fits], of[fits]
            look[of[7 * _apart(bits[i], bits[j]) <= n[i] + n[j]]] = True
    for k in np.flatnonzero(look).tolist():
        yield int(begins[k]), int(begins[k] + sizes[k])


def _celled(quota: int):
    """Rows (cell, role, g, doc, n, component, bits, refuted, list), sorted by cell, to (list, a, b, more) to be verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            columns = [c.chunk(0) for c in rows.columns]
            cell, n, comp = (columns[i].to_numpy(zero_copy_only=False) for i in (0, 4, 5))
            out = []
            for lo, hi in _worth_a_look(cell, n, comp, folded(columns[6])):
                part = rows.slice(lo, hi - lo)
                name = part.column(8)[0].as_py()
                found, more = Cell(list(zip(*(c.to_pylist() for c in part.columns), strict=True))).pairs(quota)
                out += [(name, *p, more) for p in found]
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], type=pa.int64() if i < 3 else pa.bool_()) for i in range(4)], names=["list", "a", "b", "more"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column(0).to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(cell, cell[-1]))
            if cut:
                yield judged(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif held and held[-1].column(0)[0].as_py() != cell[0]:
                yield judged(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield judged(pa.Table.from_batches(held))

    return run


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Those of the pairs (a, b, na, nb, bits of a, bits of b) whose bitmaps leave room for a link."""
    for batch in batches:
        na, nb = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
        ok = 4 * np.minimum(na, nb) >= 3 * np.maximum(na, nb)
        if batch.num_rows:
            ok &= 7 * _apart(folded(batch.column(4)), folded(batch.column(5))) <= na + nb
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in batch.columns[:2]], names=["a", "b"])


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, doc, keys) to a row (key, salt, role, doc, packed text) for each key."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        docs, keys = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for lo, hi, data, offsets in kit.text_steps(batch, 0):
            rows, size = [], 0
            for r, (x, y) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True), lo):
                blob = pack(data[x:y].tobytes())
                for k in keys[r]:
                    rows.append((k["key"], k["salt"], k["role"], docs[r], blob))
                    size += len(blob)
                    if size > 4 * kit.STEP_BYTES:
                        yield _message_batch(rows)
                        rows, size = [], 0
            if rows:
                yield _message_batch(rows)


def _message_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(kinds)], names=["key", "salt", "role", "doc", "blob"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages sorted by key, salt, role: a pivot's text comes first, then the texts that are held against it."""
    pivots: list[np.ndarray] = []
    at = None
    unpack = zstandard.ZstdDecompressor().decompress

    def judge(rows: list[tuple], texts: list[bytes]) -> pa.RecordBatch:
        nonlocal at, pivots
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        a, b = [], []
        for (key, salt, role, doc), own in zip(rows, sets_of(np.frombuffer(b"".join(texts), dtype=np.uint8), offsets), strict=True):
            if (key, salt) != at:
                at, pivots = (key, salt), []
            if role == 0:
                pivots.append(own)
                continue
            for other in pivots:
                both = np.concatenate([own, other])
                both.sort()
                if 7 * int((both[1:] == both[:-1]).sum()) >= 3 * (len(own) + len(other)):
                    a.append(key)
                    b.append(doc)
                    break
        return pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], names=["a", "b"])

    for batch in batches:
        rows, texts, size = [], [], 0
        for *row, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.append(tuple(row))
            texts.append(unpack(blob))
            size += len(texts[-1])
            if size >= VERIFY_BYTES:
                yield judge(rows, texts)
                rows, texts, size = [], [], 0
        if rows:
            yield judge(rows, texts)


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose texts link. texts: doc, text."""
    fans = pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).cast("int").alias("fan"))
    first = fans.select(F.col("a").alias("doc"), F.col("a").alias("key"), F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("salt"), F.lit(0).alias("role"))
    rest = pairs.join(fans, "a").select(F.col("b").alias("doc"), F.col("a").alias("key"), F.pmod(F.hash("b"), F.col("fan")).alias("salt"), F.lit(1).alias("role"))
    asked = first.union(rest).groupBy("doc").agg(F.collect_list(F.struct("key", "salt", "role")).alias("keys"))
    if pairs.count() <= FEW:  # then the texts need not be shuffled to be found
        asked = F.broadcast(asked)
    sets = texts.join(asked, "doc").select("text", "doc", "keys").transform(kit.through, _messages, "key long, salt int, role int, doc long, blob binary")
    n = kit.parts_for(texts, 32 << 20)
    return sets.repartition(n, "key", "salt").sortWithinPartitions("key", "salt", "role").transform(kit.through, _verified, "a long, b long")


def _cells(lists: DataFrame, placed: DataFrame, refuted: DataFrame | None, again: DataFrame | None) -> DataFrame:
    """The rows of all cells of lists that hold several components. lists: list, g; placed: g, doc, n, bits, component.

    again: the lists that a round has to look at; all if None.
    """
    spans = placed.groupBy("g").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("nodes"))
    own = spans.where("nodes > 1 and x < y").select(F.col("g").alias("list"), "g")
    if again is not None:
        lists, own = (x.join(again, "list", "left_semi") for x in (lists, own))
    torn = lists.join(spans, "g").groupBy("list").agg(F.min("x").alias("x"), F.max("y").alias("y")).where("x < y").select("list")
    wanted = lists.join(torn, "list").select("list", "g").union(own)
    mass = wanted.join(placed.groupBy("g", "component").agg(F.sum("n").alias("m")), "g").groupBy("list", "component").agg(F.sum("m").alias("m"))
    # the component that most of a list is in asks nothing
    whole = mass.groupBy("list").agg(F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("all"))
    cells = lambda m: F.ceil(m / CELL_SHINGLES).cast("int")
    whole = whole.select("list", F.col("top.component").alias("main"), cells(F.col("all")).alias("k"), F.greatest(cells(F.col("all") - F.col("top.m")), F.lit(1)).alias("b"))
    given = placed if refuted is None else placed.join(refuted, "doc", "left")
    given = given.select("g", "doc", "n", "bits", "component", F.lit(None).cast("array<long>").alias("refuted") if refuted is None else "refuted")
    rows = wanted.join(whole, "list").join(given, "g")
    block, chunk = F.pmod(F.xxhash64(F.lit(1), "doc"), F.col("b")).cast("int"), F.pmod(F.xxhash64(F.lit(2), "doc"), F.col("k")).cast("int")
    at = lambda b, k, role: F.struct(b.alias("b"), k.alias("k"), F.lit(role).alias("role"))
    held = F.transform(F.sequence(F.lit(0), F.col("b") - 1), lambda b: at(b, chunk, 0))
    asks = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda k: at(block, k, 1))
    both = F.when(F.col("component") == F.col("main"), held).when((F.col("b") == 1) & (F.col("k") == 1), F.array(at(F.lit(0), F.lit(0), 2))).otherwise(F.concat(held, asks))
    rows = rows.select("list", "g", "doc", "n", "component", "bits", "refuted", F.explode(both).alias("at"))
    return rows.select(F.xxhash64("list", "at.b", "at.k").alias("cell"), F.col("at.role").alias("role"), "g", "doc", "n", "component", "bits", "refuted", "list")


def link(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n, component) for each row of df."""
    spark = df.sparkSession
    scratch = kit.Scratch(spark, "ngram-join")
    rows = df.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = rows.select("doc", *kit.digests(F.col("text")))
    copies = scratch.cut(keyed.where("doc is not null").groupBy("h1", "h2").agg(F.min("doc").alias("node")), "copies")
    # the merge keeps small inputs on the plan that large ones take
    texts = scratch.cut(rows.join(copies.select("node").distinct().hint("merge"), F.col("doc") == F.col("node"), "left_semi"), "texts")

    shards = kit.parts_for(df, SHARD_BYTES)
    counted = texts.transform(kit.through, _counted(shards), "shard int, tokens binary").repartition(shards, "shard").transform(kit.through, _frequent, "token long, n long")
    hot = _most_frequent(scratch.cut(counted, "counted"))
    scratch.drop("counted")
    shared = spark.sparkContext.broadcast(hot)

    signed = scratch.cut(texts.transform(kit.through, _signed(shards, shared), "doc long, n long, g long, bits binary, first binary"), "signed")
    nodes = scratch.cut(signed.drop("first"), "nodes")
    lists = signed.where("n > 0").select("g", "first").transform(kit.through, _listed(shards), "shard int, tokens binary, groups binary").repartition(shards, "shard")
    live = lists.transform(kit.through, _live, "list long, g long, df long, times long").groupBy("list", "g").agg(F.max("df").alias("df"), F.sum("times").alias("times"))
    live = scratch.cut(live, "live")
    scratch.drop("signed")

    # first pass: one leader for each group, the group's first member for each member
    members = nodes.where("n > 0")
    firsts = members.groupBy("g").agg(F.min("doc").alias("first"))
    central = live.groupBy("g").agg(F.sum(F.col("df") * F.col("times")).alias("score"))
    scored = live.select("list", "g", "times").join(central, "g")
    led = scored.join(scored.groupBy("list").agg(F.max(F.struct("score", "g")).alias("top")), "list").select("g", "times", F.col("top.g").alias("lead")).where("g <> lead").groupBy("g", "lead").agg(F.sum("times").alias("count"))
    led = led.groupBy("g").agg(F.max_by("lead", F.struct("count", "lead")).alias("lead"))
    outer = led.join(firsts, "g").select("lead", F.col("first").alias("b")).join(firsts.withColumnRenamed("g", "lead"), "lead").select(F.col("first").alias("a"), "b")
    inner = members.join(firsts, "g").where("doc <> first").select(F.col("first").alias("a"), F.col("doc").alias("b"))
    sized = nodes.select("doc", "n", "bits")
    both = outer.union(inner).join(sized.toDF("a", "na", "bits_a"), "a").join(sized.toDF("b", "nb", "bits_b"), "b").select("a", "b", "na", "nb", "bits_a", "bits_b")
    edges = verify(scratch.cut(both.transform(kit.through, _near, "a long, b long"), "pairs"), texts)
    found = scratch.cut(kit.components(edges, scratch, "cc0"), "found0")
    scratch.drop("pairs")

    k, seen, refuted, again = 0, None, None, None
    while True:
        placed = members.join(found, members.doc == found.id, "left").select("g", "doc", "n", "bits", F.coalesce("component", "doc").alias("component"))
        placed = scratch.cut(placed, f"placed{k}")
        cells = _cells(live.select("list", "g"), placed, refuted, again)
        named = cells.repartition(kit.parts_for(df, 4 * SHARD_BYTES), "cell").sortWithinPartitions("cell").transform(kit.through, _celled(MORE ** (k + 1)), "list long, a long, b long, more boolean")
        named = scratch.cut(named.select("list", "more", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), f"pairs{k}")
        pairs = named.select("a", "b").distinct()
        if named.isEmpty():
            scratch.drop(f"placed{k}", f"pairs{k}")
            break
        late = scratch.cut(verify(pairs, texts), f"late{k}")
        failed = pairs.join(late, ["a", "b"], "left_anti")
        failed = failed.union(failed.select("b", "a"))
        seen = scratch.cut(failed if seen is None else seen.union(failed), f"refuted{k}")
        # where every pair that was named links, the pairs that were not named are linked by those
        again = scratch.cut(named.where("more").join(seen.toDF("a", "b"), ["a", "b"], "left_semi").select("list").distinct(), f"again{k}")
        refuted = seen.groupBy(F.col("a").alias("doc")).agg(F.collect_set("b").alias("refuted"))
        # links between components join their names
        name = placed.select("doc", "component")
        between = late.join(name.toDF("a", "x"), "a").join(name.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        joined = kit.components(between, scratch, f"cc{k + 1}").select(F.col("id").alias("component"), F.col("component").alias("to"))
        found = scratch.cut(name.join(joined, "component", "left").select(F.col("doc").alias("id"), F.coalesce("to", "component").alias("component")), f"found{k + 1}")
        scratch.drop(f"placed{k}", f"pairs{k}", f"late{k}")
        k += 1
        if again.isEmpty():
            break
    scratch.drop("texts", "live")

    whole = nodes.groupBy("doc").agg(F.max("n").alias("n")).join(found, F.col("doc") == F.col("id"), "left").select(F.col("doc").alias("node"), "n", F.coalesce("component", "doc").alias("component"))
    named = keyed.where("doc is not null").join(copies, ["h1", "h2"], "left").join(whole, "node", "left")
    named = named.select("doc", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc")).alias("component"))
    lone = rows.where("doc is null").select("text").transform(kit.through, _set_sizes, "n long")
    return named.unionByName(lone.select(F.lit(None).cast("long").alias("doc"), "n", F.lit(None).cast("long").alias("component")))


def _set_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of distinct shingles of each text."""
    for batch in batches:
        for _, _, data, offsets in kit.text_steps(batch):
            words = kit.Words(data, offsets)
            found, at = kit.windows(words, WORDS)
            cuts = np.searchsorted(at, words.bounds)
            sizes = [len(np.unique(found[a:b])) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.where(np.array(sizes, dtype=np.int64) > 0, sizes, np.diff(words.bounds) > 0).astype(np.int64))], names=["n"])


def query(spark, sf_dir: str) -> DataFrame:
    found = link(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays, the one with the least doc_id (null last); rows without shingles all stay.

    Where doc_ids repeat or are null, rows are told apart by a number of their own, so that of repeated rows one stays.
    """
    counts = docs.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids")).first()
    if counts.n == counts.ids:
        found = link(docs).where("doc <> component").select(F.col("doc").alias("doc_id"))
        return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
    scratch = kit.Scratch(spark, "ngram-join-rows")
    mark = kit.unused("row", docs)
    rows = scratch.cut(docs.withColumn(mark, F.monotonically_increasing_id()), "rows")
    linked = link(rows.select(F.col(mark).alias("doc_id"), "text")).where("n > 0")
    named = rows.select(F.col(mark).alias("row"), F.col("doc_id").alias("id")).join(linked, F.col("row") == F.col("doc"))
    best = named.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))).alias("best")).select(F.col("best.row").alias("row"))
    gone = named.select("row").join(best, "row", "left_anti").withColumnRenamed("row", mark)
    return rows.join(gone, mark, "left_anti").select(*docs.columns)
