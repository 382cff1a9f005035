"""Line deduplication by pairwise alignment: later documents lose the blocks they share with earlier ones.

A document is its lines with a word. From each line a seed begins: so many lines as hold MIN_WORDS words, mostly one;
seeds that stand twice in a document don't count. Documents that hold the same seed overlap.

1. Rare seeds, held by RARE documents at most, name pairs: a document and the earliest holder of each.
2. A pair is aligned over all lines, as patience diff does: equal lines at both ends, then lines that stand once on
   either side, as many as are in order in both, and the same again between them; where no line stands once, the
   longest common blocks. Aligned runs of MIN_WORDS words or more go from the later document, with the blank lines
   inside them.
3. Seeds that stay name pairs in further turns: frequent ones with their earliest holder, all with the next earlier
   holder after the one that did not do, until none stays that has another earlier holder.

So every seed is looked up however common it is, and a frequent one costs pairs only where rare ones did not find its
block. The earliest and the next holder are grouped minimums; a document's pairs stream through a task one at a time.
There are no caps.

Defined cases: earlier means a smaller doc_id (null last), then a smaller text digest; rows equal in both are one
document, so exact repetitions of a row stay as they are. A null text has no lines and stays null; a document with
less than MIN_WORDS words is left alone. Lines end at ``\\n`` and are compared byte by byte. Other columns are kept,
whatever their names; those named like an output are replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldlog.llm import kit

MIN_WORDS = 5
#: Seeds that so many documents hold at most are rare.
RARE = 64
_NO_ID = (1 << 63) - 1
_SPANS = "array<struct<a:int,b:int>>"
_KINDS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


# ---------------------------------------------------------------- lines and seeds

def worded(text: str) -> tuple[list[str], list[int], list[int]]:
    """All lines; which of them have words; how many each of those has."""
    lines = text.split("\n")
    counts = [len(line.encode().split()) for line in lines]
    return lines, [i for i, n in enumerate(counts) if n], [n for n in counts if n]


def _profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, mark, text) to (doc, mark, digests of the lines, their words)."""
    digest = xxhash.xxh3_128_digest
    for batch in batches:
        for lo, hi, _, _ in kit.text_steps(batch, 2):
            lines, words = [], []
            for text in batch.column(2)[lo:hi].to_pylist():
                every, at, counts = worded(text)
                lines.append(b"".join(digest(every[i]) for i in at))
                words.append(np.minimum(counts, 65535).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], kit.binaries(lines), kit.binaries(words)], names=["doc", "mark", "lines", "words"])


def seeds_of(digests: np.ndarray, words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document, first line (from its own), lines, and both hash halves of the seeds of several documents.

    digests: two columns for all lines of all; ends: where each document's lines end.
    """
    n = len(words)
    doc = np.searchsorted(ends, np.arange(n), side="right")
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    last = np.searchsorted(total[1:], total[:-1] + MIN_WORDS)
    first = np.flatnonzero(last < ends[doc])
    size = last[first] - first + 1
    hashes = digests[first].copy()
    several = np.flatnonzero(size > 1)
    for half in (0, 1):
        mixed = np.zeros(len(several), dtype=kit.U64)
        for t, c in enumerate(kit.odd_constants(31 + half, MIN_WORDS).tolist()):  # each line has a word at least
            there = size[several] > t
            mixed[there] += kit.mix(digests[first[several[there]] + t, half]) * kit.U64(c)
        hashes[several, half] = kit.mix(mixed)
    doc = doc[first]
    order = np.lexsort((hashes[:, 1], hashes[:, 0], doc))
    same = (doc[order][1:] == doc[order][:-1]) & (hashes[order][1:] == hashes[order][:-1]).all(axis=1)
    once = np.ones(len(first), dtype=bool)
    once[order[1:][same]] = False
    once[order[:-1][same]] = False
    begins = np.concatenate([[0], ends[:-1]])
    return doc[once], (first - begins[doc])[once], size[once], hashes[once, 0], hashes[once, 1]


def _seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines, words = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        ends = np.cumsum([len(w) // 2 for w in words], dtype=np.int64)
        if not len(ends) or not ends[-1]:
            continue
        doc, k, size, h1, h2 = seeds_of(np.frombuffer(b"".join(lines), dtype="<u8").reshape(-1, 2), np.frombuffer(b"".join(words), dtype="<u2"), ends)
        ids = [batch.column(i).to_numpy(zero_copy_only=False)[doc] for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, ids), pa.array(k, type=pa.int32()), pa.array(size, type=pa.int32()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], names=["doc", "mark", "k", "size", "h1", "h2"])


# ---------------------------------------------------------------- alignment

def increasing(values: list[int]) -> list[int]:
    """Where a longest strictly increasing subsequence stands."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        j = bisect_left(tails, v)
        back[i] = ends[j - 1] if j else -1
        tails[j:j + 1] = [v]
        ends[j:j + 1] = [i]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Places of equal lines, in order in both: a patience diff."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            found.append((m, n))
        if i == m or j == n:
            continue
        here, there = Counter(a[i:m]), Counter(b[j:n])
        place = {x: k for k, x in enumerate(b[j:n], j) if there[x] == 1}
        once = [(k, place[x]) for k, x in enumerate(a[i:m], i) if here[x] == 1 and x in place]
        if once:
            anchors = [once[k] for k in increasing([y for _, y in once])]
            found += anchors
            for (p, q), (r, s) in zip([(i - 1, j - 1), *anchors], [*anchors, (m, n)], strict=True):
                todo.append((p + 1, r, q + 1, s))
        elif here.keys() & there.keys():
            for p, q, size in SequenceMatcher(None, a[i:m], b[j:n], autojunk=False).get_matching_blocks():
                found += [(i + p + t, j + q + t) for t in range(size)]
    return sorted(found)


def blocks(found: list[tuple[int, int]], words: list[int]) -> list[tuple[int, int]]:
    """(first, end) of the aligned runs that are long enough to go."""
    out, start = [], 0
    for k in range(1, len(found) + 1):
        if k == len(found) or found[k] != (found[k - 1][0] + 1, found[k - 1][1] + 1):
            first, end = found[start][0], found[k - 1][0] + 1
            if sum(words[first:end]) >= MIN_WORDS:
                out.append((first, end))
            start = k
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cut(lines: bytes) -> list[bytes]:
    return [lines[k : k + 16] for k in range(0, len(lines), 16)]


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's own row, then its partners' one by one, to (doc, mark, spans, partners)."""
    own = None
    out: list[tuple] = []

    def given() -> pa.RecordBatch:
        rows = [(d, m, [{"a": a, "b": b} for a, b in merged(s)], p) for d, m, _, _, s, p in out]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate((pa.int64(), pa.int64(), _KINDS, pa.int32()))], names=["doc", "mark", "spans", "partners"])

    for batch in batches:
        for doc, mark, edoc, lines, words, spans, partners in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5, 6, 7)), strict=True):
            if edoc is None:
                if own is not None:
                    out.append(tuple(own))
                own = [doc, mark, _cut(lines), np.frombuffer(words, dtype="<u2").tolist(), [(s["a"], s["b"]) for s in spans or ()], partners or 0]
                continue
            gone = blocks(align(own[2], _cut(lines)), own[3])
            own[4] += gone
            own[5] += bool(gone)
        if out:
            yield given()
    if own is not None:
        out.append(tuple(own))
        yield given()


def shorten(text: str, spans: list[tuple[int, int]]) -> tuple[str, int, int]:
    """The text without the lines of spans (counted over lines with words), its lines, and how many went."""
    lines, at, _ = worded(text)
    gone: set[int] = set()
    for a, b in spans:
        # blank lines inside a block go with it, and those before the first or after the last line of all
        gone.update(range(at[a] if a else 0, at[b - 1] + 1 if b < len(at) else len(lines)))
    return "\n".join(line for i, line in enumerate(lines) if i not in gone), len(lines), len(gone)


OUT = T.StructType([T.StructField("deduped", T.StringType())] + [T.StructField(n, T.LongType()) for n in ("n_lines", "n_removed_lines", "n_partners")])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text, spans, partners) to row, text and OUT."""
    for batch in batches:
        for lo, hi, _, _ in kit.text_steps(batch, 1):
            part = batch.slice(lo, hi - lo)
            rows = []
            for text, spans, partners in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if text is None:
                    rows.append((None, 0, 0, 0))
                elif not spans:
                    rows.append((text, text.count("\n") + 1, 0, 0))
                else:
                    rows.append((*shorten(text, [(s["a"], s["b"]) for s in spans]), partners))
            made = [pa.array([r[i] for r in rows], type=pa.int64() if i else pa.string()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], names=["row", "text", *OUT.fieldNames()])


# ---------------------------------------------------------------- all documents

def _pair(doc: str, mark: str) -> Column:
    return F.struct(F.col(doc), F.col(mark))


def _next_holders(left: DataFrame, seeds: DataFrame) -> DataFrame:
    """left with the next earlier holder of each seed in the place of its last; rows without one go."""
    asked = left.select("h1", "h2", "edoc", "emark").distinct()
    held = asked.join(seeds.select("h1", "h2", F.col("doc").alias("sdoc"), F.col("mark").alias("smark")), ["h1", "h2"]).where(_pair("sdoc", "smark") > _pair("edoc", "emark"))
    following = held.groupBy("h1", "h2", "edoc", "emark").agg(F.min(F.struct("sdoc", "smark")).alias("s"))
    found = left.join(following, ["h1", "h2", "edoc", "emark"]).where(F.col("s") < _pair("doc", "mark"))
    return found.select("doc", "mark", "k", "size", "h1", "h2", F.col("s.sdoc").alias("edoc"), F.col("s.smark").alias("emark"))


def _turn(pairs: DataFrame, profiles: DataFrame, before: DataFrame | None) -> DataFrame:
    """(doc, mark, spans, partners) of the documents of pairs, with what they had before."""
    pairs = pairs.select("doc", "mark", "edoc", "emark").distinct()
    own = profiles.join(pairs.select("doc", "mark").distinct(), ["doc", "mark"])
    own = own.withColumn("spans", F.lit(None).cast(_SPANS)).withColumn("partners", F.lit(None).cast("int")) if before is None else own.join(before, ["doc", "mark"], "left")
    none = F.lit(None).cast("long")
    own = own.select("doc", "mark", none.alias("edoc"), none.alias("emark"), "lines", "words", "spans", "partners")
    theirs = pairs.join(profiles.withColumnsRenamed({"doc": "edoc", "mark": "emark"}), ["edoc", "emark"])
    theirs = theirs.select("doc", "mark", "edoc", "emark", "lines", "words", F.lit(None).cast(_SPANS).alias("spans"), F.lit(None).cast("int").alias("partners"))
    n = kit.parts_for(profiles, 8 << 20)
    ready = own.union(theirs).repartition(n, "doc", "mark").sortWithinPartitions("doc", "mark", "edoc", "emark")
    return ready.transform(kit.through, _aligned, f"doc long, mark long, spans {_SPANS}, partners int")


def _uncovered(links: DataFrame, state: DataFrame) -> DataFrame:
    covered = F.exists("spans", lambda s: (s["a"] <= F.col("k")) & (s["b"] >= F.col("k") + F.col("size")))
    return links.join(state, ["doc", "mark"], "left").where(F.col("spans").isNull() | ~covered).select(*links.columns)


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with ``deduped`` (the text that stays), ``n_lines``, ``n_removed_lines`` and ``n_partners``."""
    scratch = kit.Scratch(df.sparkSession, "line-dedup")
    doc, mark, text = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)), F.xxhash64(text_col), F.col(text_col)
    profiles = df.where(text.isNotNull()).select(doc.alias("doc"), mark.alias("mark"), text.alias("text")).transform(kit.through, _profiled, "doc long, mark long, lines binary, words binary")
    profiles = scratch.cut(profiles.dropDuplicates(["doc", "mark"]), "profiles")
    seeds = scratch.cut(profiles.transform(kit.through, _seed_rows, "doc long, mark long, k int, size int, h1 long, h2 long"), "seeds")
    holder = seeds.groupBy("h1", "h2").agg(F.min(_pair("doc", "mark")).alias("e"), F.count("*").alias("c")).where("c > 1")
    links = seeds.join(holder, ["h1", "h2"]).select("doc", "mark", "k", "size", "h1", "h2", F.col("e.doc").alias("edoc"), F.col("e.mark").alias("emark"), "c")
    links = scratch.cut(links.where("doc <> edoc or mark <> emark"), "links")

    state = scratch.cut(_turn(links.where(F.col("c") <= RARE), profiles, None), "turn0")
    left = scratch.cut(_uncovered(links, state), "left0")
    often = left.where(F.col("c") > RARE).drop("c")
    todo = scratch.cut(often.union(_next_holders(left.where(F.col("c") <= RARE).drop("c"), seeds)), "todo0")
    k = 0
    while not todo.isEmpty():
        k += 1
        moved = scratch.cut(_turn(todo, profiles, state), f"moved{k}")
        state = scratch.cut(state.join(moved, ["doc", "mark"], "left_anti").union(moved), f"turn{k}")
        todo = scratch.cut(_next_holders(_uncovered(todo, state), seeds), f"todo{k}")
        scratch.drop(f"turn{k - 1}", f"moved{k}", f"todo{k - 1}")
    scratch.drop("profiles", "seeds", "links", "left0", f"todo{k}")

    kept = [c for c in df.columns if c not in OUT.fieldNames()]
    rest = [c for c in kept if c != text_col]  # the text travels once
    given = df.select(kit.packed(df, rest), doc.alias("doc"), mark.alias("mark"), text.alias("text"))
    # the merge keeps small inputs on the plan that large ones take
    given = given.join(state.hint("merge"), ["doc", "mark"], "left").select("row", "text", "spans", "partners")
    found = given.transform(kit.through, _apply, T.StructType([given.schema["row"], given.schema["text"], *OUT.fields]))
    return found.select(*(F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in kept), *OUT.fieldNames())


def query(spark, sf_dir: str) -> DataFrame:
    found = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed_lines", "n_partners", F.length("deduped").cast("long").alias("n_chars_left"), F.sha2(F.encode("deduped", "UTF-8"), 256).alias("deduped_sha256"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks that earlier ones have; those of which no word is left go. n_chars follows, if there."""
    found = dedup(docs.select(kit.packed(docs, [c for c in docs.columns if c != "text"]).alias("whole"), "doc_id", "text")).where((F.col("n_removed_lines") == 0) | F.col("deduped").rlike(r"[^\x20\x09-\x0D]"))
    return kit.with_text(found, docs, F.col("deduped"))
