"""Removal of repeated passages: super-k-mers of words travel to the bucket of their minimiser and are sorted there.

A window is ``size`` consecutive words (``[^\\x20\\x09-\\x0D]+``, unchanged) of one text. Each word goes that a window covers
whose words also start in a document of a smaller id.

1. A window's minimiser is the run of CORE words in it of the least hash, the leftmost of equal ones. Consecutive windows with
   the same minimiser are a super-k-mer: one packed string of all their words (two bytes for each of the VOCABULARY words of
   a sample, the bytes of any other), sent once. Equal windows have equal minimisers, so they meet in one bucket.
2. A bucket ranks its words, then runs of 2, 4, 8 ... words by sorting pairs of ranks, and so counts windows exactly, and
   finds the least id of each. A super-k-mer gets back the least ids of its windows, which its documents compare with theirs.
3. Where the strings of a minimiser are more than GROUP_BYTES, its super-k-mers are cut into pieces of windows in which the
   minimiser stands at like places (REACH of them, then fewer). A piece's bucket is named by all words that its windows share, so a
   frequent phrase parts by what stands around it, down to the window itself. Nothing is left out at any level.

Strings are combined in each batch before they travel, so copies of one passage cost a row a batch. The sample (SAMPLE_BYTES) decides how words are
written, no result. Sent to all tasks: the vocabulary (65,000 hashes), names of large buckets (at most one for each
GROUP_BYTES of strings). Spans come back by id and text digest; joins may be split by the engine where a key is frequent.

Defined cases: a null or empty text has no words; a text of fewer words than a window keeps all. A row without an id is
smaller than none and loses nothing. Rows of one id never count against each other; equal rows get equal results. Extra
columns are kept, also by the operator's own names; those named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldlog.llm import kit

SIZE, CORE = 50, 5
VOCABULARY, SAMPLE_BYTES = 65_000, 64 << 20
OTHER = 0xFFFF
#: Windows of a piece at each level: all that share a minimiser, then fewer, at last one.
REACH = (SIZE - CORE + 1, 12, 4, 1)
GROUP_BYTES = 16 << 20
#: Bytes of strings that are ranked together, if no single bucket has more.
RANKED_BYTES = 4 << 20
OUT = ("n_words", "n_removed", "kept")
_TOP = np.iinfo(np.int64).max


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in kit.text_steps(batch):
            words = kit.Words(data, offsets, lower=False)
            _, first, count = np.unique(words.hash, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.hash[first].view(np.int64)), pa.array(count, type=pa.int64())], names=["word", "c"])


def vocabulary(texts: DataFrame) -> np.ndarray:
    """Hashes of the frequent words of a sample of the texts, sorted; a word's place is its code."""
    share = min(1.0, SAMPLE_BYTES / max(kit.input_bytes(texts), 1))
    sample = texts if share == 1 else texts.sample(share, 5)
    counts = sample.transform(kit.through, _counted, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))
    words = counts.orderBy(F.desc("c"), "word").limit(VOCABULARY).select("word").toPandas()["word"]
    return np.sort(words.to_numpy().astype(np.int64).view(kit.U64))


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """For each start, the place of the least of ``size`` values from there on, the leftmost of equal ones."""
    at, width = np.arange(len(values)), 1
    while width < size:
        step = min(width, size - width)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        width += step
    return at


class Pieces:
    """The super-k-mers, or pieces of them, of the texts of one step.

    first, end: their words; row: their text; key, digest: names of the bucket and, in it, of the string. large: for each
    level, the sorted keys of buckets that are to be split. At the last level that they name, only pieces of split buckets count, if only_last.
    """

    def __init__(self, words: kit.Words, size: int, large: list[np.ndarray], only_last: bool = False):
        n = len(words.starts) - size + 1
        start = np.flatnonzero(words.row[: max(n, 0)] == words.row[size - 1 :]) if n > 0 else np.zeros(0, dtype=np.int64)
        cores = np.full(len(words.starts), np.iinfo(np.uint64).max, dtype=kit.U64)
        found, at = kit.windows(words, CORE, seed=31)
        cores[at] = found
        place = _least(cores, size - CORE + 1)[start] if len(start) else start
        key = cores[place]
        level = np.zeros(len(start), dtype=np.int64)
        part = np.zeros(len(start), dtype=np.int64)
        sums = kit.sequence_sums(words.hash)
        for k, keys in enumerate(large, 1):
            open_ = np.flatnonzero((level == k - 1) & kit.among(key, keys))
            reach = min(REACH[k], size - CORE + 1)
            split = (place[open_] - start[open_]) // reach
            begin = place[open_] - split * reach
            shared = kit.sequence_hash(sums, begin, begin + size + 1 - reach)
            key[open_] = kit.mix(shared ^ ((split + 1) * 64 + k).astype(kit.U64))
            level[open_], part[open_] = k, split
        new = np.ones(len(start), dtype=bool)
        new[1:] = (np.diff(start) != 1) | (np.diff(place) != 0) | (np.diff(level) != 0) | (np.diff(part) != 0)
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(start)) - 1
        if only_last:
            last = level[heads] == len(large)
            heads, tails = heads[last], tails[last]
        self.first = start[heads]
        self.end = start[tails] + size if len(heads) else self.first
        self.row, self.key = words.row[self.first], key[heads]
        self.digest = kit.sequence_hash(sums, self.first, self.end)


class Packer:
    """Words as strings: two bytes each, then the bytes of those that have no code, each with a space."""

    def __init__(self, words: kit.Words, known: np.ndarray):
        at = np.minimum(np.searchsorted(known, words.hash), max(len(known) - 1, 0))
        there = known[at] == words.hash if len(known) else np.zeros(len(words.hash), dtype=bool)
        self.codes = np.where(there, at, OTHER).astype("<u2").tobytes()
        length = np.where(there, 0, words.ends - words.starts + 1)
        self.at = np.concatenate([[0], np.cumsum(length)])
        other = np.flatnonzero(~there)
        where = np.repeat(words.starts[other] - self.at[other], length[other]) + np.arange(self.at[-1])
        spelled = words.data[np.minimum(where, max(len(words.data) - 1, 0))]
        spelled[self.at[other + 1] - 1] = 32
        self.spelled = spelled.tobytes()

    def size(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return 2 * (end - first) + self.at[end] - self.at[first]

    def strings(self, first: np.ndarray, end: np.ndarray) -> list[bytes]:
        spans = zip((2 * first).tolist(), (2 * end).tolist(), self.at[first].tolist(), self.at[end].tolist(), strict=True)
        return [self.codes[a:b] + self.spelled[c:d] for a, b, c, d in spans]


MARKS = "doc long, text_digest long, key long, digest long, first int, windows int, bytes int"
STRINGS = "key long, digest long, windows int, least long, most long, string binary"


def _steps(batch: pa.RecordBatch) -> Iterator[tuple[kit.Words, np.ndarray, np.ndarray]]:
    """Words of texts with an id, these ids and text digests; columns: doc, text_digest, text."""
    for lo, hi, data, offsets in kit.text_steps(batch, 2):
        yield kit.Words(data, offsets, lower=False), *(batch.column(k)[lo:hi].to_numpy(zero_copy_only=False) for k in (0, 1))


def _once(key: np.ndarray, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each pair, and which pair each place has."""
    order = np.lexsort((digest, key))
    new = np.ones(len(key), dtype=bool)
    new[1:] = (np.diff(key[order]) != 0) | (np.diff(digest[order]) != 0)
    which = np.empty(len(key), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def _marks(size: int, known: np.ndarray, large: list[np.ndarray], only_last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, ids, digests in _steps(batch):
                p = Pieces(words, size, large, only_last)
                bytes_ = Packer(words, known).size(p.first, p.end)
                first, _ = _once(p.key, p.digest)
                once = np.zeros(len(bytes_), dtype=np.int64)
                once[first] = bytes_[first]
                start = p.first - words.bounds[p.row]
                own = [ids[p.row], digests[p.row], p.key.view(np.int64), p.digest.view(np.int64), start.astype(np.int32), (p.end - p.first - size + 1).astype(np.int32), np.minimum(once, 1 << 30).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in own], names=["doc", "text_digest", "key", "digest", "first", "windows", "bytes"])

    return run


def _strings(size: int, known: np.ndarray, large: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, ids, _ in _steps(batch):
                p = Pieces(words, size, large)
                at, which = _once(p.key, p.digest)
                least, most = np.full(len(at), _TOP), np.full(len(at), -_TOP - 1)
                np.minimum.at(least, which, ids[p.row])
                np.maximum.at(most, which, ids[p.row])
                strings = Packer(words, known).strings(p.first[at], p.end[at])
                own = [p.key[at].view(np.int64), p.digest[at].view(np.int64), (p.end - p.first - size + 1)[at].astype(np.int32), least, most]
                yield pa.RecordBatch.from_arrays([*(pa.array(a) for a in own), pa.array(strings, type=pa.binary())], names=["key", "digest", "windows", "least", "most", "string"])

    return run


# ---------------------------------------------------------------- buckets

def rank_windows(strings: list[bytes], windows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The string and the rank of every window, in order; windows are equal just where their ranks are."""
    length = windows + size - 1
    bounds = np.concatenate([[0], np.cumsum(length)])
    ranks = np.frombuffer(b"".join(s[: 2 * n] for s, n in zip(strings, length.tolist(), strict=True)), dtype="<u2").astype(np.int64)
    spelled = b"".join(s[2 * n :] for s, n in zip(strings, length.tolist(), strict=True)).split(b" ")[:-1]
    codes: dict[bytes, int] = {}
    ranks[ranks == OTHER] = [codes.setdefault(w, OTHER + len(codes)) for w in spelled]
    width = 1
    while 2 * width <= size:
        ranks = _paired(ranks[: len(ranks) - width], ranks[width:])
        width *= 2
    of = np.repeat(np.arange(len(strings)), windows)
    start = np.arange(len(of)) + np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows)
    return of, _paired(ranks[start], ranks[start + size - width]) if width < size else np.unique(ranks[start], return_inverse=True)[1]


def _paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.unique(left * (int(right.max(initial=0)) + 1) + right, return_inverse=True)[1]


class Group:
    """Strings of whole buckets, each kept once with the least and the greatest id that has it."""

    def __init__(self, size: int):
        self.size = size
        self.columns: list[list[np.ndarray]] = [[] for _ in range(5)]
        self.strings: list[bytes] = []
        self.bytes = 0

    def add(self, columns: list[np.ndarray], strings: list[bytes]) -> None:
        for mine, new in zip(self.columns, columns, strict=True):
            mine.append(new)
        self.strings += strings
        self.bytes += sum(map(len, strings))

    def merge(self) -> None:
        key, digest, windows, least, most = (np.concatenate(c) for c in self.columns)
        at, which = _once(key, digest)
        low, high = np.full(len(at), _TOP), np.full(len(at), -_TOP - 1)
        np.minimum.at(low, which, least)
        np.maximum.at(high, which, most)
        self.columns = [[key[at]], [digest[at]], [windows[at]], [low], [high]]
        self.strings = [self.strings[i] for i in at.tolist()]
        self.bytes = sum(map(len, self.strings))

    def answers(self) -> pa.RecordBatch:
        """For each string of which a document may lose words, the least ids of its windows; one, if all are the same."""
        self.merge()
        key, digest, windows, least, most = (c[0] for c in self.columns)
        alone = np.ones(len(key), dtype=bool)
        if len(key) > 1:
            same = key[1:] == key[:-1]
            alone[1:] &= ~same
            alone[:-1] &= ~same
        kept = np.flatnonzero(alone & (least < most))
        rows, lists = [kept], [a.tobytes() for a in least[kept]]
        crowd = np.flatnonzero(~alone)
        if len(crowd):
            of, rank = rank_windows([self.strings[i] for i in crowd.tolist()], windows[crowd], self.size)
            low = np.full(int(rank.max()) + 1, _TOP)
            np.minimum.at(low, rank, least[crowd][of])
            ids = low[rank]
            cuts = np.concatenate([[0], np.cumsum(windows[crowd])])
            lowest, highest = np.minimum.reduceat(ids, cuts[:-1]), np.maximum.reduceat(ids, cuts[:-1])
            for j in np.flatnonzero(lowest < most[crowd]).tolist():
                lists.append(ids[cuts[j] : cuts[j + 1]].tobytes() if lowest[j] < highest[j] else lowest[j].tobytes())
            rows.append(crowd[lowest < most[crowd]])
        at = np.concatenate(rows)
        return pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(digest[at]), pa.array(lists, type=pa.binary())], names=["key", "digest", "least"])


def _buckets(size: int):
    """Batches in order of key and digest; a bucket is judged whole, however many batches it takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, last = Group(size), None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy() for c in batch.columns[:5]]
            strings = batch.column(5).to_pylist()
            key = columns[0]
            total = np.concatenate([[0], np.cumsum([len(x) for x in strings])])
            starts = np.concatenate([[] if key[0] == last else [0], np.flatnonzero(np.diff(key)) + 1]).astype(np.int64)  # of buckets
            begin = 0
            while True:
                k = int(np.searchsorted(total[starts], total[begin] + RANKED_BYTES - group.bytes))
                if k == len(starts):
                    break
                at = int(starts[k])
                group.add([c[begin:at] for c in columns], strings[begin:at])
                yield group.answers()
                group, begin, starts = Group(size), at, starts[k + 1 :]
            group.add([c[begin:] for c in columns], strings[begin:])
            last = key[-1]
            if group.bytes > 2 * RANKED_BYTES:
                group.merge()
        if group.columns[0]:
            yield group.answers()

    return run


# ---------------------------------------------------------------- documents

def _spans(size: int):
    """Columns doc, text_digest, first, windows, least to the words that go: runs of windows whose least id is smaller."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, text, first, windows = (batch.column(k).to_numpy() for k in range(4))
            lists = batch.column(4).to_pylist()
            given = np.array([len(x) // 8 for x in lists])
            ids = np.frombuffer(b"".join(lists), dtype=np.int64)
            weight = np.where(given == 1, windows, 1)  # one id stands for all windows
            of = np.repeat(np.arange(len(doc)), given)
            span = weight[of]
            at = np.cumsum(span) - span
            start = first[of] + at - at[np.cumsum(given) - given][of]
            gone = np.flatnonzero(ids < doc[of])
            if not len(gone):
                continue
            new = np.ones(len(gone), dtype=bool)
            new[1:] = (np.diff(of[gone]) != 0) | (start[gone][1:] != start[gone][:-1] + span[gone][:-1])
            heads = gone[np.flatnonzero(new)]
            tails = gone[np.append(np.flatnonzero(new)[1:], len(gone)) - 1]
            own = [doc[of[heads]], text[of[heads]], start[heads].astype(np.int32), (start[tails] + span[tails] + size - 1).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in own], names=["doc", "text_digest", "begin", "end"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns row, text, spans to row, n_words, n_removed, kept."""
    for batch in batches:
        for lo, hi, data, offsets in kit.text_steps(batch, 1):
            words = kit.Words(data, offsets, lower=False, hashed=False)
            total, removed, texts = np.diff(words.bounds), [], []
            raw = data.tobytes()
            for r, spans in enumerate(batch.column(2)[lo:hi].to_pylist()):
                found = raw[offsets[r] : offsets[r + 1]].split()
                kept, at = [], 0
                for a, b in sorted((s["begin"], s["end"]) for s in spans or ()):
                    kept += found[at:a]
                    at = max(at, b)
                kept += found[at:]
                removed.append(len(found) - len(kept))
                texts.append(b" ".join(kept).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(total, type=pa.int64()), pa.array(removed, type=pa.int64()), pa.array(texts, type=pa.string())], names=["row", *OUT])


def dedup(df: DataFrame, *, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """df with n_words, n_removed and kept: the words that no repeated window covers, joined by one space."""
    if size < CORE:
        raise ValueError(f"a window has {CORE} words at least")
    spark = df.sparkSession
    scratch = kit.Scratch(spark, "super-kmer")
    text = F.col(f"`{text_col}`")
    digest = F.xxhash64(F.lit(3), text)
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc"), digest.alias("text_digest"), text.alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")
    known = vocabulary(docs.select("text"))
    marks, large = scratch.cut(docs.transform(kit.through, _marks(size, known, [], False), MARKS), "marks"), []
    at_level = marks
    while len(large) < len(REACH) - 1:
        keys = at_level.groupBy("key").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") > group_bytes).select("key").toPandas()["key"]
        if not len(keys):
            break
        large.append(np.sort(keys.to_numpy().astype(np.int64).view(kit.U64)))
        again = scratch.cut(docs.transform(kit.through, _marks(size, known, list(large), True), MARKS), f"marks{len(large)}")
        marks, at_level = marks.unionByName(again), again
    parts = min(kit.MOST_PARTS, kit.parts_for(docs, 8 << 20))  # buckets stream, so a partition may be large
    strings = docs.transform(kit.through, _strings(size, known, large), STRINGS).repartition(parts, "key").sortWithinPartitions("key", "digest")
    answers = scratch.cut(strings.transform(kit.through, _buckets(size), "key long, digest long, least binary"), "answers")
    asked = marks.join(answers, ["key", "digest"]).select("doc", "text_digest", "first", "windows", "least")
    spans = asked.transform(kit.through, _spans(size), "doc long, text_digest long, begin int, end int")
    spans = scratch.cut(spans.groupBy("doc", "text_digest").agg(F.collect_set(F.struct("begin", "end")).alias("spans")), "spans")
    rest = [c for c in df.columns if c.lower() not in OUT]
    given = df.select(kit.packed(df, rest), text.alias("text"), F.col(f"`{id_col}`").cast("long").alias("doc"), digest.alias("text_digest"))
    met = given.join(spans, ["doc", "text_digest"], "left").select("row", "text", "spans")
    kept = met.transform(kit.through, _cut, T.StructType([met.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]))
    return kept.select(*kit.unpacked(rest), *OUT)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = f"""
    WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    starts AS (SELECT doc_id, unnest(generate_series(1, len(w) - {SIZE - 1})) AS i, w FROM texts WHERE len(w) >= {SIZE}),
    grams AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + {SIZE - 1}), ' ') AS g FROM starts),
    firsts AS (SELECT g, min(doc_id) AS least FROM grams GROUP BY g),
    gone AS (SELECT DISTINCT doc_id, i + j AS k FROM grams JOIN firsts USING (g), (SELECT unnest(generate_series(0, {SIZE - 1})) AS j) WHERE least < doc_id),
    by_doc AS (SELECT doc_id, count(*) AS n, list(k) AS ks FROM gone GROUP BY doc_id),
    words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM texts),
    kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.k) AS body FROM words w ANTI JOIN gone g ON w.doc_id = g.doc_id AND w.k = g.k GROUP BY w.doc_id)
    SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
    FROM texts t LEFT JOIN by_doc b ON t.doc_id = b.doc_id LEFT JOIN kept k ON t.doc_id = k.doc_id"""
