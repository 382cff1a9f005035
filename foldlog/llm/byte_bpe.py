"""Byte-level BPE through sentencepiece, with a model serialised straight from a rank file.

Each byte has a printable stand-in (the map that byte-level vocabularies use), so a token's bytes become a piece. A
sentencepiece BPE model of those pieces, scored by the negative rank and with identity normalisation, merges the
adjacent pair of the best score, the leftmost first: what merging by least rank does. A text is cut by the
pre-token pattern; a pre-token that is a token itself is that token, any other is encoded as its stand-ins. Decoding
maps ids to pieces and their characters back to bytes, so it gives the text's bytes again.

The rank file is read once on the driver; its model (about 1 MB, fixed by the vocabulary) goes to the tasks with the
function. Tasks hold one Arrow batch and a table of pre-tokens that is emptied at ``CACHE`` entries.

Defined cases: a null text is encoded as the empty one, to no ids. Repeated rows get equal ids. Other columns are
kept; those named like an output are replaced.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldlog.llm import kit

CACHE = 50_000
#: A longer pre-token is encoded anew each time, so that the table's memory is bounded.
CACHED_BYTES = 64


def stand_ins() -> list[str]:
    """A printable character for each byte: itself if printable in Latin-1, else the next one from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(other)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in order of their ranks, which have to be 0, 1, 2, ..."""
    with open(path, "rb") as lines:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, filter(bytes.strip, lines)))
    if [r for r, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks have gaps")
    return [t for _, t in ranked]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protocol-buffer field: bytes length-delimited, int as varint, float as 32 bits."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto; ids are ranks, and the unknown piece that it demands comes last.

    Fixed values of that format: pieces are field 1 (piece 1, score 2, type 3: 1 normal, 2 unknown); trainer settings
    field 2 (model type 3: 2 is BPE; ids of unk, bos, eos, pad 40 to 43); normaliser settings field 3 (name 1, map 2,
    dummy prefix 3, extra white space 4, escaped white space 5).
    """
    letter = stand_ins()
    pieces = [_field(1, _field(1, "".join(letter[b] for b in t).encode()) + _field(2, -float(rank)) + _field(3, 1)) for rank, t in enumerate(tokens)]
    absent = (1 << 64) - 1
    unknown = _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + b"".join(_field(k, absent) for k in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(2, b"") + b"".join(_field(k, 0) for k in (3, 4, 5))
    return b"".join(pieces) + unknown + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes and decodes; made anew in each Python worker from (tokens, model, pattern)."""

    def __init__(self, tokens: list[bytes], model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.tokens = tokens
        self.rank = {t.decode("utf-8", "surrogateescape"): struct.pack("<I", r) for r, t in enumerate(tokens) if _is_text(t)}
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.letter = stand_ins()
        self.find = regex.compile(pattern).findall
        self.cache = _Cache(self)

    def of(self, pre: str) -> bytes:
        whole = self.rank.get(pre)
        if whole is not None:
            return whole
        ids = self.pieces.encode("".join(map(self.letter.__getitem__, pre.encode())))
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.cache.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


def _is_text(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


class _Cache(dict):
    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, pre: str) -> bytes:
        ids = self.codec.of(pre)
        if len(pre) <= CACHED_BYTES:
            if len(self) >= CACHE:
                self.clear()
            self[pre] = ids
        return ids


def _codec(shared) -> Codec:
    """A codec for one task; kept no longer, so that a reused worker is small again."""
    return Codec(*shared.value)


def public_vocabulary() -> tuple[str, str]:
    """Path and pattern of the multilingual 50k vocabulary that is installed on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _shared(spark, path: str, pattern: str):
    tokens = read_ranks(path)
    return spark.sparkContext.broadcast((tokens, serialise(tokens), pattern))


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """df with ``ids`` (binary: little-endian unsigned 32-bit integers) and ``n_tokens`` (long)."""
    shared = _shared(df.sparkSession, path, pattern)
    rest = [c for c in df.columns if c not in ("ids", "n_tokens")]
    given = df.select(kit.packed(df, rest), F.col(text_col).alias("given"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            for lo, hi, _, _ in kit.text_steps(batch, 1):
                part = batch.slice(lo, hi - lo)
                ids = [codec.encode(t) if t else b"" for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), kit.binaries(ids), pa.array([len(x) // 4 for x in ids], type=pa.int64())], names=["row", "ids", "n_tokens"])

    return given.transform(kit.through, run, T.StructType([given.schema["row"], T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())])).select(*kit.unpacked(rest), "ids", "n_tokens")


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """df with ``decoded`` (binary): the bytes that the ids stand for. Null ids are decoded to nothing."""
    shared = _shared(df.sparkSession, path, pattern)
    rest = [c for c in df.columns if c != "decoded"]
    given = df.select(kit.packed(df, rest), F.col(ids_col).alias("given"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            for lo, hi, _, _ in kit.text_steps(batch, 1):
                part = batch.slice(lo, hi - lo)
                texts = [codec.decode(x) if x else b"" for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), kit.binaries(texts)], names=["row", "decoded"])

    return given.transform(kit.through, run, T.StructType([given.schema["row"], T.StructField("decoded", T.BinaryType())])).select(*kit.unpacked(rest), "decoded")


def round_trip(df: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """What decode gives of what encode gives, in one pass and with one codec a task: ids, n_tokens, decoded."""
    shared = _shared(df.sparkSession, path, pattern)
    rest = [c for c in df.columns if c not in ("ids", "n_tokens", "decoded")]
    given = df.select(kit.packed(df, rest), F.col(text_col).alias("given"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            for lo, hi, _, _ in kit.text_steps(batch, 1):
                part = batch.slice(lo, hi - lo)
                ids = [codec.encode(t) if t else b"" for t in part.column(1).to_pylist()]
                made = [kit.binaries(ids), pa.array([len(x) // 4 for x in ids], type=pa.int64()), kit.binaries([codec.decode(x) if x else b"" for x in ids])]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], names=["row", "ids", "n_tokens", "decoded"])

    more = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.BinaryType())]
    return given.transform(kit.through, run, T.StructType([given.schema["row"], *more])).select(*kit.unpacked(rest), *(f.name for f in more))


def query(spark, sf_dir: str) -> DataFrame:
    both = round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), *public_vocabulary())
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids, and whether they decode to the text again; the last stage."""
    own = docs.drop("n_tokens", "ids_sha256", "exact")
    both = round_trip(own.select(F.struct(*own.columns).alias("whole"), "text"), *public_vocabulary())
    return both.select(*(F.col(f"whole.`{c}`") for c in own.columns), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), (F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("exact"))
