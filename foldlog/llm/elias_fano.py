"""Elias-Fano sequences and a two-level n-gram trie on them, laid out in one memory map that lookups read in place."""

from __future__ import annotations

import mmap
from collections.abc import Iterator

import numpy as np

U64 = np.uint64
_KINDS = ("|u1", "<u4", "<i8", "<f8")  # of arrays in a map
_BLOCK = 16  # bytes of the upper bits that a directory entry covers
_ONES = np.array([bin(b).count("1") for b in range(256)], dtype=np.int16)
#: [byte, k]: where the k-th zero (one) of the byte stands, lowest bit first
_AT = {bit: np.array([([i for i in range(8) if (b >> i & 1) == bit] + [8] * 8)[:8] for b in range(256)], dtype=np.int64) for bit in (0, 1)}


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Numbers of so many bits each, one after another, lowest bit first."""
    if not bits or not len(values):
        return np.zeros(9, dtype=np.uint8)
    out = np.zeros((len(values) * bits + 7) // 8 + 9, dtype=np.uint8)
    for lo in range(0, len(values), 1 << 16):  # a multiple of 8 numbers fills whole bytes
        part = values[lo : lo + (1 << 16)]
        flat = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :bits].ravel()
        packed = np.packbits(flat, bitorder="little")
        out[lo * bits // 8 : lo * bits // 8 + len(packed)] = packed
    return out


def _unpack(packed: np.ndarray, bits: int, at: np.ndarray) -> np.ndarray:
    if not bits:
        return np.zeros(len(at), dtype=U64)
    where = at * bits
    first, shift = where >> 3, (where & 7).astype(U64)
    words = np.ndarray(len(packed) - 7, dtype="<u8", buffer=packed, strides=(1,))  # a word from every byte on
    value = words[first] >> shift
    if bits > 57:  # a ninth byte may hold the top
        spill = np.flatnonzero(shift)
        value[spill] |= packed[first[spill] + 8].astype(U64) << (U64(64) - shift[spill])
    return value & U64((1 << bits) - 1) if bits < 64 else value


def mapped(arrays: list[np.ndarray]) -> mmap.mmap:
    """A memory map without a file that holds the arrays one after another, each behind its kind and length."""
    heads = [np.array([_KINDS.index(a.dtype.str), len(a)], dtype="<i8").tobytes() for a in arrays]
    out = mmap.mmap(-1, sum(len(h) + -(-a.nbytes // 8) * 8 for h, a in zip(heads, arrays, strict=True)))
    for head, a in zip(heads, arrays, strict=True):
        out.write(head)
        out.write(np.ascontiguousarray(a).data)
        out.seek(-a.nbytes % 8, 1)
    return out


def arrays_in(buffer) -> Iterator[np.ndarray]:
    """The arrays of ``mapped``, as views of the same memory."""
    at = 0
    while at < len(buffer):
        kind, n = np.frombuffer(buffer, dtype="<i8", count=2, offset=at).tolist()
        found = np.frombuffer(buffer, dtype=_KINDS[kind], count=n, offset=at + 16)
        yield found
        at += 16 + -(-found.nbytes // 8) * 8


class EliasFano:
    """A monotone sequence of unsigned integers: low bits packed, high bits in unary, a directory over the latter."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.bits, self.low, self.high, self.ones = n, bits, low, high, ones

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        bits = max(0, min(63, (universe // max(n, 1)).bit_length() - 1))
        upper = (values >> U64(bits)).astype(np.int64) + np.arange(n)
        size = (universe >> bits) + n + 2
        blocks = -(-size // (8 * _BLOCK))
        flags = np.zeros(blocks * 8 * _BLOCK, dtype=np.uint8)
        flags[upper] = 1
        high = np.packbits(flags, bitorder="little")
        ones = np.concatenate([[0], np.cumsum(flags.reshape(blocks, -1).sum(axis=1, dtype=np.int64))]).astype(np.uint32)
        low = _pack(values & U64((1 << bits) - 1) if bits else values, bits)
        return cls(n, bits, low, high, ones)

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.bits]), self.low, self.high, self.ones]

    @classmethod
    def read(cls, arrays: Iterator[np.ndarray]) -> EliasFano:
        """From the next four arrays."""
        n, bits = next(arrays).tolist()
        return cls(n, bits, next(arrays), next(arrays), next(arrays))

    def _select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Where the k-th set (bit 1) or clear (bit 0) upper bit stands, k from 0."""
        before = self.ones.astype(np.int64)
        if not bit:
            before = np.arange(len(before)) * (8 * _BLOCK) - before
        block = np.searchsorted(before, k, side="right") - 1
        inside = self.high[(block * _BLOCK)[:, None] + np.arange(_BLOCK)]
        counts = _ONES[inside] if bit else 8 - _ONES[inside]
        sums = np.cumsum(counts, axis=1, dtype=np.int16)
        rest = k - before[block]
        byte = (sums <= rest[:, None]).sum(axis=1)
        row = np.arange(len(k))
        rest = rest - np.where(byte > 0, sums[row, np.maximum(byte - 1, 0)], 0)
        return (block * _BLOCK + byte) * 8 + _AT[bit][inside[row, byte], rest]

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self._select(i, 1) - i).astype(U64) << U64(self.bits) | _unpack(self.low, self.bits, i)

    def bucket(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of elements that have the upper bits of each value."""
        top = (values >> U64(self.bits)).astype(np.int64)
        first = np.where(top > 0, self._select(np.maximum(top - 1, 0), 0) - np.maximum(top - 1, 0), 0)
        return first, self._select(top, 0) - top

    def successor(self, values: np.ndarray, within: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The index of the first element that is not less than each value (n if none), and whether it is equal.

        within: only elements of these ranges, which have to be in order among themselves.
        """
        low = values & U64((1 << self.bits) - 1)
        first, stop = self.bucket(values)
        if within is not None:
            first, stop = np.clip(within[0], first, stop), np.clip(within[1], first, stop)
        last = stop.copy()
        going = np.flatnonzero(first < last)
        while len(going):  # halve the bucket of equal upper bits
            middle = (first[going] + last[going]) >> 1
            less = _unpack(self.low, self.bits, middle) < low[going]
            first[going[less]] = middle[less] + 1
            last[going[~less]] = middle[~less]
            going = going[first[going] < last[going]]
        equal = first < stop
        there = np.flatnonzero(equal)
        equal[there] = _unpack(self.low, self.bits, first[there]) == low[there]
        return first, equal


class Codebook:
    """256 evenly spaced values from the least to the greatest: no value is off by more than half a step."""

    def __init__(self, values: np.ndarray):
        self.centres = np.linspace(values.min(), values.max(), 256) if len(values) else np.zeros(256)

    def code(self, values: np.ndarray) -> np.ndarray:
        step = self.centres[1] - self.centres[0]
        return np.rint((values - self.centres[0]) / step if step else np.zeros(len(values))).astype(np.uint8)


class Trie:
    """Contexts, and below each its words; pointers and keys are Elias-Fano sequences, values are bytes.

    A word's key in the second level is the context's rank times 2^32 plus the word, so one monotone sequence serves
    all contexts and a word is sought relative to its context.
    """

    def __init__(self, buffer):
        """buffer: what ``build`` returned, or the same bytes from elsewhere."""
        arrays = arrays_in(buffer)
        self.contexts, self.pointers, self.words = (EliasFano.read(arrays) for _ in range(3))
        self.codes, self.centres = arrays

    @staticmethod
    def build(context: np.ndarray, word: np.ndarray, value: np.ndarray) -> mmap.mmap:
        """context, word: sorted distinct pairs; value: of each pair."""
        distinct, first = np.unique(context, return_index=True)
        rank = np.repeat(np.arange(len(distinct), dtype=np.int64), np.diff(np.append(first, len(context))))
        book = Codebook(value)
        levels = (
            EliasFano.of(distinct, 1 << 64),
            EliasFano.of(np.append(first, len(context)).astype(U64), len(context) + 1),
            EliasFano.of(rank.astype(U64) << U64(32) | word.astype(U64), max(1, len(distinct)) << 32),
        )
        return mapped([a for level in levels for a in level.arrays()] + [book.code(value), book.centres])

    def find(self, context: np.ndarray, sizes: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each pair is there, and its value (0 if not).

        context: distinct contexts; sizes: how many of the words belong to each, one after another.
        """
        n = len(word)
        hit, value = np.zeros(n, dtype=bool), np.zeros(n)
        if not self.contexts.n or not n:
            return hit, value
        at, known = self.contexts.successor(context)
        at = np.where(known, at, 0)
        begin, end = (self.pointers.get(x).astype(np.int64) for x in (at, at + 1))
        of = np.repeat(np.arange(len(context)), sizes)
        asked = np.flatnonzero(known[of])
        of = of[asked]
        key = at[of].astype(U64) << U64(32) | word[asked].astype(U64)
        j, equal = self.words.successor(key, (begin[of], end[of]))
        hit[asked] = equal
        value[asked[equal]] = self.centres[self.codes[j[equal]]]
        return hit, value
