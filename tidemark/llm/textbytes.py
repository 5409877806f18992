"""Vectorised byte work on Arrow text columns: rolling hashes, words and shingles in numpy.

A chunk is a run of whole documents of one Arrow batch whose texts hold at most CHUNK_BYTES
together (or one longer document). All arrays here are bounded by a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 17
BASE = 0x9E3779B97F4A7C15
_U = np.uint64

LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


@lru_cache(8)
def byte_codes(seed: int, lower: bool) -> np.ndarray:
    """A random 64-bit number for each byte; with lower, A-Z share those of a-z."""
    codes = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
    return codes[LOWERED] if lower else codes


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        made = []
        for b in (base, pow(base, -1, 2**64)):
            a = np.full(size, b, dtype=np.uint64)
            a[0] = 1
            made.append(np.multiply.accumulate(a))
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = (made[0], made[1])
        have = (made[0], made[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, on a copy."""
    h = h ^ (h >> _U(33))
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


@dataclass
class Chunk:
    """Whole documents, laid end to end. bounds[i]:bounds[i + 1] are the bytes of document i."""

    first: int  # row of document 0 in its batch
    data: np.ndarray
    bounds: np.ndarray

    @property
    def n(self) -> int:
        return len(self.bounds) - 1


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Splits a text column into chunks; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    width = np.dtype(kind).itemsize
    offsets = np.frombuffer(texts.buffers()[1], dtype=kind, count=len(texts) + 1, offset=texts.offset * width).astype(np.int64)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield Chunk(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


class RangeHash:
    """Hashes of any byte range of a chunk in constant time (prefix sums of a polynomial)."""

    def __init__(self, data: np.ndarray, seed: int, lower: bool = False, base: int = BASE):
        up, self.down = powers(len(data) + 1, base)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        terms = byte_codes(seed, lower)[data]
        terms *= up[: len(data)]
        np.cumsum(terms, out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def rolling(self, k: int) -> np.ndarray:
        """Of every k bytes, by their start."""
        h = self.sums[k:] - self.sums[:-k]
        h *= self.down[: len(h)]
        return h


@dataclass
class Words:
    """start, end: the bytes of each word; of_doc[i]:of_doc[i + 1] are the words of document i."""

    start: np.ndarray
    end: np.ndarray
    of_doc: np.ndarray
    hash: np.ndarray

    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.of_doc) - 1), np.diff(self.of_doc))


def words(c: Chunk, seed: int = 1, lower: bool = True) -> Words:
    """Words [^\\x20\\x09-\\x0D]+ of each document, with a 64-bit hash of their (lower-cased) bytes."""
    n = len(c.data)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none, np.zeros(c.n + 1, np.int64), np.zeros(0, np.uint64))
    ink = ~IS_SPACE[c.data]
    full = np.flatnonzero(np.diff(c.bounds) > 0)
    begins = ink.copy()
    begins[1:] &= ~ink[:-1]
    heads = c.bounds[:-1][full]
    begins[heads] |= ink[heads]
    ends = ink.copy()
    ends[:-1] &= ~ink[1:]
    tails = c.bounds[1:][full] - 1
    ends[tails] |= ink[tails]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(start, end, np.searchsorted(start, c.bounds), mix(RangeHash(c.data, seed, lower)(start, end)))


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every k words in a row and bounds by document; a document of fewer words has its whole sequence as one."""
    counts = np.diff(w.of_doc)
    per_doc = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    bounds = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(per_doc, out=bounds[1:])
    out = np.zeros(bounds[-1], dtype=np.uint64)
    long = np.flatnonzero(counts >= k)
    if len(long):
        # position of each shingle's first word: its rank in the document plus the document's first word
        first = np.repeat(w.of_doc[long], per_doc[long]) + ramp(per_doc[long])
        h = np.zeros(len(first), dtype=np.uint64)
        for i in range(k):
            h = (h ^ w.hash[first + i]) * _U(0xD6E8FEB86659FD93 + 2 * i)
            h ^= h >> _U(32)
        out[np.repeat(bounds[long], per_doc[long]) + ramp(per_doc[long])] = mix(h)
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        h = _U(0x51ED270B + int(counts[d]))
        for x in w.hash[w.of_doc[d] : w.of_doc[d + 1]]:
            with np.errstate(over="ignore"):
                h = (h ^ x) * _U(0xD6E8FEB86659FD93)
                h ^= h >> _U(29)
        out[bounds[d]] = mix(np.array([h]))[0]
    return out, bounds


def ramp(counts: np.ndarray) -> np.ndarray:
    """0 .. count - 1 for each count, end to end."""
    counts = counts[counts > 0]
    total = int(counts.sum())
    steps = np.ones(total, dtype=np.int64)
    if total == 0:
        return steps
    heads = np.cumsum(counts)[:-1]
    steps[0] = 0
    steps[heads] = 1 - counts[:-1]
    return np.cumsum(steps)
