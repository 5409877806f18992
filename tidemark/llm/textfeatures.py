"""Hashed n-gram features of a chunk of documents, each kind with its bounds by document."""

from __future__ import annotations

import numpy as np

from tidemark.llm.textbytes import Chunk, RangeHash, mix, ramp, words

_U = np.uint64
Feature = tuple[np.ndarray, np.ndarray]  # hashes, bounds by document


def char_grams(c: Chunk, hashes: RangeHash, k: int) -> Feature:
    """Every k bytes of each document."""
    per = np.maximum(np.diff(c.bounds) - k + 1, 0)
    start = np.repeat(c.bounds[:-1], per) + ramp(per)
    return mix(hashes(start, start + k) + _U(k)), np.append(0, np.cumsum(per))


def word_features(c: Chunk, lower: bool) -> tuple[Feature, Feature]:
    """Words, and pairs of words in a row; a word followed by itself is one feature whatever the word."""
    w = words(c, seed=11, lower=lower)
    n = np.maximum(np.diff(w.of_doc) - 1, 0)
    at = np.repeat(w.of_doc[:-1], n) + ramp(n)
    first, second = w.hash[at], w.hash[at + 1] if len(at) else w.hash[at]
    pair = np.where(first == second, _U(0x5851F42D4C957F2D), mix(first * _U(0x9E3779B97F4A7C15) + second))
    return (w.hash, w.of_doc), (pair, np.append(0, np.cumsum(n)))


def word_prefixes(c: Chunk, hashes: RangeHash, sizes: tuple[int, ...]) -> list[Feature]:
    """The first k bytes of each word that has more than k."""
    w = words(c, seed=11, lower=True)
    out = []
    for k in sizes:
        has = np.flatnonzero(w.end - w.start > k)
        out.append((mix(hashes(w.start[has], w.start[has] + k) + _U(1000 + k)), np.searchsorted(has, w.of_doc)))
    return out


def fold_latin(c: Chunk) -> Chunk:
    """The chunk with the upper-case letters of Latin-1 beyond ASCII in lower case, as their two UTF-8 bytes allow; ASCII is left to the hashes."""
    lead = np.append(np.uint8(0), c.data[:-1]) == 0xC3
    upper = lead & (c.data >= 0x80) & (c.data <= 0x9E) & (c.data != 0x97)
    return Chunk(c.first, c.data + (upper * np.uint8(0x20)), c.bounds)


def repeated(feature: Feature, n: int, times: tuple[int, ...]) -> list[Feature]:
    """For each of times: the features that occur that often in a document, each once, under a hash of their own."""
    hashes, bounds = feature
    doc = np.repeat(np.arange(n), np.diff(bounds))
    order = np.lexsort((hashes, doc))
    h, doc = hashes[order], doc[order]
    start = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))) if len(h) else np.zeros(0, np.int64)
    count = np.diff(np.append(start, len(h)))
    out = []
    for k in times:
        keep = start[count >= k]
        out.append((mix(h[keep] + _U(77 + k)), np.searchsorted(doc[keep], np.arange(n + 1))))
    return out


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of values in each document."""
    total = np.append(0.0, np.cumsum(values, dtype=np.float64))
    return total[bounds[1:]] - total[bounds[:-1]]
