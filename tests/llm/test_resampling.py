"""Chunks against whole texts, draws against a plain loop, odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tidemark.llm.resampling import buckets, resample, split

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = st.text(alphabet=st.sampled_from("abZ9 .\n{é中_"), max_size=90)


def features(text, n):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 97 for k in range(1, n + 1) for i in range(len(words) - k + 1)]


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(1, 4), st.integers(1, 30))
def test_chunks_own_each_start_once(text, n, size):
    made = [buckets(piece, owned, n, 97) for piece, owned in split(text.encode(), n, size)]
    words, want = features(text, n)
    assert sum(m for m, _ in made) == words
    assert Counter(np.concatenate([f for _, f in made]).tolist()) == Counter(want)
    assert b"".join(piece[:owned] for piece, owned in split(text.encode(), n, size)) == text.encode().lower()


def plain_way(docs, target, n, share, least, seed):
    source, wanted = Counter(), Counter()
    for _, text in docs:
        source.update(features(text, n)[1])
    for text in target:
        wanted.update(features(text, n)[1])
    s_all, t_all = source.total(), wanted.total()
    gain = [math.floor(1000 * math.log((wanted[b] + 1.0) * (s_all + 97) / ((source[b] + 1.0) * (t_all + 97)))) for b in range(97)]
    rows = []
    for doc_id, text in docs:
        words, f = features(text, n)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return rows, able[: len(able) * share[0] // share[1]]


@pytest.mark.parametrize(("n", "share", "chunk_bytes"), [(1, (10, 100), 1 << 16), (2, (1, 3), 64), (3, (1, 1), 7)])
def test_draw_equals_the_plain_way(spark, rows, n, share, chunk_bytes):
    docs = [(r[0], r[1]) for r in rows] + [(None, "an id is not there " * 9), (None, None), (4, "a fourth row of one id " * 5)] + [(901, "one row many times over " * 4)] * 30
    target = ["changed words of the target", None, "", "abc abd one row"]
    made = spark.createDataFrame([(d, t, 0, 1.0) for d, t in docs], "doc_id long, text string, part int, score double").repartition(3)
    found = resample(made, spark.createDataFrame([(1, t) for t in target], "item_id long, text string"), n=n, modulus=97, share=share, least_words=5, chunk_bytes=chunk_bytes).collect()
    all_rows, drawn = plain_way(docs, target, n, share, 5, 2024)
    assert Counter(tuple(r)[:5] for r in found) == Counter(map(tuple, all_rows))
    ranked = sorted((r for r in found if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r["doc_id"], r["score"]) for r in ranked] == [(r[0], r[4]) for r in drawn]


def test_empty_tables(spark, docs, empty):
    assert resample(empty, empty).count() == 0
    alone = resample(docs, empty).collect()
    assert len(alone) == docs.count() and any(r["rank"] == 1 for r in alone)
