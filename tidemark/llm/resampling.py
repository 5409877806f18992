"""Importance resampling towards a target: hashed word n-grams, chunk by chunk.

Texts are worked on in chunks. A chunk ends at a word boundary and carries the n - 1 words after it,
so that it holds every run of words that starts inside it and owns exactly these starts. Long
texts become several chunks, which are dealt out over all tasks; the counts of buckets add up over
chunks, and so do the gains of a document.

Words are tokenised once: each chunk leaves its buckets as two bytes a feature in a written table,
from which both the corpus counts and the weights are taken.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm._common import each_copy, partitions, text_or_empty, written

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CHUNK_BYTES = 1 << 16
_CHUNKS = "doc_id long, digest string, part int, body binary, owned int"
_FEATURES = "doc_id long, digest string, part int, n_words long, features binary"


def split(body: bytes, n: int, size: int) -> Iterator[tuple[bytes, int]]:
    """(chunk with its carry, bytes whose word starts it owns) of a text with A-Z lower-cased; one chunk at least.

    A word that a chunk's size would cut stays whole in the chunk where it starts.
    """
    body, a = body.lower(), 0
    while True:
        b = min(a + size, len(body))
        if b < len(body) and (cut := WORD.match(body, b)) and WORD.match(body, b - 1):
            b = cut.end()
        end = b
        for _, word in zip(range(n - 1), WORD.finditer(body, b)):
            end = word.end()
        yield body[a:end], b - a
        a = b
        if a >= len(body):
            return


def buckets(body: bytes, owned: int, n: int, modulus: int) -> tuple[int, np.ndarray]:
    """Words that start among the owned bytes, and the bucket of each run of 1 to n words that starts with one of them."""
    words, mine = [], 0
    for word in WORD.finditer(body.lower()):
        mine += word.start() < owned
        words.append(word.group())
    found, sums = [], [zlib.crc32(w) for w in words]
    for length in range(1, n + 1):
        if length > 1:  # the checksum of a run goes on from that of the run without its last word
            sums = [zlib.crc32(b" " + w, c) for c, w in zip(sums, words[length - 1 :])]
        found.append(np.array(sums[:mine], dtype=np.uint32) % modulus)
    return mine, np.concatenate(found)


def _chunks(batches: Iterator[pa.RecordBatch], n: int, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, digest, body in zip(*(c.to_pylist() for c in batch.columns)):
            for part, (piece, owned) in enumerate(split(body, n, size)):
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc_id], pa.int64()), "digest": [digest], "part": pa.array([part], pa.int32()), "body": [piece], "owned": pa.array([owned], pa.int32())})


def _features(batches: Iterator[pa.RecordBatch], n: int, modulus: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc_id, digest, part, body, owned = batch.columns
        made = [buckets(b.as_py(), o, n, modulus) for b, o in zip(body, owned.to_pylist())]
        packed = pa.array([f.astype(np.uint16 if modulus <= 1 << 16 else np.uint32).tobytes() for _, f in made], pa.binary())
        yield pa.RecordBatch.from_arrays([doc_id, digest, part, pa.array([w for w, _ in made], pa.int64()), packed], ["doc_id", "digest", "part", "n_words", "features"])


def _width(modulus: int) -> type:
    return np.uint16 if modulus <= 1 << 16 else np.uint32


def _bucket_counts(batches: Iterator[pa.RecordBatch], modulus: int) -> Iterator[pa.RecordBatch]:
    """One row for each bucket that a task meets: the table of a task is as large as the modulus, whatever it reads."""
    total = np.zeros(modulus, dtype=np.int64)
    for batch in batches:
        for packed in batch.column(0):
            total += np.bincount(np.frombuffer(packed.as_buffer(), dtype=_width(modulus)), minlength=modulus)
    met = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bucket", "n"])


def _gains(batches: Iterator[pa.RecordBatch], gains: np.ndarray) -> Iterator[pa.RecordBatch]:
    width = _width(len(gains))
    for batch in batches:
        doc_id, digest, part, n_words, packed = batch.columns
        found = [np.frombuffer(x.as_buffer(), dtype=width) for x in packed]
        sums = [pa.array([int(f(x)) for x in found], pa.int64()) for f in (len, lambda x: gains[x].sum())]
        yield pa.RecordBatch.from_arrays([doc_id, digest, part, n_words, *sums], ["doc_id", "digest", "part", "n_words", "n_features", "gain"])


def hashed(docs: DataFrame, n: int, modulus: int, chunk_bytes: int = CHUNK_BYTES, name: str = "features") -> DataFrame:
    """A written table of (doc_id, digest, part, n_words, features): the buckets of each chunk of each text.

    Texts of up to chunk_bytes are one chunk and stay in their task; the chunks of longer ones are dealt out.
    """
    body = text_or_empty().cast("binary")
    rows = docs.select("doc_id", F.md5(body).alias("digest"), body.alias("body"))
    size = F.octet_length("body")
    short = rows.where(size <= chunk_bytes).select("doc_id", "digest", F.lit(0).alias("part"), "body", size.alias("owned"))
    long = rows.where(size > chunk_bytes).mapInArrow(lambda x: _chunks(x, n, chunk_bytes), _CHUNKS)
    dealt = long.repartition(partitions(docs.sparkSession), "doc_id", "digest", "part")
    return written(short.union(dealt).mapInArrow(lambda x: _features(x, n, modulus), _FEATURES), f"resampling-{name}")


def _counts(features: DataFrame, modulus: int) -> np.ndarray:
    """Features of each bucket over a whole hashed() table; what reaches the driver is modulus rows at most."""
    found = features.select("features").mapInArrow(lambda x: _bucket_counts(x, modulus), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(modulus, dtype=np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of each bucket's smoothed share in the target over that in the source."""
    modulus, s_all, t_all = float(len(source)), float(source.sum()), float(target.sum())
    ratio = [((t + 1.0) * (s_all + modulus)) / ((s + 1.0) * (t_all + modulus)) for s, t in zip(source.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], dtype=np.int64)


def _noise(seed: int) -> Column:
    """floor(1000 * a Gumbel number) drawn from seed and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def _offsets(scores: DataFrame) -> DataFrame:
    """(score, before): the documents of higher scores, from one row (score, n) a score.

    Scores are whole numbers between bounded logarithms, so there are at most some 200 000 of
    them however many documents there are. Thousands of scores are summed first, then the scores inside a thousand.
    """
    wide = F.floor(F.col("score") / 1000)
    above = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    top = scores.groupBy(wide.alias("wide")).agg(F.sum("n").alias("n"))
    top = top.select("wide", above(Window.orderBy(F.desc("wide"))).alias("base"))
    inside = above(Window.partitionBy("wide").orderBy(F.desc("score")))
    return scores.withColumn("wide", wide).withColumn("inside", inside).join(F.broadcast(top), "wide").select("score", (F.col("base") + F.col("inside")).alias("before"))


def resample(
    docs: DataFrame, target: DataFrame, n: int = 1, modulus: int = 10000, share: tuple[int, int] = (10, 100), least_words: int = 20, seed: int = 2024, chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of docs; rank is null where a row is not drawn.

    Features are all runs of 1 to n words, by the bucket of their checksum. A document's weight is the floored mean of
    its features' gains (0 without features), its score that weight plus Gumbel noise from seed and doc_id. Of the
    rows with least_words words, share of them with the highest scores are drawn, ranked from 1; ties go to
    the smaller doc_id, rows without one come last of a tie.

    A null text is empty: no features. Rows that share a doc_id are told apart by their texts (128-bit
    digest); full copies of a row are counted once and given back as often as they came, with ranks
    that follow each other. Texts of any length cost a task one chunk at a time. With an empty target
    or no documents all counts are 0. Columns besides doc_id and text are not read.
    """
    features = hashed(docs, n, modulus, chunk_bytes, "documents")
    wanted = hashed(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), n, modulus, chunk_bytes, "target")
    gains = bucket_gains(_counts(features, modulus), _counts(wanted, modulus))
    parts = features.mapInArrow(lambda x: _gains(x, gains), "doc_id long, digest string, part int, n_words long, n_features long, gain long")
    sums = ["n_words", "n_features", "gain"]
    whole = parts.groupBy("doc_id", "digest").agg(F.count_if(F.col("part") == 0).alias("copies"), *[F.sum(c).alias(c) for c in sums])
    whole = whole.select("doc_id", "digest", "copies", *[F.expr(f"{c} div copies").alias(c) for c in sums])
    weight = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    weighed = whole.withColumn("weight", weight).withColumn("score", F.col("weight") + _noise(seed))
    scored = written(weighed.select("doc_id", "digest", "copies", "n_words", "n_features", "weight", "score"), "resampling-scores")

    able = scored.where(F.col("n_words") >= least_words)
    histogram = able.groupBy("score").agg(F.sum("copies").alias("n"))
    goal = (histogram.agg(F.sum("n")).first()[0] or 0) * share[0] // share[1]
    cuts = _offsets(histogram).where(F.col("before") < goal)
    last = cuts.agg(F.min("score")).first()[0]
    in_reach = (F.col("n_words") >= least_words) & (F.col("score") >= last) if last is not None else F.lit(False)
    order = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "digest").rowsBetween(Window.unboundedPreceding, -1)
    reached = scored.where(in_reach).join(F.broadcast(cuts), "score").withColumn("before", F.col("before") + F.coalesce(F.sum("copies").over(order), F.lit(0)))
    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    ranked = each_copy(reached).select(*names, (F.col("before") + F.col("copy")).alias("rank")).withColumn("rank", F.when(F.col("rank") <= goal, F.col("rank")))
    return ranked.union(each_copy(scored.where(~in_reach)).select(*names, F.lit(None).cast("long").alias("rank")))
