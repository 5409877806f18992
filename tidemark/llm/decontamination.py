"""Benchmark decontamination: latent semantic retrieval with a randomised SVD, then word-order and answer checks.

Passages are WINDOW words of a document, STRIDE apart; their TF-IDF columns are the words of
the benchmark (another word is zero in every query). A first pass counts columns over all
passages, a second accumulates A'A times a random start, from which the driver works out the
leading singular values and right singular vectors of the passages (a single-pass randomised
SVD); the third projects every passage and every item on them, takes pairs whose cosine reaches
`cosine` of what the item itself would score, and checks each pair: the longest common
subsequence with the item's words around the passage, as a share of the item, and the share of
the item's rarest words, its answer words, that occur there. A paraphrase with words changed,
left out or put in keeps most of its order. An item longer than a window is cut into passages as documents are; the best of them
retrieves it, and the checks look at the whole item.

The benchmark is looked at in blocks of some ITEMS item passages, so what tasks are sent is bounded whatever
its size; sums are one row per column and task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm._common import text_or_empty
from tidemark.llm.brown_lm import Table
from tidemark.llm.textbytes import Chunk, RangeHash, Words, chunks, mix, words

WINDOW, STRIDE = 64, 32
DIMS = 128
CHUNK = 1 << 16  # bytes of text at once: the fewer, the fewer columns its dense blocks have
ITEMS = 2048
COMMON = 0.02  # a column in more passages than this share weighs less, so that it has the energy of one in this share; none weighs nothing
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[ord(x) for x in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True


def bare_words(c: Chunk) -> Words:
    """Words without ASCII punctuation at their ends; a word of punctuation alone stays as it is."""
    w = words(c)
    start, end = w.start.copy(), w.end.copy()
    for _ in range(3):
        start += (end - start > 1) & _PUNCTUATION[c.data[np.minimum(start, len(c.data) - 1)]] if len(start) else 0
        end -= (end - start > 1) & _PUNCTUATION[c.data[end - 1]] if len(end) else 0
    return Words(start, end, w.of_doc, mix(RangeHash(c.data, 1, lower=True)(start, end)))


def lcs_length(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over the item's positions."""
    where: dict[int, int] = {}
    for i, x in enumerate(item.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for y in text.tolist():
        u = v & where.get(y, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def passages(columns: np.ndarray, of_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of words with a column (-1: none): passage and column of each distinct pair, its count; and the first passage of each document."""
    n = np.diff(of_doc)
    per = np.maximum(1, -(-(n - (WINDOW - STRIDE)) // STRIDE))
    first = np.append(0, np.cumsum(per))
    at = np.flatnonzero(columns >= 0)
    doc = np.searchsorted(of_doc, at, side="right") - 1
    block = (at - of_doc[doc]) // STRIDE
    width = int(columns.max()) + 1 if len(at) else 1
    codes = []
    for back in range(WINDOW // STRIDE):
        j = block - back
        ok = (j >= 0) & (j < per[doc])
        codes.append((first[doc[ok]] + j[ok]) * width + columns[at[ok]])
    code, count = np.unique(np.concatenate(codes), return_counts=True)
    return code // width, code % width, count, first


def _counts(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Passages that hold each column; column -1: all passages."""
    table, total, n = Table(vocabulary), np.zeros(len(vocabulary), np.int64), 0
    for batch in batches:
        for c in chunks(batch["text"]):
            w = bare_words(c)
            _, column, _, first = passages(table.find(w.hash.view(np.int64)), w.of_doc)
            total += np.bincount(column, minlength=len(vocabulary))
            n += int(first[-1])
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, at)), pa.array(np.append(n, total[at]))], names=["col", "n"])


def _blocks(passage: np.ndarray, column: np.ndarray, value: np.ndarray, most: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(passages, columns, unit rows) of up to `most` passages at a time, as dense matrices over the columns that they hold."""
    head = np.flatnonzero(np.append(True, passage[1:] != passage[:-1])) if len(passage) else np.zeros(0, np.int64)
    ends = np.append(head, len(passage))
    for i in range(0, len(head), most):
        j = min(i + most, len(head))
        lo, hi = ends[i], ends[j]
        columns, at = np.unique(column[lo:hi], return_inverse=True)
        m = np.zeros((j - i, len(columns)), np.float32)
        m[np.repeat(np.arange(j - i), np.diff(ends[i : j + 1])), at] = value[lo:hi]
        m /= np.sqrt((m**2).sum(axis=1, keepdims=True))
        yield passage[head[i:j]], columns, m


def _sketch(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray, idf: np.ndarray, start: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(A'A) start over the task's passages: a row for each column."""
    table, weight, omega = Table(vocabulary), idf.astype(np.float32), start.astype(np.float32)
    total = np.zeros(omega.shape)
    for batch in batches:
        for c in chunks(batch["text"], CHUNK):
            w = bare_words(c)
            passage, column, count, _ = passages(table.find(w.hash.view(np.int64)), w.of_doc)
            for _, columns, m in _blocks(passage, column, count * weight[column]):
                total[columns] += m.T @ (m @ omega[columns])
    at = np.flatnonzero(total.any(axis=1))
    yield _vectors(at, total[at])


def _vectors(columns: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns.astype(np.int64)), pa.array([x.tobytes() for x in rows], pa.binary())], names=["col", "vec"])


def _summed(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    """The sum of the vectors of each column that the task holds."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for column, vec in zip(batch["col"].to_pylist(), batch["vec"].to_pylist(), strict=True):
            total[column] = total.get(column, 0.0) + np.frombuffer(vec)
    columns = sorted(total)
    yield _vectors(np.array(columns, dtype=np.int64), np.stack([total[c] for c in columns]) if columns else np.zeros((0, dims)))


@dataclass
class Index:
    """A block of the benchmark in the latent space."""

    vocabulary: np.ndarray
    idf: np.ndarray
    basis: np.ndarray  # columns x dims
    item_ids: list
    item_words: list[np.ndarray]
    answers: list[np.ndarray]  # the rarest words of each item
    piece_of: np.ndarray  # the item of each item passage
    latent: np.ndarray  # item passages x dims, scaled so that the passage itself scores 1


def right_singular(image: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leading right singular vectors and singular values of A, from A'A times a random start alone.

    The Nystroem form of the randomised SVD: with Y = A'A S, A'A is close to Y (S'Y)^-1 Y'. A
    small shift keeps the Cholesky factor of S'Y sound and is taken off the eigenvalues again.
    Directions without energy are left out.
    """
    start, upper = np.linalg.qr(start)
    y = np.linalg.solve(upper.T, image.T).T  # the image of the orthonormal start
    shift = np.finfo(float).eps * max(np.linalg.norm(y), 1e-300) * np.sqrt(len(y))
    y = y + shift * start
    core = start.T @ y
    core = (core + core.T) / 2
    while True:
        try:
            lower = np.linalg.cholesky(core)
            break
        except np.linalg.LinAlgError:  # rank-deficient: a larger shift
            y, core, shift = y + 9 * shift * start, core + 9 * shift * np.eye(len(core)), 10 * shift
    vectors, values, _ = np.linalg.svd(np.linalg.solve(lower, y.T).T, full_matrices=False)
    values = np.maximum(values**2 - shift, 0.0)
    keep = values > 1e-10 * max(values.max(initial=0.0), 1e-300)
    return vectors[:, keep], np.sqrt(values[keep])


def fit(docs: DataFrame, item_ids: list, item_texts: list[str], dims: int = DIMS, seed: int = 5) -> Index:
    """The index of one block of items over all passages of docs."""
    item_words = []
    for c in chunks(pa.array(item_texts, pa.string())):
        w = bare_words(c)
        item_words += [w.hash[w.of_doc[i] : w.of_doc[i + 1]].view(np.int64) for i in range(c.n)]
    vocabulary = np.unique(np.concatenate(item_words)) if item_words else np.zeros(0, np.int64)
    texts = docs.select(text_or_empty().alias("text"))
    found = texts.mapInArrow(lambda x: _counts(x, vocabulary), "col long, n long").groupBy("col").agg(F.sum("n").alias("n")).toArrow()
    df, n = np.zeros(len(vocabulary) + 1), 0
    df[found["col"].to_numpy()] = found["n"].to_numpy()  # -1 is the last place
    n, df = df[-1], df[:-1]
    raw = np.log1p(n / (1 + df))
    idf = raw * np.sqrt(np.minimum(1.0, COMMON * n / np.maximum(df, 1))) if n else raw + 1.0
    table = Table(vocabulary)
    bounds = np.append(0, np.cumsum([len(w) for w in item_words]))
    piece, column, count, first = passages(table.find(np.concatenate(item_words)), bounds)
    piece_of = np.repeat(np.arange(len(item_words)), np.diff(first))
    value = count * idf[column]
    head = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
    value /= np.repeat(np.sqrt(np.add.reduceat(value**2, head)), np.diff(np.append(head, len(piece))))
    rows = lambda m: np.add.reduceat(value[:, None] * m[column], head, axis=0)  # noqa: E731  item passages times m

    def back(m: np.ndarray) -> np.ndarray:
        out = np.zeros((len(vocabulary), m.shape[1]))
        np.add.at(out, column, value[:, None] * m[piece])
        return out

    rng = np.random.default_rng(seed)
    dims = min(dims, max(1, len(vocabulary)))
    start = back(rng.normal(size=(len(piece_of), dims))) + 0.01 * rng.normal(size=(len(vocabulary), dims))
    parts = texts.mapInArrow(lambda x: _sketch(x, vocabulary, idf, start), "col long, vec binary")
    sums = parts.repartition("col").mapInArrow(lambda x: _summed(x, dims), "col long, vec binary").toArrow()
    image = back(rows(start))  # the items are passages too
    image[sums["col"].to_numpy()] += np.frombuffer(b"".join(sums["vec"].to_pylist())).reshape(-1, dims)
    basis = right_singular(image, start)[0]
    latent = rows(basis)
    own = np.maximum((latent**2).sum(1, keepdims=True), 1e-12)
    answers = []
    for w in item_words:
        u = np.unique(w)
        answers.append(u[np.argsort(-raw[table.find(u)], kind="stable")[: max(1, len(u) // 3)]])
    return Index(vocabulary, idf, basis.astype(np.float32), item_ids, item_words, answers, piece_of, (latent / own).astype(np.float32))


_MATCHES = "doc_id long, item_id long, lcs_share double, answer_share double, cosine double"


def _search(batches: Iterator[pa.RecordBatch], index: Index, cosine: float, lcs: float, answer: float) -> Iterator[pa.RecordBatch]:
    table, weight, basis = Table(index.vocabulary), index.idf, index.basis
    answers, longest = [x.tolist() for x in index.answers], max(map(len, index.item_words))
    asked = np.append(np.isin(index.vocabulary, np.concatenate(index.answers)), False)  # index -1: no column
    fewest = min(math.ceil(answer * len(x)) for x in answers)
    for batch in batches:
        ids = batch["doc_id"].to_numpy()
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for c in chunks(batch["text"], CHUNK):
            w = bare_words(c)
            h = w.hash.view(np.int64)
            found = table.find(h)
            passage, column, count, first = passages(found, w.of_doc)
            # no item's answer check below can pass where fewer answer words stand than the least that any item asks for
            known = np.append(0, np.cumsum(asked[found]))
            doc = np.searchsorted(first, passage, side="right") - 1
            at = w.of_doc[doc] + STRIDE * (passage - first[doc])
            near_by = known[np.minimum(w.of_doc[doc + 1], at + WINDOW + longest)] - known[np.maximum(w.of_doc[doc], at - longest)]
            passage, column, count = (x[near_by >= fewest] for x in (passage, column, count))
            last, held = -1, set()
            looked: dict[tuple[int, int], float] = {}
            for places, columns, m in _blocks(passage, column, count * weight[column]):
                near = (m @ basis[columns]) @ index.latent.T
                for p, k in np.argwhere(near >= cosine).tolist():
                    at = (int(places[p]), int(index.piece_of[k]))
                    looked[at] = max(looked.get(at, -1.0), float(near[p, k]))
            for (p, i), angle in looked.items():
                if p != last:
                    d = int(np.searchsorted(first, p, side="right")) - 1
                    at = w.of_doc[d] + STRIDE * (p - first[d])
                    last, held = p, set(h[max(w.of_doc[d], at - longest) : min(w.of_doc[d + 1], at + WINDOW + longest)].tolist())
                # the cheap test first: without its answer words an item is not there, whatever the order
                if sum(x in held for x in answers[i]) < answer * len(answers[i]):
                    continue
                item = index.item_words[i]
                around = h[max(w.of_doc[d], at - len(item)) : min(w.of_doc[d + 1], at + WINDOW + len(item))]
                share = lcs_length(item, around) / len(item)
                if share < lcs:
                    continue
                known = float(np.isin(index.answers[i], around).mean())
                if known >= answer:
                    key = (c.first + d, i)
                    best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (share, known, angle))
        rows = list(best.items())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([int(ids[d]) for (d, _), _ in rows], pa.int64()),
                pa.array([index.item_ids[i] for (_, i), _ in rows], pa.int64()),
                *(pa.array([x[k] for _, x in rows], pa.float64()) for k in range(3)),
            ],
            names=[x.split()[0] for x in _MATCHES.split(", ")],
        )


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.35, lcs: float = 0.6, answer: float = 0.5, dims: int = DIMS) -> DataFrame:
    """(doc_id, item_id, lcs_share, answer_share, cosine): the items that documents hold, verbatim or paraphrased; a row for each pair.

    Items without words (or null) match nothing; repeated items are each reported, items of one
    id once. Null and empty texts and rows with a null doc_id match nothing; rows of one doc_id
    are reported together. Extra columns are not read. Empty tables give no rows.
    """
    spark = docs.sparkSession
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    items = benchmark.where(F.col("item_id").isNotNull() & text_or_empty().rlike(r"[^\x20\x09-\x0D]")).select(F.col("item_id").cast("long"), "text").distinct()
    pieces = F.greatest(F.lit(1), F.ceil((F.size(F.split("text", r"[\x20\x09-\x0D]+")) - (WINDOW - STRIDE)) / STRIDE))
    blocks = -(-(items.agg(F.sum(pieces).alias("n")).first()["n"] or 0) // ITEMS)
    found = []
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()  # about ITEMS passages
        if rows:
            index = fit(texts, [r["item_id"] for r in rows], [r["text"] for r in rows], dims)
            found.append(texts.mapInArrow(lambda x, index=index: _search(x, index, cosine, lcs, answer), _MATCHES))
    if not found:
        return spark.createDataFrame([], _MATCHES)
    best = F.max(F.struct("lcs_share", "answer_share", "cosine")).alias("best")
    return reduce(DataFrame.unionAll, found).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **limits) -> DataFrame:
    """docs without the documents that contaminated() reports; all columns stay."""
    hit = contaminated(docs, benchmark, **limits).select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti").select(*docs.columns)
