"""Toxicity: non-negative positive-unlabelled learning over hashed word features.

Confirmed toxic texts are the positives, a bounded sample of any texts is the unlabelled set.
Features are words, their first letters (also where several words of a text begin alike) and
character n-grams, without regard to case. Those that occur in the two at rates that differ by
FEATURE_Z standard errors are kept, at most FEATURES of them; the decay of the weights, not the
cut, keeps chance ones down, so that a few dozen positives suffice. A linear classifier minimises the class-prior-corrected risk
prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]) with the logistic loss; when the
second part turns negative, its gradient is walked back instead. One task trains; scoring
looks features up in a small table and counts each once per document.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm._common import text_or_empty
from tidemark.llm.textbytes import Chunk, RangeHash, chunks
from tidemark.llm.textfeatures import char_grams, fold_latin, repeated, word_features, word_prefixes

BITS = 20
PREFIXES = (4, 5, 6)
GRAM = 5
FEATURES = 2048
FEATURE_Z = 3.0
REPEATS = (2, 3)  # words of a text that begin alike
_SHIFT = np.uint64(64 - BITS)


def buckets(c: Chunk) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind: bucket numbers and bounds by document."""
    c = fold_latin(c)
    hashes = RangeHash(c.data, 5, lower=True)
    prefixes = word_prefixes(c, hashes, PREFIXES)
    kinds = [word_features(c, lower=True)[0], *prefixes, char_grams(c, hashes, GRAM)]
    kinds += [f for p in prefixes[:2] for f in repeated(p, c.n, REPEATS)]
    return [((h >> _SHIFT).astype(np.int64), bounds) for h, bounds in kinds]


@dataclass
class LinearModel:
    features: np.ndarray  # bucket numbers, ascending
    weights: np.ndarray
    bias: float


def present(c: Chunk, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature number), each pair once; column maps a bucket to its feature or -1."""
    found = []
    n = int(column.max()) + 1 if len(column) else 0
    for b, bounds in buckets(c):
        f = column[b]
        at = np.flatnonzero(f >= 0)
        found.append((np.searchsorted(bounds, at, side="right") - 1) * n + f[at])
    code = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return code // max(n, 1), code % max(n, 1)


def nnpu(x: np.ndarray, positive: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam on the non-negative risk. x: float32 rows, positive: which of them are confirmed."""
    w, b = np.zeros(x.shape[1], np.float32), np.float32(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    p, u = np.flatnonzero(positive), np.flatnonzero(~positive)
    for t in range(1, steps + 1):
        g = x @ w + b
        s = 1 / (1 + np.exp(-np.clip(g, -50, 50)))
        loss_negative = np.logaddexp(0, g)
        negative = loss_negative[u].mean() - prior * loss_negative[p].mean()
        slope = np.zeros(len(g), np.float32)
        if negative >= 0:
            slope[p] = prior * (s[p] - 1) / len(p) - prior * s[p] / len(p)
            slope[u] = s[u] / len(u)
        else:
            slope[p] = prior * s[p] / len(p)
            slope[u] = -s[u] / len(u)
        step = np.append(x.T @ slope + decay * w, slope.sum())
        m, v = 0.9 * m + 0.1 * step, 0.999 * v + 0.001 * step**2
        move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w -= move[:-1].astype(np.float32)
        b -= np.float32(move[-1])
    return w, float(b)


def train(texts: list[str], positive: np.ndarray, prior: float) -> LinearModel:
    n_p, n_u = int(positive.sum()), int((~positive).sum())
    if not n_p or not n_u:
        return LinearModel(np.zeros(0, np.int64), np.zeros(0, np.float32), float(np.log(prior / (1 - prior))))
    column = pa.array(texts, pa.string())
    counts = np.zeros((2, 1 << BITS))
    for c in chunks(column):
        kinds = buckets(c)
        for d in range(c.n):
            own = np.unique(np.concatenate([b[bounds[d] : bounds[d + 1]] for b, bounds in kinds]))
            counts[int(positive[c.first + d]), own] += 1
    rate_p, rate_u, rate = counts[1] / n_p, counts[0] / n_u, counts.sum(0) / (n_p + n_u)
    z = np.abs(rate_p - rate_u) / np.sqrt(np.maximum(rate * (1 - rate), 1e-12) * (1 / n_p + 1 / n_u))
    features = np.sort(np.argsort(-z, kind="stable")[:FEATURES])
    features = features[z[features] >= FEATURE_Z]
    lookup = np.full(1 << BITS, -1, dtype=np.int64)
    lookup[features] = np.arange(len(features))
    x = np.zeros((len(texts), len(features)), np.float32)
    for c in chunks(column):
        doc, f = present(c, lookup) if len(features) else (np.zeros(0, int),) * 2
        x[c.first + doc, f] = 1
    w, b = nnpu(x, positive, prior)
    return LinearModel(features, w, b)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", positives: int = 2000, unlabelled: int = 6000, prior: float | None = None) -> LinearModel:
    """A model from at most positives rows of label 1 and unlabelled rows of docs, those of least hash.

    prior: the share of toxic texts among all; by default that of label 1 among labelled rows
    (kept within 0.001 and 0.5). Rows that are labelled 0 only enter through the prior.
    """
    marked = labels.where(F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("y"))
    if prior is None:
        share = marked.agg(F.avg("y").alias("p")).first()["p"]
        prior = min(0.5, max(0.001, share if share is not None else 0.1))
    least = [F.xxhash64("doc_id"), "doc_id"]
    p = marked.where("y = 1").select("doc_id").distinct().orderBy(*least).limit(positives).withColumn("positive", F.lit(True))
    u = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long")).orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id").limit(unlabelled).withColumn("positive", F.lit(False))
    chosen = p.unionAll(u)
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "positive", "text")
    known = prior

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data = pd.concat(list(frames) or [pd.DataFrame({"doc_id": [], "positive": [], "text": []})]).sort_values(["doc_id", "positive", "text"])
        yield pd.DataFrame({"model": [pickle.dumps(train(data["text"].tolist(), data["positive"].to_numpy(dtype=bool), known))]})

    made = rows.repartition(1).mapInPandas(learn, "model binary").collect()  # one model of bounded size
    return pickle.loads(bytes(made[0]["model"])) if made else train([], np.zeros(0, bool), prior)


def score(docs: DataFrame, model: LinearModel, threshold: float = 0.5) -> DataFrame:
    """docs with score (probability of toxic) and predicted.

    Null and empty texts have no features and get the score of the bias. Extra columns stay,
    except any named score or predicted. Repeated rows get equal scores.
    """
    base = docs.drop(*[c for c in docs.columns if c in {"score", "predicted"}])
    names, features, weights, bias = base.columns, model.features, model.weights.astype(np.float64), model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = np.full(1 << BITS, -1, dtype=np.int32)
        lookup[features] = np.arange(len(features))
        for batch in batches:
            out = np.full(batch.num_rows, bias)
            for c in chunks(batch["text"]):
                if len(features):
                    doc, f = present(c, lookup)
                    out[c.first : c.first + c.n] += np.bincount(doc, weights[f], c.n)
            out = 1 / (1 + np.exp(-np.clip(out, -60, 60)))
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(out), pa.array((out >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + ", score double, predicted int"
    return base.mapInArrow(run, schema)
