"""Quality classifier: supervised subword embeddings.

Words, word pairs and character n-grams are hashed into buckets; each bucket has a learned
vector. A document is the mean of its vectors (the mean over kinds of the mean of each kind), a
softmax layer gives the class. Vectors and layer are trained by numpy stochastic gradient
descent in one task, over a bounded sample of labelled rows: `sample` of them, those of least
hash. A score needs only the inner product of a bucket's vector with the layer, so scoring a
document is a sum of looked-up numbers.
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
from tidemark.llm.textfeatures import char_grams, sums, word_features

BITS = 16
GRAMS = (3, 5)
KINDS = 2 + len(GRAMS)
_SHIFT = np.uint64(64 - BITS)


def buckets(c: Chunk) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind: bucket numbers and bounds by document."""
    hashes = RangeHash(c.data, 5)
    kinds = [*word_features(c, lower=False), *(char_grams(c, hashes, k) for k in GRAMS)]
    return [((h >> _SHIFT).astype(np.int64), bounds) for h, bounds in kinds]


@dataclass
class SubwordModel:
    vectors: np.ndarray  # 2**BITS x dims
    output: np.ndarray  # dims x 2
    bias: np.ndarray  # 2

    def table(self) -> tuple[np.ndarray, float]:
        """Each bucket's share of the log odds of class 1, and their constant."""
        return (self.vectors @ (self.output[:, 1] - self.output[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def train(texts: list[str], labels: np.ndarray, dims: int = 8, epochs: int = 6, rate: float = 0.5, batch: int = 64, seed: int = 7) -> SubwordModel:
    """Stochastic gradient descent with per-bucket step sizes (Adagrad) on the cross entropy."""
    rng = np.random.default_rng(seed)
    n_buckets = 1 << BITS
    model = SubwordModel(rng.normal(0, 0.1, (n_buckets, dims)), rng.normal(0, 0.5, (dims, 2)), np.zeros(2))
    index, value = [], []
    for c in chunks(pa.array(texts, pa.string())):
        kinds = buckets(c)
        for d in range(c.n):
            parts = [np.unique(b[bounds[d] : bounds[d + 1]], return_counts=True) for b, bounds in kinds]
            index.append(np.concatenate([u for u, _ in parts]).astype(np.int32))
            value.append(np.concatenate([n / max(n.sum(), 1) / KINDS for _, n in parts]).astype(np.float32))
    seen_v, seen_o, seen_b = np.full((n_buckets, dims), 1e-8), np.full((dims, 2), 1e-8), np.full(2, 1e-8)
    order = np.arange(len(texts))
    for _ in range(epochs if len(texts) else 0):
        rng.shuffle(order)
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            sizes = np.array([len(index[i]) for i in some])
            f, x = np.concatenate([index[i] for i in some]), np.concatenate([value[i] for i in some])
            row = np.repeat(np.arange(len(some)), sizes)
            h = np.stack([np.bincount(row, x * model.vectors[f, k], len(some)) for k in range(dims)], axis=1)
            logits = h @ model.output + model.bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), labels[some]] -= 1
            p /= len(some)
            g_out, g_bias, g_h = h.T @ p, p.sum(0), p @ model.output.T
            touched, inverse = np.unique(f, return_inverse=True)
            g_v = np.stack([np.bincount(inverse, x * g_h[row, k], len(touched)) for k in range(dims)], axis=1)
            seen_v[touched] += g_v**2
            model.vectors[touched] -= rate * 0.2 * g_v / np.sqrt(seen_v[touched])
            seen_o += g_out**2
            seen_b += g_bias**2
            model.output -= rate * 0.2 * g_out / np.sqrt(seen_o)
            model.bias -= rate * 0.2 * g_bias / np.sqrt(seen_b)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 3000) -> SubwordModel:
    """A model of label (0 or 1; other values and null are left out) from at most sample labelled rows."""
    chosen = (
        labels.where(F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    )
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data = pd.concat(list(frames) or [pd.DataFrame({"doc_id": [], "y": [], "text": []})]).sort_values(["doc_id", "text"])
        yield pd.DataFrame({"model": [pickle.dumps(train(data["text"].tolist(), data["y"].to_numpy(dtype=np.int64)))]})

    made = rows.repartition(1).mapInPandas(learn, "model binary").collect()  # one model of fixed size
    return pickle.loads(bytes(made[0]["model"])) if made else train([], np.zeros(0, np.int64))


def score(docs: DataFrame, model: SubwordModel, threshold: float = 0.5) -> DataFrame:
    """docs with score (the softmax probability of class 1) and predicted.

    Null and empty texts have no features: their score is that of the bias alone. Extra
    columns stay, except any named score or predicted. Repeated rows get equal scores.
    """
    table, bias = model.table()
    base = docs.drop(*[c for c in docs.columns if c in {"score", "predicted"}])
    names = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for c in chunks(batch["text"]):
                odds = np.full(c.n, bias)
                for b, bounds in buckets(c):
                    odds += sums(table[b], bounds) / np.maximum(np.diff(bounds), 1) / KINDS
                out[c.first : c.first + c.n] = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(out), pa.array((out >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + ", score double, predicted int"
    return base.mapInArrow(run, schema)
