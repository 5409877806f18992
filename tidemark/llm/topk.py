"""Exact top-k inner products: Fagin's threshold algorithm over sorted per-dimension lists.

Vectors are dealt by hash into blocks of bounded size, queries likewise; each pair of blocks is
one group of a cogroup, in which every dimension's list is sorted once and each query walks
its lists in parallel, scoring what it meets and stopping when no unseen vector can reach its
kth score. A first search of one data block for each query block gives every query a kth score
to start from, which it carries to all other blocks: a block whose lists begin below it is left
at once, and only what reaches it comes back. The k best of each block then meet in a ranked
window (pruned before the shuffle).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm._common import written

DATA_BLOCK = 1 << 14
QUERY_BLOCK = 1 << 12
FOUND = "query_id long, vec_id long, score long"


def quantised(column: str = "embedding", scale: int = 1024) -> Column:
    """floor(scale * x) of every component, as long; an error where a long cannot hold it."""

    def one(x: Column) -> Column:
        scaled = F.lit(float(scale)) * x.cast("double")
        return F.when(F.abs(scaled) < F.lit(2.0**63), F.floor(scaled)).otherwise(F.raise_error(F.lit("a scaled component is beyond a long")).cast("bigint"))

    return F.transform(column, one)


def usable(column: str = "embedding") -> Column:
    """Neither null nor empty, and without null, NaN or infinite components."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.col(column).isNotNull() & (F.size(column) > 0) & F.coalesce(finite, F.lit(False))


def threshold_search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, vector ids, scores) of the k best rows of a block for each query; ties to the smaller id, the query's own id left out.

    floors: a score for each query below which nothing is wanted. vectors and queries are int64. Where no score can reach
    2**53 they are added up in float64, which is exact; else in int64, and bounds of unseen vectors get
    the slack that float64 needs. A score that a long cannot hold is an OverflowError.
    """
    n, dims = vectors.shape
    largest = [int(np.abs(x.astype(np.float64)).max(initial=0)) for x in (vectors, queries)]
    small = largest[0] * largest[1] * dims < 1 << 53
    held, asked = (vectors.astype(np.float64), queries.astype(np.float64)) if small else (vectors, queries)
    order = np.argsort(vectors, axis=0, kind="stable")
    lists = np.take_along_axis(vectors, order, axis=0).astype(np.float64)
    widest = np.abs(vectors.astype(np.float64)).max(axis=0)

    def scores(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        if not small and np.abs(rows.astype(np.float64) @ q.astype(np.float64)).max(initial=0) >= 2.0**63 * (1 - 1e-9):
            raise OverflowError("a score is beyond a long")
        return rows @ q

    for qid, q, exact, floor in zip(query_ids, queries.astype(np.float64), asked, floors if floors is not None else np.full(len(query_ids), -(1 << 63)), strict=True):
        slack = 0.0 if small else 1e-9 * float(np.abs(q) @ widest)
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        seen = np.zeros(n, dtype=bool)
        best_ids, best = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=held.dtype)
        depth, step = 0, 32
        while depth < n:
            if depth == 0 and q[up] @ lists[-1, up] + q[down] @ lists[0, down] + slack < floor:
                break
            to = min(n, depth + step)
            met = np.zeros(n, dtype=bool)
            met[order[n - to : n - depth, up].ravel()] = True
            met[order[depth:to, down].ravel()] = True
            if to == n:
                met[:] = True  # a query of zeros has no lists to walk
            new = np.flatnonzero(met & ~seen)
            seen |= met
            new = new[ids[new] != qid]
            if len(new):
                best_ids, best = np.concatenate([best_ids, ids[new]]), np.concatenate([best, scores(held[new], exact)])
                if len(best) > k:
                    keep = np.argpartition(-best, k - 1)[:k]
                    keep = np.flatnonzero(best >= best[keep].min())  # every tie of the kth
                    top = keep[np.lexsort((best_ids[keep], -best[keep]))[:k]]
                    best_ids, best = best_ids[top], best[top]
            depth, step = to, step * 4
            bound = q[up] @ lists[n - depth, up] + q[down] @ lists[depth - 1, down] + slack
            if bound < floor or (len(best) >= k and bound < best.min()):
                break
        kept = best >= int(floor)
        best_ids, best = best_ids[kept], best[kept]
        at = np.lexsort((best_ids, -best))
        yield int(qid), best_ids[at], best[at]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id", column: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best rows of vectors for each row of queries.

    Only vectors of the query's dimension are candidates, never rows of the query's own id.
    Scores are exact integers; one that a long cannot hold is an error, and so is such a scaled component.
    Rows with a null id or an unusable vector take no part. An empty table gives an empty result. Repeated rows are candidates of
    their own, and repeated queries of one id count once. Extra columns are not read.
    """
    keep = F.col(id_column).isNotNull() & usable(column)
    rows = vectors.where(keep).select(F.col(id_column).cast("long").alias("vec_id"), quantised(column, scale).alias("v"))
    asked = queries.where(keep).select(F.col(id_column).cast("long").alias("vec_id"), quantised(column, scale).alias("v")).dropDuplicates(["vec_id"])
    n = rows.count()
    m = asked.count()
    data_blocks, query_blocks = max(1, -(-n // DATA_BLOCK)), max(1, -(-m // QUERY_BLOCK))

    def dealt(df: DataFrame, own: str, own_n: int, other: str, other_n: int, *more: Column) -> DataFrame:
        return df.select(
            "vec_id", "v", *more, F.size("v").alias("dims"), F.pmod(F.xxhash64("vec_id"), F.lit(own_n)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(other_n - 1))).alias(other),
        )

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            a, b = (np.array(x["v"].to_pylist(), dtype=np.int64) for x in (left, right))
            floors = right["floor"].to_numpy()
            for qid, ids, scores in threshold_search(left["vec_id"].to_numpy(), a, right["vec_id"].to_numpy(), b, k, floors):
                parts.append((np.full(len(ids), qid), ids, scores.astype(np.int64)))
        found = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 3
        return pa.table({name: pa.array(x.astype(np.int64)) for name, x in zip(("query_id", "vec_id", "score"), found, strict=True)})

    keys = ["dims", "db", "qb"]

    def searched(data: DataFrame, wanted: DataFrame) -> DataFrame:
        return data.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInArrow(search, FOUND)

    data, wanted = dealt(rows, "db", data_blocks, "qb", query_blocks), dealt(asked, "qb", query_blocks, "db", data_blocks)
    first = F.col("db") == F.col("qb") % data_blocks  # the block that each query block looks at first
    none = F.lit(-(1 << 63))
    found = searched(data.where(first), wanted.where(first).withColumn("floor", none))
    if data_blocks > 1:
        head = written(found, "topk-first")
        place = Window.partitionBy("query_id").orderBy(F.desc("score"))
        floors = head.withColumn("n", F.row_number().over(place)).where(F.col("n") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
        floored = dealt(asked.join(floors, "vec_id", "left"), "qb", query_blocks, "db", data_blocks, F.coalesce("floor", none).alias("floor"))
        found = head.unionAll(searched(data.where(~first), floored.where(~first)))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
