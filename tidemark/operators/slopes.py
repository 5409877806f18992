"""Median of pairwise slopes without the pairs: ranks are counted as inversions, the median is found by its rank.

The pairs of points whose slope is at most t are those whose order by y - t * x is the reverse of their order by x, so
they are counted in O(n log n). The k-th slope is the least t that has k slopes up to it, found by bisection over the doubles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

SMALL = 48  # points up to which listing all pairs is cheaper than counting them


def inversions(ranks: np.ndarray) -> int:
    """Pairs i < j with ranks[j] < ranks[i], by merging blocks of doubled size; ranks are different numbers from 0 to n - 1."""
    n = len(ranks)
    size = 1 << max(n - 1, 1).bit_length()
    blocks = np.concatenate([ranks, np.arange(n, size)]).astype(np.int64)
    total, b = 0, 1
    while b < size:
        pairs = blocks.reshape(-1, 2, b)
        shift = np.arange(len(pairs))[:, None] * size
        left, right = (pairs[:, 0] + shift).ravel(), (pairs[:, 1] + shift).ravel()
        below = np.searchsorted(left, right) - np.repeat(np.arange(len(pairs)) * b, b)
        total += b * len(right) - int(below.sum())
        blocks, b = np.sort(pairs.reshape(-1, 2 * b), axis=1).ravel(), 2 * b
    return total


def _up_to(x: np.ndarray, y: np.ndarray, t: float) -> int:
    """Pairs of different x with a slope of at most t; x is sorted."""
    z = y - t * x
    order = np.lexsort((z, x))
    z, x = z[order], x[order]
    ranks = np.empty(len(x), dtype=np.int64)
    ranks[np.lexsort((np.arange(len(x)), -x, z))] = np.arange(len(x))
    return inversions(ranks)


def _number(t: float) -> int:
    """An integer that orders doubles."""
    bits = int(np.float64(t).view(np.int64))
    return bits if bits >= 0 else -(bits & 0x7FFF_FFFF_FFFF_FFFF)


def _double(number: int) -> float:
    return float(np.int64(number).view(np.float64)) if number >= 0 else -float(np.int64(-number).view(np.float64))


def _ranked(x: np.ndarray, y: np.ndarray, k: int, low: float, high: float) -> float:
    """The least double with k slopes up to it, from low to high."""
    a, b = _number(low), _number(high)
    while a < b:
        middle = (a + b) // 2
        a, b = (a, middle) if _up_to(x, y, _double(middle)) >= k else (middle + 1, b)
    return _double(a)


def _nearest(x: np.ndarray, y: np.ndarray, t: float) -> float:
    """The slope of the pair that changes its order at t, which takes away the rounding of the search."""
    order = np.lexsort((x, y - t * x))
    dx, dy = np.diff(x[order]), np.diff(y[order])
    met = dx != 0
    slopes = dy[met] / dx[met]
    return float(slopes[np.argmin(np.abs(slopes - t))])


def median_slope(x: np.ndarray, y: np.ndarray) -> tuple[float | None, int]:
    """(median, number) of the slopes of all pairs of points with different x."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    same = np.unique(x, return_counts=True)[1]
    pairs = (len(x) * (len(x) - 1) - int((same * (same - 1)).sum())) // 2
    if pairs == 0:
        return None, 0
    if len(x) <= SMALL:
        i, j = np.triu_indices(len(x), 1)
        apart = x[j] > x[i]
        return float(np.median((y[j] - y[i])[apart] / (x[j] - x[i])[apart])), pairs
    steps = np.diff(np.unique(x))
    bound = float(y.max() - y.min()) / float(steps.min()) * (1 + 1e-9) + 1e-300
    k = (pairs + 1) // 2
    low = _ranked(x, y, k, -bound, bound)
    if pairs % 2 or _up_to(x, y, low) > k:
        return _nearest(x, y, low), pairs
    return (_nearest(x, y, low) + _nearest(x, y, _ranked(x, y, k + 1, low, bound))) / 2, pairs


@F.arrow_udf(T.StructType([T.StructField("slope", T.DoubleType()), T.StructField("pairs", T.LongType())]))
def _median_slopes(points: pa.Array) -> pa.Array:
    ends = points.offsets.to_numpy()
    x, y = (points.values.field(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in (0, 1))
    found = [median_slope(x[a:b], y[a:b]) for a, b in zip(ends[:-1], ends[1:])]
    return pa.StructArray.from_arrays([pa.array([s for s, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64())], names=["slope", "pairs"])


def median_slopes(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, slope and pairs: the median slope per day of each group's (day, value) points.

    A group meets in one row, so callers bound it first. Values are not null.
    """
    at = F.struct(F.datediff("day", F.lit("1970-01-01").cast("date")).alias("x"), F.col("value").cast("double").alias("y"))
    return points.groupBy(*keys).agg(F.collect_list(at).alias("points")).select(*keys, _median_slopes("points").alias("found")).select(*keys, "found.*")


def slope_range(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pairs, least and most slope per day over all pairs of different days; groups without a pair have no row.

    The slope of any pair is a mean of the slopes between neighbouring days, so the extremes lie between neighbours.
    """
    days = points.groupBy(*keys, "day").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))
    order = Window.partitionBy(*keys).orderBy("day")

    def slope(of: str, before: str) -> Column:
        return (F.col(of) - F.lag(before).over(order)) / F.datediff("day", F.lag("day").over(order))

    near = days.select(*keys, "n", slope("low", "high").alias("least"), slope("high", "low").alias("most"))
    n = F.sum("n")
    pairs = ((n * n - F.sum(F.col("n") * F.col("n"))) / 2).cast("long")
    return near.groupBy(*keys).agg(pairs.alias("pairs"), F.min("least").alias("least"), F.max("most").alias("most")).where("pairs > 0")
