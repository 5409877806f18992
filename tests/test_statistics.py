"""Rank selection, ranged quantiles and the sorted as-of join against plain ways."""

import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidemark.operators import association, baseline, joins, order_statistics, slopes

POINTS = st.lists(st.tuples(st.integers(0, 40), st.sampled_from([-3.5, 0.0, 1.0, 1.25, 2.0, 7.75, 1e6])), max_size=60)


def listed(points):
    return sorted((b[1] - a[1]) / (b[0] - a[0]) for a in points for b in points if b[0] > a[0])


@settings(max_examples=150, deadline=None)
@given(st.permutations(range(23)), st.integers(0, 23))
def test_inversions(ranks, n):
    order = np.argsort(np.argsort(ranks[:n]))
    assert slopes.inversions(order) == sum(order[j] < order[i] for i in range(n) for j in range(i + 1, n))


@settings(max_examples=150, deadline=None)
@given(POINTS)
def test_median_slope_of_few_and_many_points(points):
    x, y = np.array([p[0] for p in points], dtype=float), np.array([p[1] for p in points], dtype=float)
    want = listed(points)
    for small in (slopes.SMALL, 1):
        slopes.SMALL, before = small, slopes.SMALL
        try:
            found, pairs = slopes.median_slope(x, y)
        finally:
            slopes.SMALL = before
        assert pairs == len(want)
        assert found == (pytest.approx(np.median(want), rel=1e-9, abs=1e-9) if want else None)


def test_2000_points_without_their_pairs(spark):
    rng = np.random.default_rng(5)
    values = rng.normal(size=2000).cumsum() * 3 + 70
    rows = [("a", date(2015, 1, 1) + timedelta(i), float(v)) for i, v in enumerate(values)] + [("b", date(2015, 1, 1), 1.0), ("c", date(2015, 1, 1), 1.0), ("c", date(2015, 1, 2), 2.0), ("c", date(2015, 1, 4), None), ("c", date(2015, 1, 5), 2.0)]
    points = spark.createDataFrame(rows, "k string, day date, value double")
    made = baseline.theil_sen(points, ["k"])
    assert "<" not in "".join(line for line in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line)
    found = {r.k: r for r in made.collect()}
    i, j = np.triu_indices(2000, 1)
    assert found["a"].slope == pytest.approx(float(np.median((values[j] - values[i]) / (j - i))), rel=1e-12) and found["a"].pairs == len(i)
    assert (found["b"].slope, found["b"].reason, found["c"].slope, found["c"].pairs) == (None, "too_few_dates", 0.25, 3)
    ends = {r.k: (r.pairs, r.least, r.most) for r in slopes.slope_range(points.where("value IS NOT NULL"), ["k"]).collect()}
    steps = np.diff(values)
    assert ends == {"a": (len(i), pytest.approx(steps.min()), pytest.approx(steps.max())), "c": (3, 0.0, 1.0)}


@pytest.mark.parametrize("share", [0.9, 0.3])
def test_ranged_quantiles_equal_percentile(spark, share):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < share else rng.choice(["a", "b", None]), rng.choice([None, rng.gauss(0, 5), float(rng.randrange(4))]), i) for i in range(6000)] + [("none", None, 1), ("one", 2.5, 1)]
    df = spark.createDataFrame(rows, "k string, value double, n int").repartition(5)
    names = {"low": 0.025, "p10": 0.1, "half": 0.5, "most": 1.0, "least": 0.0}
    want = sorted(map(repr, df.groupBy("k").agg(F.count("*").alias("size"), *[F.percentile("value", p).alias(c) for c, p in names.items()]).collect()))
    for limit in (10, 800, 10**6):
        found = order_statistics.quantiles(df, ["k"], "value", names, F.count("*").alias("size"), limit=limit).select("k", "size", *names)
        assert sorted(map(repr, found.collect())) == want
    alone = order_statistics.ranged_quantiles(df, ["k"], "value", names).collect()
    assert {r.k for r in alone} == {"hot", "a", "b", None, "one"}


def test_users_of_quantiles_are_alike_on_both_ways(spark):
    rows = [(k, date(2024, 1, 1) + timedelta(i), float((i * i) % 17)) for k, n in (("a", 90), ("b", 7), ("c", 1)) for i in range(n)]
    points = spark.createDataFrame(rows, "k string, day date, value double")
    for f in (baseline.summary, baseline.robust_z):
        assert sorted(map(repr, f(points, ["k"], limit=5).collect())) == sorted(map(repr, f(points, ["k"]).collect()))
    pairs = points.select("k", "day", (F.col("value") - 8).alias("diff"), F.col("value").alias("a"), F.lit(8.0).alias("b"))
    few, many = (association.agreement_summary(pairs, ["k"], limit=n).select("k", F.round("bias", 9), F.round("sd", 9), "median", "q025", "q975") for n in (5, 10**6))
    assert sorted(map(repr, few.collect())) == sorted(map(repr, many.collect()))


@pytest.mark.parametrize("span", [1, 3, 1000])
def test_forward_asof_by_sorting(spark, span):
    rng = random.Random(9)
    at = lambda: datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(3000))
    key = lambda: "hot" if rng.random() < 0.8 else rng.choice(["a", "b"])
    anchors = [(key(), i, at()) for i in range(300)] + [("a", 900, None)]
    events = [(key(), i, at()) for i in range(300)] + [("a", 901, None)]
    found = joins.forward_asof(spark.createDataFrame(anchors, "k string, anchor_id long, ts timestamp"), spark.createDataFrame(events, "k string, event_id long, ts timestamp"), ["k"], 3600, span=span)
    want = []
    for k, i, t in anchors:
        later = [(u, j) for kk, j, u in events if t and u and kk == k and t <= u <= t + timedelta(hours=1)]
        first = [j for u, j in later if u == min(later)[0]]
        if len(first) == 1:
            want.append((k, i, first[0]))
    assert sorted((r.k, r.anchor_id, r.event_id) for r in found.collect()) == sorted(want)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
