"""Hand-derived numbers and seeded comparisons with plain Python."""

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark import functions as fn
from tidemark.operators import association, baseline, clock, coverage, daily, identity, joins, night, payload, period, revision, weight

D0 = dt.date(2026, 1, 1)


def day(n):
    return D0 + dt.timedelta(days=n)


def test_smoothing_of_a_21_day_gap(spark):
    df = spark.createDataFrame([("g", day(0), 80.0), ("g", day(21), 81.0), ("g", day(42), 82.0)], "grp string, day date, value double")
    assert [round(r["trend"], 9) for r in weight.smoothed(df, ["grp"]).orderBy("day").collect()] == [80.0, 80.5, 81.25]


def test_smoothing_equals_the_recursion(spark):
    rng, rows, at = random.Random(1), [], 0
    for _ in range(80):
        at += rng.randint(1, 30)
        rows.append(("g", day(at), rng.uniform(60, 90)))
    got = [r["trend"] for r in weight.smoothed(spark.createDataFrame(rows, "grp string, day date, value double"), ["grp"]).orderBy("day").collect()]
    trend, before = rows[0][2], rows[0][1]
    for (_, d, v), g in zip(rows, got, strict=True):
        trend += (1 - 2 ** (-(d - before).days / 21)) * (v - trend)
        before = d
        assert abs(trend - g) < 1e-9


def test_weekly_rate_gates(spark):
    rows = [("ok", day(7 * i), 80 + 0.1 * i) for i in range(10)] + [("short", day(i), 80.0) for i in range(10)] + [("few", day(20 * i), 80.0) for i in range(3)]
    got = {r["grp"]: r for r in weight.weekly_rate(spark.createDataFrame(rows, "grp string, day date, value double"), ["grp"]).collect()}
    assert round(got["ok"]["per_week"], 9) == 0.1
    assert (got["short"]["per_week"], got["short"]["reason"]) == (None, "too_short_span")
    assert got["few"]["reason"] == "too_few_points"


def test_states_never_fabricate(spark):
    rows = [("a", day(0), "value", 3.0), ("a", day(0), "value", 4.0), ("a", day(1), "null", None), ("a", day(2), "zero", 0.0), ("b", day(0), "invalid", 9.0)]
    p = baseline.series(spark.createDataFrame(rows, "k string, day date, state string, value double"), ["k"])
    assert {(r["k"], r["day"]): (r["status"], r["value"]) for r in p.collect()} == {("a", day(0)): ("ambiguous", None), ("a", day(1)): ("null", None), ("a", day(2)): ("zero", 0.0), ("b", day(0)): ("invalid", None)}
    s = {r["k"]: r for r in baseline.summary(p, ["k"]).collect()}
    assert (s["a"]["n"], s["a"]["mean"], s["b"]["reason"], s["b"]["mean"]) == (1, 0.0, "no_usable_values", None)
    assert baseline.summary(p.limit(0), ["k"]).count() == 0


def test_baseline_against_python(spark):
    rng = random.Random(5)
    rows = [("g", day(i), float(rng.randint(0, 40))) for i in range(60)]
    p = spark.createDataFrame(rows, "k string, day date, value double")
    v = [x for _, _, x in rows]
    r = baseline.latest_position(p, ["k"]).first()
    assert r["percentile"] == pytest.approx(100 * (sum(x < v[-1] for x in v) + 0.5 * sum(x == v[-1] for x in v)) / 60)
    z = baseline.robust_z(p, ["k"]).first()
    med = statistics.median(v)
    mad = statistics.median(abs(x - med) for x in v)
    assert (z["median"], z["mad"]) == (med, mad) and z["z"] == pytest.approx(0.67448975 * (v[-1] - med) / mad)
    t = baseline.theil_sen(p, ["k"]).first()
    assert t["slope"] == pytest.approx(statistics.median((v[j] - v[i]) / (j - i) for i in range(60) for j in range(i + 1, 60)))
    assert baseline.theil_sen(p, ["k"], cap=10).first()["reason"] == "too_many_points"
    flat = p.withColumn("value", F.lit(2.0))
    assert (baseline.robust_z(flat, ["k"]).first()["z"], baseline.robust_z(flat, ["k"]).first()["reason"]) == (None, "zero_deviation")


def test_lagged_spearman_and_its_limits(spark):
    x = spark.createDataFrame([(day(i), float(i % 7)) for i in range(30)], "day date, value double")
    y = spark.createDataFrame([(day(i + 2), float(i % 7)) for i in range(30)], "day date, value double")
    got = {r["lag"]: r for r in association.lagged_spearman(association.one_per_day(x), association.one_per_day(y), [0, 2]).collect()}
    assert got[2]["rho"] == pytest.approx(1.0) and got[2]["pairs"] == 30 and got[0]["y_absent"] == 2
    with pytest.raises(ValueError):
        association.lagged_spearman(x, y, [15])
    flat = association.one_per_day(x.withColumn("value", F.lit(1.0)))
    assert association.lagged_spearman(flat, association.one_per_day(y), [0]).first()["rho"] is None


def test_agreement(spark):
    rows = [("c", day(i), 10.0 + i, 9.0 + i, 1.0 + (i % 3)) for i in range(30)] + [("c", day(0), 0.0, 0.0, 99.0)]
    p = association.agreement_dedup(spark.createDataFrame(rows, "k string, day date, a double, b double, diff double"), ["k"])
    diffs = [1.0 + i % 3 for i in range(1, 30)]
    s = association.agreement_summary(p, ["k"]).first()
    assert s["n"] == 29 and s["bias"] == pytest.approx(statistics.mean(diffs)) and s["loa_high"] == pytest.approx(statistics.mean(diffs) + 1.96 * statistics.stdev(diffs))
    assert association.stability(p, ["k"]).first()["stable"]
    assert association.outlier_sensitivity(p, ["k"]).first()["outliers"] == 0


def test_calendar_operators(spark):
    days = spark.createDataFrame([("a", day(i)) for i in (2, 3, 4, 8, 9, 10)], "k string, day date")
    spans = spark.createDataFrame([("a", day(0), day(11))], "k string, start date, end date")
    assert [(r["gap_start"], r["days"], r["kind"]) for r in coverage.gaps(days, spans, ["k"]).orderBy("gap_start").collect()] == [(day(0), 2, "leading"), (day(5), 3, "internal"), (day(11), 1, "trailing")]
    assert sorted(r["start"] for r in coverage.longest_islands(days, ["k"]).collect()) == [day(2), day(8)]
    assert coverage.missing_days(days, spans, ["k"]).count() == 6
    b = coverage.bins(spans, 7).orderBy("bin_start").collect()
    assert [(r["bin_start"], r["bin_end"]) for r in b] == [(day(0), day(6)), (day(7), day(11))]
    parts = spark.createDataFrame([("x", 0, 5), ("x", 5, 9), ("y", 0, 4), ("y", 5, 9), ("z", 0, 9), ("z", 1, 3)], "k string, interval_start int, interval_end int").withColumns({"start": F.lit(0), "end": F.lit(9)})
    assert {r["k"]: r["complete"] for r in coverage.union_complete(parts, ["k"]).collect()} == {"x": True, "y": False, "z": True}


def test_latest_receipt_tie_divergence_is_ambiguous(spark):
    rows = [("a", 2, "value", 5), ("a", 2, "value", 6), ("b", 1, "value", 3), ("b", 2, "null", None), ("c", 1, "value", 7), ("c", 1, "value", 7)]
    got = {r["k"]: (r["state"], r["value"]) for r in daily.latest_receipt(spark.createDataFrame(rows, "k string, received int, state string, value int"), ["k"]).collect()}
    assert got == {"a": ("ambiguous", None), "b": ("null", None), "c": ("value", 7)}


def test_upsert_never_rolls_back(spark):
    now = spark.createDataFrame([(1, 5, "a"), (2, 5, "b"), (3, 5, "c")], "id int, at int, v string")
    new = spark.createDataFrame([(1, 4, "old"), (2, 6, "b"), (3, 6, "z"), (4, 1, None), (4, 2, "n")], "id int, at int, v string")
    got = {r["id"]: (r["v"], r["action"]) for r in identity.upsert(now, new, "id", ["v"], "at").collect()}
    assert got == {1: ("a", "kept"), 2: ("b", "same"), 3: ("z", "changed"), 4: ("n", "inserted")}
    assert identity.retire_absent(now, new, "id", complete=False).count() == 0
    assert identity.heads(now.select("id"), spark.createDataFrame([(2, 1), (3, None)], "id int, supersedes int")).count() == 2


def test_snapshot_and_diff(spark):
    rows = [("a", day(1), 1), ("a", day(2), 5), ("a", day(2), 7), ("b", day(2), None), ("b", day(2), 3)]
    got = identity.latest_snapshot(spark.createDataFrame(rows, "k string, day date, ts int"), ["k"]).collect()
    assert sorted((r["k"], r["ts"] or 0) for r in got) == [("a", 7), ("b", 0), ("b", 3)]


def test_forward_asof_excludes_ties(spark):
    t = dt.datetime(2026, 1, 1)
    h = lambda n: t + dt.timedelta(hours=n)
    a = spark.createDataFrame([(1, 1, h(0)), (1, 2, h(10)), (1, 3, h(40)), (2, 4, h(0))], "u int, anchor_id int, ts timestamp")
    e = spark.createDataFrame([(1, 10, h(0)), (1, 11, h(12)), (1, 12, h(12)), (1, 13, h(64)), (2, 14, h(25))], "u int, event_id int, ts timestamp")
    assert {r["anchor_id"]: r["event_id"] for r in joins.forward_asof(a, e, ["u"], 24 * 3600).collect()} == {1: 10, 3: 13}


def test_circular_statistics(spark):
    df = spark.createDataFrame([("n", 1430.0), ("n", 10.0), ("o", 0.0), ("o", 720.0)], "k string, minute double")
    got = {r["k"]: r for r in clock.circular(df, ["k"]).collect()}
    assert min(got["n"]["mean"], 1440 - got["n"]["mean"]) == pytest.approx(0, abs=1e-6) and got["n"]["median"] == 0
    assert got["o"]["mean"] is None and got["o"]["reason"] == "undefined_direction"
    r = math.cos(10 * 2 * math.pi / 1440)
    assert got["n"]["sd"] == pytest.approx(math.sqrt(-2 * math.log(r)) * 1440 / (2 * math.pi))


def test_thinning_keeps_ends_and_bounded_reads_give_no_prefix(spark):
    df = spark.createDataFrame([("a", i, 1.0) for i in range(101)] + [("b", i, 1.0) for i in range(5)], "k string, i int, value double")
    got = period.thinned(df.withColumnRenamed("i", "at"), ["k"], 11, "at").where("k = 'a'").orderBy("at").collect()
    assert [r["at"] for r in got] == list(range(0, 101, 10))
    assert {r["k"]: (r["rows"], r["total"], r["status"]) for r in period.bounded(df, 10, ["k"]).collect()} == {"a": (None, None, "search_incomplete"), "b": (5, 5.0, "complete")}


def test_scalar_functions(spark):
    df = spark.createDataFrame([("007", "1.5s", "lb"), ("12", "x", "kg"), ("9223372036854775808", "-3.250s", "st"), ("0", None, None)], "c string, d string, u string")
    rows = df.select(fn.exact_count(F.col("c")).alias("c"), fn.duration_seconds(F.col("d")).cast("double").alias("d"), fn.to_kilograms(F.lit(2.0), F.col("u")).alias("kg")).collect()
    assert [r["c"] for r in rows] == [None, 12, None, 0]
    assert [r["d"] for r in rows] == [1.5, None, -3.25, None]
    assert [r["kg"] for r in rows] == [0.90718474, 2.0, None, None]
    assert spark.range(1).select(fn.signed_circular(F.lit(10.0), F.lit(1430.0)).alias("x")).first()["x"] == 20.0


def test_smoothing_over_many_years(spark):
    """Powers of the age stay in range, however long the series."""
    rows = [("g", dt.date(1950, 1, 1), 80.0), ("g", dt.date(1990, 1, 1), 90.0), ("g", dt.date(1990, 1, 22), 70.0), ("g", dt.date(2015, 1, 1), 60.0), ("g", dt.date(2015, 1, 22), 62.0)]
    got = [r["trend"] for r in weight.smoothed(spark.createDataFrame(rows, "grp string, day date, value double"), ["grp"]).orderBy("day").collect()]
    assert got == pytest.approx([80.0, 90.0, 80.0, 60.0, 61.0])


def test_intervals_overlap_across_buckets(spark):
    t = dt.datetime(2026, 1, 1, 23, 30)
    h = lambda m: t + dt.timedelta(minutes=m)
    rows = [(1, "u", h(0), h(120)), (2, "u", h(60), h(180)), (3, "u", h(120), h(130)), (4, "u", h(119), h(121)), (5, "v", h(0), h(120)), (6, "u", h(-60), h(0))]
    df = spark.createDataFrame(rows, "id int, k string, s timestamp, e timestamp")
    got = sorted((r["left_id"], r["right_id"]) for r in joins.overlapping(df, df, ["k"], 7200).where("left_id < right_id").collect())
    assert got == [(1, 2), (1, 4), (2, 3), (2, 4), (3, 4)]


def test_canonical_selection_ranks_by_revision_and_time_never_by_value(spark):
    base = {"metric": "weight", "semantic_key": "k", "confirmed": True, "current": True, "grp": None, "derived": False, "inputs": 0, "version": None, "revision": 1, "ts": None, "day": day(0), "value": 1.0}
    rows = [base | {"evidence_id": "a", "value": 99.0}, base | {"evidence_id": "b", "revision": 2}, base | {"evidence_id": "c", "revision": 3, "confirmed": False}, base | {"evidence_id": "d", "revision": 4, "derived": True}, base | {"evidence_id": "e", "metric": "body_fat", "grp": "other"}]
    schema = "metric string, semantic_key string, confirmed boolean, current boolean, grp string, derived boolean, inputs int, version string, revision int, ts timestamp, day date, value double, evidence_id string"
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    got = {r["evidence_id"]: r["outcome"] for r in identity.canonical(df, ["body_fat"], "mine", "v1").collect()}
    assert got == {"a": "competing_evidence", "b": "selected", "c": "not_confirmed", "d": "missing_input_evidence", "e": "incompatible_algorithm_group"}


def test_nights_prefer_the_marked_main_session_and_never_guess(spark):
    s = "k string, day date, status string, role string, duration double, id int"
    rows = [("a", day(0), "ok", "main", 8.0, 1), ("a", day(0), "ok", "uncertain", 7.0, 2), ("a", day(1), "ok", "uncertain", 7.0, 3), ("a", day(2), "ok", "uncertain", 7.0, 4), ("a", day(2), "ok", "uncertain", 6.0, 5), ("a", day(3), "ok", "nap", 1.0, 6), ("a", None, "ok", "main", 1.0, 7), ("a", day(4), "retired", "main", 1.0, 8)]
    got = {r["id"]: r["outcome"] for r in night.resolve_nights(spark.createDataFrame(rows, s), ["k"]).collect()}
    assert got == {1: "selected", 2: "not_main", 3: "selected", 4: "ambiguous_night", 5: "ambiguous_night", 6: "nap", 7: "missing_wake_date", 8: "retired"}


def test_payload_states(spark):
    spec = payload.Spec("hr", ("heartRate", "hr.value"), "number", "bpm")
    texts = ['{"heartRate": 0}', '{"heartRate": null, "hr": {"value": 5}}', '{"hr": {"value": 5.5}}', '{"heartRate": true}', '{"heartRate": "5"}', '{"heartRate": {}}', "{}", "nonsense", None]
    got = [(r["state"], r["number"], r["reason"]) for r in payload.normalize(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), ["id"], "t", [spec]).orderBy("id").collect()]
    assert got == [("value", 0.0, None), ("null", None, None), ("value", 5.5, None), ("invalid", None, "boolean_not_numeric"), ("invalid", None, "numeric_string_not_coerced"), ("invalid", None, "shape_drift"), *[("missing", None, None)] * 3]


def test_revisions_follow_the_provider_time(spark):
    now = spark.createDataFrame([(1, 5, 1, "a"), (2, 5, 1, "b"), (3, 5, 1, "c"), (4, None, 1, "d"), (5, 5, 1, "e"), (7, 5, 1, "g")], "id int, updated int, interval int, v string")
    new = spark.createDataFrame([(1, 4, 1, "x"), (2, 6, 2, "y"), (3, 5, 1, "z"), (4, 1, 1, "w"), (5, 5, 2, "v"), (6, None, 1, "n"), (7, None, 1, "q")], "id int, updated int, interval int, v string")
    got = {r["id"]: (r["v"], r["outcome"]) for r in revision.by_provider_time(now, new, "id", ["v"], "unless_moved").collect()}
    assert got == {1: ("a", "kept"), 2: ("y", "revised"), 3: ("z", "revised"), 4: ("w", "revised"), 5: ("e", "kept"), 6: ("n", "inserted"), 7: ("g", "kept")}
    assert {r["id"]: r["outcome"] for r in revision.by_provider_time(now, new, "id", ["v"], "invalid").collect()}[3] == "invalid"
