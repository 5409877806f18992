"""Queries of nights and of what two providers say about them, over events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.operators import coverage, joins, night
from tidemark.operators.payload import session_role
from tidemark.plans import adapters
from tidemark.plans.adapters import M
from tidemark.plans.payloads import _PARTS, measured, stage_parts, token
from tidemark.plans.registry import query, rounded

#: events as sleep sessions: roles, states and durations of every kind.
_S = f"""{M}, s AS (SELECT event_id, user_id, ts, CASE WHEN k % 11 > 0 THEN day END AS day, CASE WHEN k % 13 = 0 THEN 'retired' WHEN k % 13 = 1 THEN 'invalid' ELSE 'current' END AS status,
    CASE k % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'nap' ELSE 'uncertain' END AS role, CASE WHEN k % 17 > 0 THEN (k - 5) * 300.0 END AS duration, k, value FROM m),
  g AS (SELECT *, CASE WHEN day IS NULL THEN 'missing_wake_date' WHEN status = 'retired' THEN 'retired' WHEN status = 'invalid' THEN 'invalid_record' WHEN role = 'nap' THEN 'nap' WHEN duration IS NULL OR duration <= 0 THEN 'invalid_duration' END AS gate FROM s),
  c AS (SELECT *, count(*) FILTER (WHERE gate IS NULL AND role = 'main') OVER (PARTITION BY user_id, day) AS mains, count(*) FILTER (WHERE gate IS NULL) OVER (PARTITION BY user_id, day) AS every FROM g),
  n AS (SELECT *, CASE WHEN gate IS NOT NULL THEN gate WHEN mains > 0 AND role <> 'main' THEN 'not_main' WHEN CASE WHEN mains > 0 THEN mains ELSE every END = 1 THEN 'selected' ELSE 'ambiguous_night' END AS outcome FROM c)"""


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    status = F.when(k % 13 == 0, "retired").when(k % 13 == 1, "invalid").otherwise("current")
    role = F.when(k % 3 == 0, "main").when(k % 3 == 1, "nap").otherwise("uncertain")
    return measured(spark, sf).select("event_id", "user_id", "ts", F.when(k % 11 > 0, F.col("day")).alias("day"), status.alias("status"), role.alias("role"), F.when(k % 17 > 0, (k - 5) * 300.0).alias("duration"), "k", "value")


def nights(spark: SparkSession, sf: str) -> DataFrame:
    return night.resolve_nights(sessions(spark, sf), ["user_id"])


@query(f"WITH {_S} SELECT event_id, outcome FROM n")
def r20_night_resolver(spark, sf):
    return nights(spark, sf).select("event_id", "outcome")


@query(f"""WITH {_S} SELECT user_id, count(*) FILTER (WHERE outcome = 'selected') AS nights, round(avg(duration) FILTER (WHERE outcome = 'selected'), 7) AS mean, count(DISTINCT day) FILTER (WHERE outcome = 'ambiguous_night') AS ambiguous_days,
  count(*) FILTER (WHERE outcome NOT IN ('selected', 'ambiguous_night')) AS excluded FROM n GROUP BY user_id""")
def p4_sleep_reducer(spark, sf):
    is_ = lambda *x: F.col("outcome").isin(*x)
    return rounded(nights(spark, sf).groupBy("user_id").agg(F.count_if(is_("selected")).alias("nights"), F.avg(F.when(is_("selected"), F.col("duration"))).alias("mean"), F.count_distinct(F.when(is_("ambiguous_night"), F.col("day"))).alias("ambiguous_days"), F.count_if(~is_("selected", "ambiguous_night")).alias("excluded")))


@query(f"WITH {_S} SELECT role, outcome, count(*) AS n FROM n GROUP BY ALL")
def z13_session_roles(spark, sf):
    """The role of sessions from two flags, and what became of them."""
    k = F.col("k")
    role = session_role(k % 3 == 0, k % 3 == 1)
    return night.resolve_nights(sessions(spark, sf).withColumn("role", role), ["user_id"]).groupBy("role", "outcome").agg(F.count("*").alias("n"))


@query(f"""WITH {M}, x AS (SELECT event_id, k, event_id % 6 AS c FROM m) SELECT event_id, CASE WHEN c = 0 THEN k * 60 WHEN c = 5 THEN 0 END::BIGINT AS light, CASE WHEN c IN (0, 5) THEN 1800 END::BIGINT AS deep,
  CASE c WHEN 1 THEN 'invalid_item' WHEN 2 THEN 'invalid_item' WHEN 3 THEN 'repeated_type' WHEN 4 THEN 'missing_summary' END AS reason FROM x""")
def z3_summary_stages(spark, sf):
    item = lambda t, minutes: F.struct(F.lit(t).cast("string").alias("type"), minutes.cast("long").alias("minutes"), F.lit(1).alias("count"))
    k, c, deep = F.col("k"), F.col("event_id") % 6, item("DEEP", F.lit(30))
    items = F.when(c == 0, F.array(item("LIGHT", k), deep)).when(c == 1, F.array(item("LIGHT", F.lit(-1)), deep)).when(c == 2, F.array(item(None, k), deep)).when(c == 3, F.array(deep, deep)).when(c == 5, F.array(deep))
    return measured(spark, sf).select("event_id", night.summary_stage_seconds(items, ["LIGHT", "DEEP"]).alias("s")).select("event_id", "s.*")


@query(f"""WITH {_PARTS}, e AS (SELECT user_id, day, min(s) AS a, max(e) AS b FROM parts GROUP BY ALL) SELECT user_id, day, CASE WHEN user_id % 5 = 1 THEN 'start_differs' WHEN user_id % 5 = 2 THEN 'end_differs' WHEN user_id % 5 = 3 AND day(day) % 2 = 0 THEN 'no_stages' ELSE 'match' END AS bounds FROM e""", dates="day")
def z4_stage_bounds(spark, sf):
    parts = stage_parts(spark, sf)
    u = F.col("user_id") % 5
    whole = parts.groupBy("user_id", "day").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"))
    minute = F.expr("interval 1 minute")
    asked = whole.withColumns({"start_ts": F.when(u == 1, F.col("start_ts") - minute).otherwise(F.col("start_ts")), "end_ts": F.when(u == 2, F.col("end_ts") + minute).otherwise(F.col("end_ts"))})
    return night.bounds_match(parts.where((u != 3) | (F.dayofmonth("day") % 2 != 0)), asked, ["user_id", "day"])


@query(f"""WITH {M}, x AS (SELECT event_id, k, event_id % 8 AS c FROM m) SELECT event_id, CASE WHEN c = 0 THEN k * 60 + 60 WHEN c IN (2, 7) AND k < 90 THEN k * 60 END::DOUBLE AS seconds,
  CASE c WHEN 1 THEN 'incomplete_stages' WHEN 3 THEN 'missing_summary' WHEN 4 THEN 'fractional_minutes' WHEN 5 THEN 'unproven_boundary' WHEN 6 THEN 'fractional_minutes' ELSE CASE WHEN c IN (2, 7) AND k >= 90 THEN 'exceeds_session' END END AS reason FROM x""")
def z5_time_in_bed(spark, sf):
    k, c = F.col("k"), F.col("event_id") % 8
    minutes = F.when(c == 3, F.lit(None)).when(c == 4, k + 0.5).when(c == 6, -k - 1).otherwise(k).cast("double")
    t = night.time_in_bed(F.when(c < 2, "stages").otherwise("summary"), (k * 60 + 60).cast("double"), (c != 1) & (c != 5) & (c != 7), minutes, c != 5, F.lit(89.5 * 60))
    return measured(spark, sf).select("event_id", t.alias("t")).select("event_id", "t.*")


@query(f"""WITH {_PARTS}, e AS (SELECT user_id, day, min(s) AS a, max(e) AS b, bool_or(stage IS NULL) AS broken FROM parts GROUP BY ALL) SELECT user_id, day, CASE WHEN user_id % 2 = 0 AND broken THEN NULL ELSE epoch_ms(date_trunc('millisecond', a)) END AS start_ms,
  CASE WHEN user_id % 2 = 0 AND broken THEN NULL ELSE epoch_ms(date_trunc('millisecond', b)) END AS end_ms, CASE WHEN user_id % 2 = 0 AND broken THEN 'unmapped_stage' END AS reason FROM e""", dates="day")
def z6_night_timing(spark, sf):
    """One kind of provider times a night by its valid stages, the other by its session interval."""
    e = stage_parts(spark, sf).groupBy("user_id", "day").agg(F.min("start_ts").alias("a"), F.max("end_ts").alias("b"), F.bool_or(F.col("stage").isNull()).alias("broken"))
    bad = (F.col("user_id") % 2 == 0) & F.col("broken")
    return e.select("user_id", "day", F.when(~bad, F.unix_millis("a")).alias("start_ms"), F.when(~bad, F.unix_millis("b")).alias("end_ms"), F.when(bad, "unmapped_stage").alias("reason"))


@query(f"""WITH {M}, x AS (SELECT event_id, k, event_id % 7 AS c FROM m) SELECT event_id, round(CASE c WHEN 0 THEN k WHEN 1 THEN k * 60 WHEN 2 THEN k / 1000.0 END, 7)::DOUBLE AS value, CASE c WHEN 3 THEN 'unit_mismatch' WHEN 4 THEN 'missing' WHEN 5 THEN 'null' WHEN 6 THEN 'not_finite' END AS reason FROM x""")
def z7_scalar_outcomes(spark, sf):
    c = F.col("event_id") % 7
    value = F.when(c == 6, F.lit(float("inf"))).otherwise(F.col("k").cast("double"))
    out = night.scalar_outcome(token(7, "value", "value", "value", "value", None, "null", "value"), value, token(7, "s", "min", "ms", "h", "s", "s", "s"), {"s": 1.0, "min": 60.0, "ms": 0.001})
    return rounded(measured(spark, sf).select("event_id", out.alias("o")).select("event_id", "o.*"))


@query(f"""WITH {M}, n AS (SELECT DISTINCT user_id, day FROM m), o AS (SELECT user_id, day, count(*) AS n, any_value(value) AS v, any_value(CASE WHEN k % 5 > 0 THEN 'bpm' ELSE 'hz' END) AS u FROM m WHERE event_type = 'view' GROUP BY ALL)
  SELECT n.user_id, n.day, CASE WHEN o.n = 1 AND u = 'bpm' THEN round(v, 7) END AS value, CASE WHEN o.n IS NULL THEN 'missing' WHEN o.n > 1 THEN 'ambiguous' WHEN u <> 'bpm' THEN 'unit_mismatch' END AS reason FROM n LEFT JOIN o ON o.user_id = n.user_id AND o.day = n.day""", dates="day")
def z8_same_day_overlay(spark, sf):
    m = measured(spark, sf)
    others = m.where("event_type = 'view'").select("user_id", "day", "value", F.when(F.col("k") % 5 > 0, "bpm").otherwise("hz").alias("unit"))
    return rounded(night.overlay(m.select("user_id", "day").distinct(), others, ["user_id"], "bpm"))


_TWO = f"""{M}, a AS (SELECT user_id, day, count(*) AS n, max(value) AS v, max(ts) AS t FROM m WHERE event_type = 'click' GROUP BY ALL), b AS (SELECT user_id, day, count(*) AS n, max(value) AS v, max(ts) AS t FROM m WHERE event_type = 'purchase' GROUP BY ALL),
  p AS (SELECT user_id, day, a.v AS av, b.v AS bv, a.t AS att, b.t AS btt FROM a JOIN b USING (user_id, day) WHERE a.n = 1 AND b.n = 1)"""


def _two(spark, sf) -> DataFrame:
    """Days that both providers tell once: the values and instants of either."""
    m = measured(spark, sf)
    one = lambda t, v: m.where(F.col("event_type") == t).groupBy("user_id", "day").agg(F.count("*").alias("n"), F.max("value").alias(f"{v}v"), F.max("ts").alias(f"{v}t")).where("n = 1").drop("n")
    return one("click", "a").join(one("purchase", "b"), ["user_id", "day"])


@query(f"WITH {_TWO} SELECT user_id, day, round(bv - av, 7) AS difference, round((epoch_us(btt) - epoch_us(att)) / 1000000.0, 3) AS seconds FROM p", dates="day")
def z9_provider_differences(spark, sf):
    seconds = (F.unix_micros("bt") - F.unix_micros("at")) / 1_000_000
    return rounded(_two(spark, sf).select("user_id", "day", (F.col("bv") - F.col("av")).alias("difference"), F.round(seconds, 3).alias("seconds")))


_METRICS = ["duration", "rest", "pulse"]
_TEN = f"""{_TWO}, x AS (SELECT user_id, day, av, bv, CASE WHEN user_id % 9 = 0 THEN 'edited' END AS excluded, metric, list_position({_METRICS}, metric) AS i FROM p, (SELECT unnest({_METRICS}) AS metric)),
  y AS (SELECT *, CASE WHEN (user_id + i) % 4 > 0 THEN av * i END AS l, CASE WHEN (user_id + i) % 5 > 0 THEN bv * i END AS r FROM x),
  z AS (SELECT user_id, day, metric, CASE WHEN excluded IS NOT NULL THEN 'excluded' WHEN l IS NULL OR r IS NULL THEN 'unavailable' ELSE 'comparable' END AS status,
    coalesce(excluded, CASE WHEN l IS NULL AND r IS NULL THEN 'both_missing' WHEN l IS NULL THEN 'left_missing' WHEN r IS NULL THEN 'right_missing' END) AS reason, CASE WHEN excluded IS NULL THEN round(r - l, 7) END AS difference FROM y)"""


def _projected(spark, sf) -> DataFrame:
    two = _two(spark, sf)
    pairs = two.select("user_id", "day", F.when(F.col("user_id") % 9 == 0, "edited").alias("excluded"))
    i = F.col("i") + 1
    each = two.select("user_id", "day", "av", "bv", F.posexplode(F.array(*[F.lit(m) for m in _METRICS])).alias("i", "metric"))
    side = lambda s, c, n: each.where((F.col("user_id") + i) % n > 0).select("user_id", "day", "metric", F.lit(s).alias("side"), (F.col(c) * i).alias("value"))
    return night.paired_metrics(pairs, side("left", "av", 4).unionByName(side("right", "bv", 5)), ["user_id", "day"], _METRICS)


@query(f"WITH {_TEN} SELECT * FROM z", dates="day")
def z10_paired_metrics(spark, sf):
    return rounded(_projected(spark, sf))


@query(f"WITH {_TEN} SELECT metric, count(*) FILTER (WHERE status = 'comparable') AS comparable, count(*) FILTER (WHERE status = 'unavailable') AS unavailable, count(*) FILTER (WHERE status = 'excluded') AS excluded FROM z GROUP BY metric")
def z11_projection_coverage(spark, sf):
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return _projected(spark, sf).groupBy("metric").agg(n("comparable"), n("unavailable"), n("excluded"))


@query(f"""WITH {_TEN} SELECT user_id, metric, count(*) AS n, round(avg(difference), 7) AS bias, round(stddev_samp(difference), 6) AS sd FROM z WHERE status = 'comparable' GROUP BY ALL""")
def a10_observations(spark, sf):
    """Comparable pairs as agreement observations, summarised by user and metric."""
    seen = _projected(spark, sf).where("status = 'comparable'")
    return rounded(seen.groupBy("user_id", "metric").agg(F.count("*").alias("n"), F.avg("difference").alias("bias"), F.round(F.stddev_samp("difference"), 6).alias("sd")))


@query(f"WITH {_TEN} SELECT metric, count(*) AS strong FROM z WHERE status = 'comparable' AND user_id % 9 <> 0 AND user_id % 4 <> 1 GROUP BY metric")
def a9_strong_eligible(spark, sf):
    """Observations that count for the strong gate: not edited, verified, and no account cohort."""
    return _projected(spark, sf).where("status = 'comparable' AND user_id % 9 <> 0 AND user_id % 4 <> 1").groupBy("metric").agg(F.count("*").alias("strong"))


@query(f"""WITH {_S}, a AS (SELECT user_id, day, max(value) AS v FROM n WHERE outcome = 'selected' AND user_id % 7 > 0 GROUP BY ALL), b AS (SELECT user_id, day, count(*) AS c, max(value) AS v FROM m WHERE event_type = 'view' GROUP BY ALL)
  SELECT user_id, day, CASE WHEN a.v IS NULL THEN 'left_missing' WHEN b.c IS NULL THEN 'right_missing' WHEN b.c > 1 THEN 'right_ambiguous' ELSE 'paired' END AS outcome FROM a FULL JOIN b USING (user_id, day)""", dates="day")
def z12_eligible_pairing(spark, sf):
    """Resolved nights of eligible sources paired with the other provider's days."""
    left = nights(spark, sf).where("outcome = 'selected' AND user_id % 7 > 0").select("user_id", "day", "value")
    return joins.pair_by_day(left, measured(spark, sf).where("event_type = 'view'"), ["user_id"]).select("user_id", "day", "outcome")


@query(f"""WITH {M}, d AS (SELECT event_id, CASE WHEN event_id % 9 > 0 THEN (k - 3) * 1000.0 END AS s FROM m) SELECT event_id, CASE WHEN s IS NULL THEN 'not_finite' WHEN s < 1 THEN 'too_short' WHEN s > 86400 THEN 'too_long' END AS reason FROM d""")
def z14_duration_quality(spark, sf):
    seconds = F.when(F.col("event_id") % 9 > 0, (F.col("k") - 3) * 1000.0)
    return measured(spark, sf).select("event_id", night.duration_quality(seconds).alias("reason"))


@query("""WITH w AS (SELECT user_id, event_id, hour(ts) * 60.0 + minute(ts) AS m, event_type AS z, lag(event_type) OVER o AS pz, lag(hour(ts) * 60.0 + minute(ts)) OVER o AS pm FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id)),
  c AS (SELECT *, coalesce(z <> pz, false) AS changed FROM w), a AS (SELECT *, coalesce(lag(changed) OVER (PARTITION BY user_id ORDER BY event_id), false) AS after FROM c)
  SELECT user_id, event_id AS seq, CASE WHEN pm IS NOT NULL AND NOT changed AND NOT after THEN (((m - pm + 720) % 1440 + 1440) % 1440 - 720)::DOUBLE END AS shift, CASE WHEN pm IS NULL THEN 'first_night' WHEN changed OR after THEN 'travel' END AS reason FROM a""")
def z17_two_night_jetlag(spark, sf):
    rows = measured(spark, sf).select("user_id", F.col("event_id").alias("seq"), (F.hour("ts") * 60 + F.minute("ts")).cast("double").alias("minute"), F.col("event_type").alias("zone"))
    return night.two_night_jetlag(rows, ["user_id"])


@query(f"""WITH {M}, x AS (SELECT event_id, event_id % 6 AS c, epoch_us(ts) / 60000000.0 AS t FROM m) SELECT event_id, CASE WHEN c IN (0, 1, 3) THEN round((t + CASE c WHEN 0 THEN 540 WHEN 1 THEN 540 ELSE 120 END) % 1440, 6) END AS minute,
  CASE c WHEN 2 THEN 'zone_offset_mismatch' WHEN 4 THEN 'missing_zone' WHEN 5 THEN 'missing_instant' END AS reason FROM x""")
def z20_local_clock(spark, sf):
    instant = F.when(F.col("event_id") % 6 != 5, F.col("ts"))
    t = night.local_clock(instant, token(6, "Asia/Tokyo", "Asia/Tokyo", "Asia/Tokyo", None, None, "UTC"), token(6, "540", None, "60", "120", None, "0").cast("int"))
    return measured(spark, sf).select("event_id", t.alias("t")).select("event_id", "t.*")


@query(f"""WITH {M}, u AS (SELECT DISTINCT user_id FROM m), d AS (SELECT user_id, unnest(generate_series((SELECT min(ts)::DATE FROM events), (SELECT max(ts)::DATE FROM events), INTERVAL 1 DAY))::DATE AS day FROM u), s AS (SELECT DISTINCT user_id, event_type AS source FROM m), p AS (SELECT user_id, event_type AS source, day, max(value) AS v FROM m GROUP BY ALL)
  SELECT d.user_id, s.source, d.day, round(v, 7) AS value, v IS NULL AS gap, count(v) OVER (PARTITION BY d.user_id, d.day) AS present FROM d JOIN s ON s.user_id = d.user_id LEFT JOIN p ON p.user_id = d.user_id AND p.source = s.source AND p.day = d.day""", dates="day")
def r19_source_range(spark, sf):
    m = measured(spark, sf)
    spans = adapters.user_spans(spark, sf)
    points = m.groupBy("user_id", F.col("event_type").alias("source"), "day").agg(F.max("value").alias("value"))
    return rounded(night.source_points(coverage.calendar(spans).select("user_id", "day"), points.select("user_id", "source").distinct(), points, ["user_id"]))


@query(f"""WITH {_S} SELECT user_id, max(day) AS day, arg_max(duration, day)::DOUBLE AS duration FROM n WHERE outcome = 'selected' GROUP BY user_id""", dates="day")
def r16_latest_night(spark, sf):
    return nights(spark, sf).where("outcome = 'selected'").groupBy("user_id").agg(F.max("day").alias("day"), F.max_by("duration", "day").cast("double").alias("duration"))


@query(f"""WITH {_S}, x AS (SELECT user_id, day, duration, lag(day) OVER (PARTITION BY user_id ORDER BY day) AS before FROM n WHERE outcome = 'selected') SELECT user_id, count(*) AS nights, max(day - before)::INT AS longest_step, round(avg(duration), 7) AS mean, min(day) AS first_night, max(day) AS last_night FROM x GROUP BY user_id""", dates="first_night last_night")
def q13_sleep_timeline(spark, sf):
    """Resolved nights of each user: how many, the longest step between them, their mean."""
    x = nights(spark, sf).where("outcome = 'selected'").withColumn("step", F.datediff("day", F.lag("day").over(Window.partitionBy("user_id").orderBy("day"))))
    return rounded(x.groupBy("user_id").agg(F.count("*").alias("nights"), F.max("step").alias("longest_step"), F.avg("duration").alias("mean"), F.min("day").alias("first_night"), F.max("day").alias("last_night")))


@query(f"WITH {_S} SELECT user_id, role, count(*) AS sessions, count(DISTINCT day) AS days FROM s GROUP BY ALL")
def y33_source_inventory(spark, sf):
    return sessions(spark, sf).groupBy("user_id", "role").agg(F.count("*").alias("sessions"), F.count_distinct("day").alias("days"))


@query(f"""WITH {_S} SELECT user_id, day, CASE WHEN count(*) <= 20 THEN count(*) END AS sessions, CASE WHEN count(*) > 20 THEN 'search_incomplete' ELSE 'complete' END AS status, count(*) FILTER (WHERE outcome = 'selected') AS chosen FROM n WHERE day IS NOT NULL GROUP BY ALL""", dates="day")
def y31_single_nights(spark, sf):
    """All sessions of a night, or nothing where it has more than the cap."""
    n = F.count("*")
    return nights(spark, sf).where("day IS NOT NULL").groupBy("user_id", "day").agg(F.when(n <= 20, n).alias("sessions"), F.when(n > 20, "search_incomplete").otherwise("complete").alias("status"), F.count_if(F.col("outcome") == "selected").alias("chosen"))


@query(f"""WITH {_S} SELECT user_id, count(*) FILTER (WHERE outcome = 'selected') AS nights, string_agg(DISTINCT outcome, ',' ORDER BY outcome) AS outcomes, round(sum(duration) FILTER (WHERE outcome = 'selected') / 3600, 6) AS hours FROM n GROUP BY user_id""")
def q6_sleep_evidence(spark, sf):
    chosen = F.col("outcome") == "selected"
    out = nights(spark, sf).groupBy("user_id").agg(F.count_if(chosen).alias("nights"), F.array_join(F.sort_array(F.collect_set("outcome")), ",").alias("outcomes"), (F.sum(F.when(chosen, F.col("duration"))) / 3600).alias("hours"))
    return rounded(out, 6)
