"""Queries whose rules have many branches: weight and composition, selection, gates, freshness, streaks, overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.operators import association, coverage, evidence, identity, joins, period, weight
from tidemark.plans import adapters
from tidemark.plans.adapters import A, C, D, M, P
from tidemark.plans.registry import KEYS, medians, points, query, rounded
from tidemark.session import load


@query(f"""WITH RECURSIVE {D}, o AS (SELECT grp, day, value, row_number() OVER (PARTITION BY grp ORDER BY day) AS n, date_diff('day', lag(day) OVER (PARTITION BY grp ORDER BY day), day) AS gap FROM d),
  t(grp, n, day, value, trend) AS (SELECT grp, n, day, value, value FROM o WHERE n = 1
    UNION ALL SELECT o.grp, o.n, o.day, o.value, t.trend + (1 - pow(2::DOUBLE, -o.gap / 21.0)) * (o.value - t.trend) FROM t JOIN o ON o.grp = t.grp AND o.n = t.n + 1)
  SELECT grp, day, round(value, 7) AS value, round(trend, 7) AS trend FROM t""", dates="day")
def w3_time_aware_ewma(spark, sf):
    return rounded(weight.smoothed(medians(spark, sf), ["grp"]))


# ---- composition ---------------------------------------------------------------------------


def composition_points(spark: SparkSession, sf: str) -> DataFrame:
    """orders as sessions of an algorithm group with weight, body fat and muscle, some of them absent or out of bounds."""
    k = F.col("o_orderkey")
    return load(spark, sf, "orders").select(
        k.alias("session"), F.to_date("o_orderdate").alias("day"), F.when(k % 9 > 0, F.col("o_orderpriority")).alias("grp"), F.when(k % 10 > 0, F.col("o_totalprice") / 1000).alias("weight"),
        F.when(k % 7 > 0, (k % 110).cast("double")).alias("body_fat"), (F.col("o_custkey") % 50).cast("double").alias("muscle"),
    )


_POINTS = """p AS (SELECT o_orderkey AS session, o_orderdate::DATE AS day, CASE WHEN o_orderkey % 9 > 0 THEN o_orderpriority END AS grp, CASE WHEN o_orderkey % 10 > 0 THEN o_totalprice / 1000 END AS weight,
    CASE WHEN o_orderkey % 7 > 0 THEN (o_orderkey % 110)::DOUBLE END AS body_fat, (o_custkey % 50)::DOUBLE AS muscle FROM orders)"""
_LATEST = _POINTS + """, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY day DESC, session DESC) AS n FROM p WHERE grp IS NOT NULL AND weight IS NOT NULL AND body_fat IS NOT NULL) WHERE n = 1),
  c AS (SELECT p.grp, p.session, p.day, p.weight, l.day AS later_day, l.weight AS later_weight, date_diff('day', p.day, l.day)::INT AS apart, abs(l.weight - p.weight) / p.weight AS ratio,
    CASE WHEN p.weight IS NULL THEN 'missing_weight' WHEN p.weight <= 0 THEN 'invalid_weight_value' WHEN p.body_fat IS NULL THEN 'missing_composition_evidence' WHEN l.day - p.day < 28 THEN 'insufficient_gap'
      WHEN abs(l.weight - p.weight) > 0.01 * p.weight THEN 'weight_diff_exceeds_threshold' END AS reason FROM p JOIN l USING (grp) WHERE p.day < l.day)"""


@query(f"""WITH {_POINTS} SELECT grp, day, session, round(weight, 7) AS weight, body_fat, CASE WHEN weight > 0 AND body_fat > 0 AND body_fat < 100 THEN round(weight * body_fat / 100, 7) END AS fat_mass,
  CASE WHEN weight > 0 AND body_fat > 0 AND body_fat < 100 THEN round(weight - weight * body_fat / 100, 7) END AS lean_mass, muscle FROM p WHERE grp IS NOT NULL""", dates="day")
def w6_composition_series(spark, sf):
    return rounded(weight.composition_series(composition_points(spark, sf)))


@query(f"WITH {_LATEST} SELECT grp, session, day, round(weight, 7) AS weight, later_day, apart AS days_apart, round(ratio, 6) AS ratio, reason FROM c", dates="day later_day")
def w7_similar_weight_reasons(spark, sf):
    found = weight.against_latest(composition_points(spark, sf))
    return rounded(found.select("grp", "session", "earlier.day", "earlier.weight", F.col("later.day").alias("later_day"), "days_apart", F.round("ratio", 6).alias("ratio"), "reason"))


@query(f"""WITH {_LATEST} SELECT grp, session, day, round(weight, 7) AS value, later_day AS latest_day, round(later_weight, 7) AS latest_value, apart AS days_apart
  FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY apart DESC, session) AS n FROM c WHERE reason IS NULL) WHERE n = 1""", dates="day latest_day")
def w8_similar_weight(spark, sf):
    best = weight.similar_pair(composition_points(spark, sf))
    return rounded(best.select("grp", "session", "earlier.day", F.col("earlier.weight").alias("value"), F.col("later.day").alias("latest_day"), F.col("later.weight").alias("latest_value"), "days_apart"))


@query(f"WITH {_LATEST} SELECT grp, session, day, round(weight, 7) AS weight, body_fat FROM l", dates="day")
def w9_latest_composition(spark, sf):
    return rounded(weight.latest_composition(composition_points(spark, sf)).select("grp", "later.session", "later.day", "later.weight", "later.body_fat"))


@query(f"WITH {_LATEST} SELECT grp, count(*) AS earlier_points, count(*) FILTER (WHERE reason IS NULL) AS comparable, round(min(ratio) FILTER (WHERE reason IS NULL), 6) AS nearest FROM c GROUP BY grp")
def j15_points_against_latest(spark, sf):
    ok = F.col("reason").isNull()
    found = weight.against_latest(composition_points(spark, sf)).groupBy("grp").agg(F.count("*").alias("earlier_points"), F.count_if(ok).alias("comparable"), F.min(F.when(ok, F.col("ratio"))).alias("nearest"))
    return rounded(found, 6)


_PAIRS = """v AS (SELECT l_orderkey AS o, l_linenumber AS n, max(l_quantity) AS q, max(l_discount) AS d, max(l_shipdate)::DATE AS day FROM lineitem GROUP BY ALL),
  a AS (SELECT o, n, o * 7 + n AS h, q - 3 AS value, day FROM v WHERE n % 2 = 1), b AS (SELECT o, n - 1 AS n, o * 7 + n - 1 AS h, d * 1200 AS value, day FROM v WHERE n % 2 = 0),
  j AS (SELECT coalesce(a.o, b.o) AS o, coalesce(a.n, b.n) AS n, a.h AS ah, b.h AS bh, coalesce(a.h, b.h) AS h, a.value AS w, b.value AS f FROM a FULL JOIN b ON a.o = b.o AND a.n = b.n),
  r AS (SELECT *, CASE WHEN ah IS NULL THEN 'missing_weight' WHEN bh IS NULL THEN 'missing_body_fat' WHEN h % 23 = 0 THEN 'invalid_weight_metric' WHEN h % 19 = 0 THEN 'source_muscle_not_lean' WHEN h % 17 = 0 THEN 'invalid_body_fat_metric'
    WHEN h % 13 = 0 THEN 'missing_session' WHEN h % 11 = 0 THEN 'cross_session' WHEN h % 29 = 0 THEN 'conflicting_observed_date' WHEN h % 7 = 3 THEN 'invalid_unit' WHEN h % 5 = 2 THEN 'missing_compatibility_group'
    WHEN w <= 0 THEN 'invalid_weight_value' WHEN f <= 0 OR f >= 100 THEN 'invalid_body_fat_value' END AS reason FROM j)"""


@query(f"""WITH {_PAIRS} SELECT o AS session, n, CASE WHEN reason IS NULL THEN round(w * f / 100, 6) END AS fat_mass, CASE WHEN reason IS NULL THEN round(w - w * f / 100, 6) END AS lean_mass, reason FROM r""")
def w5_composition(spark, sf):
    """Odd lines of an order are weights, the even ones after them body fats, with faults of every kind among them."""
    lines = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n")).agg(F.max("l_quantity").alias("q"), F.max("l_discount").alias("d"), F.to_date(F.max("l_shipdate")).alias("day"))
    first = F.col("n") - (F.col("n") + 1) % 2
    h = F.col("o") * 7 + first

    def side(odd: bool, name: str) -> DataFrame:
        metric = F.when(h % 23 == 0, "height").otherwise("weight") if odd else F.when(h % 19 == 0, "muscle_mass").when(h % 17 == 0, "water").otherwise("body_fat")
        session = F.when(h % 13 != 0, F.col("o") + (F.lit(0) if odd else F.when(h % 11 == 0, 1).otherwise(0)))
        day = F.lit("2024-01-01").cast("date") if odd else F.date_add(F.lit("2024-01-01").cast("date"), F.when(h % 29 == 0, 1).otherwise(0))
        unit = F.when(h % 7 == 3, "lb").otherwise("kg") if odd else F.lit("percent")
        value = F.col("q") - 3 if odd else F.col("d") * 1200
        made = F.struct(metric.alias("metric"), session.alias("session"), day.alias("day"), unit.alias("unit"), F.when(h % 5 != 2, F.lit("g")).alias("grp"), value.alias("value"))
        return lines.where(F.col("n") % 2 == int(odd)).select("o", first.alias("n"), made.alias(name))

    pairs = side(True, "w").join(side(False, "f"), ["o", "n"], "full_outer")
    return rounded(weight.composition(pairs).select(F.col("o").alias("session"), "n", "fat_mass", "lean_mass", "reason"), 6)


@query("""SELECT l_orderkey AS session, """ + ", ".join(f'max(CASE WHEN l_linenumber = {i} THEN l_quantity END) AS "{i}"' for i in range(1, 8)) + """ FROM lineitem GROUP BY 1""")
def w11_session_pivot(spark, sf):
    return load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("session")).pivot("l_linenumber", list(range(1, 8))).agg(F.max("l_quantity"))


# ---- association and gates -----------------------------------------------------------------


@query("""WITH d AS (SELECT ts::DATE AS day, event_type AS t, avg(value) AS v FROM events GROUP BY 1, 2),
  g AS (SELECT x.t AS x_type, yt.t AS y_type, lag, x.v AS xv, y.v AS yv FROM d x CROSS JOIN (SELECT unnest(range(0, 15)) AS lag) JOIN (SELECT DISTINCT t FROM d) yt ON yt.t <> x.t LEFT JOIN d y ON y.t = yt.t AND y.day = x.day + lag::INT),
  r AS (SELECT x_type, y_type, lag, rank() OVER (PARTITION BY x_type, y_type, lag ORDER BY xv) + (count(*) OVER (PARTITION BY x_type, y_type, lag, xv) - 1) / 2.0 AS rx,
        rank() OVER (PARTITION BY x_type, y_type, lag ORDER BY yv) + (count(*) OVER (PARTITION BY x_type, y_type, lag, yv) - 1) / 2.0 AS ry FROM g WHERE yv IS NOT NULL),
  c AS (SELECT x_type, y_type, lag, count(*) AS pairs, CASE WHEN count(DISTINCT rx) > 1 AND count(DISTINCT ry) > 1 THEN corr(rx, ry) END AS rho FROM r GROUP BY ALL)
  SELECT g.x_type, g.y_type, g.lag::INT AS lag, coalesce(any_value(pairs), 0) AS pairs, 0::BIGINT AS x_ambiguous, count(*) FILTER (WHERE yv IS NULL) AS y_absent, 0::BIGINT AS y_ambiguous,
  CASE WHEN any_value(pairs) >= 5 THEN round(any_value(rho), 7) END AS rho FROM g LEFT JOIN c ON c.lag = g.lag AND c.x_type = g.x_type AND c.y_type = g.y_type GROUP BY g.x_type, g.y_type, g.lag""")
def l4_lagged_spearman(spark, sf):
    """Every ordered pair of event types, of which there may be 64."""
    daily = adapters.measurements(spark, sf).groupBy("event_type", "day").agg(F.avg("value").alias("value"))
    one = association.one_per_day(daily, ["event_type"])
    types = [r["event_type"] for r in one.select("event_type").distinct().limit(65).collect()]
    if len(types) > 64:
        raise ValueError("more than 64 types make too many pairs")
    other = lambda own: F.explode(F.array_except(F.array(*[F.lit(t) for t in types]).cast("array<string>"), F.array(F.col(own))))
    x = one.withColumnRenamed("event_type", "x_type").withColumn("y_type", other("x_type"))
    y = one.withColumnRenamed("event_type", "y_type").withColumn("x_type", other("y_type"))
    return rounded(association.lagged_spearman(x, y, list(range(15)), keys=["x_type", "y_type"]))


_GATE = f"""{A}, q AS (SELECT cohort, year(day) * 4 + quarter(day) AS q, count(*) AS n, count(*) FILTER (WHERE day(day) % 10 <> 0) AS strong_n, (date_diff('day', min(day), max(day)))::INT AS span_days FROM x GROUP BY ALL),
  g AS (SELECT *, CASE q % 5 WHEN 0 THEN 'account' WHEN 1 THEN 'same_source' ELSE 'device_pair' END AS kind, q % 7 > 0 AS canonical, q % 11 = 0 AS method_break, CASE WHEN q % 3 > 0 THEN q % 2 = 0 END AS stable FROM q),
  s AS (SELECT *, CASE WHEN kind = 'account' THEN 'exploratory_only_cohort' WHEN NOT canonical THEN 'non_canonical_metric' WHEN strong_n < 42 THEN 'insufficient_n' WHEN kind <> 'device_pair' THEN 'not_device_pair'
    WHEN span_days < 41 THEN 'insufficient_span' WHEN method_break THEN 'known_method_break' WHEN stable IS NULL THEN 'stability_missing' WHEN NOT stable THEN 'stability_failed' ELSE 'eligible_for_provisional_proposal' END AS provisional FROM g)"""


@query(f"""WITH {_GATE} SELECT cohort, q::INT AS q, n, strong_n, span_days, CASE WHEN n < 14 THEN 'insufficient_n' ELSE 'exploratory' END AS exploratory, provisional, provisional = 'eligible_for_provisional_proposal' AS eligible,
  concat_ws(',', CASE WHEN n < 14 THEN 'exploratory_n_below_14' END, CASE provisional WHEN 'exploratory_only_cohort' THEN 'account_observations_never_canonical' WHEN 'non_canonical_metric' THEN 'metric_not_canonical_candidate'
    WHEN 'insufficient_n' THEN CASE WHEN n < 42 THEN 'provisional_n_below_42' ELSE 'strong_gate_n_below_42' END WHEN 'not_device_pair' THEN 'provisional_requires_device_pair' WHEN 'insufficient_span' THEN 'provisional_span_delta_below_41_days'
    WHEN 'known_method_break' THEN 'known_method_break' WHEN 'stability_missing' THEN 'stability_packet_missing' WHEN 'stability_failed' THEN 'stability_failed' END) AS reasons FROM s""")
def a7_gate(spark, sf):
    """A gate for each cohort and quarter."""
    x = adapters.paired(spark, sf)
    q = (F.year("day") * 4 + F.quarter("day")).cast("int")
    facts = x.groupBy(F.col("cohort").alias("grp"), q.alias("q")).agg(F.count("*").alias("n"), F.count_if(F.dayofmonth("day") % 10 != 0).alias("strong_n"), F.datediff(F.max("day"), F.min("day")).alias("span_days"))
    m = F.col("q")
    facts = facts.withColumns({"cohort": F.when(m % 5 == 0, "account").when(m % 5 == 1, "same_source").otherwise("device_pair"), "canonical": m % 7 > 0, "method_break": m % 11 == 0, "stable": F.when(m % 3 > 0, m % 2 == 0)})
    return association.gate(facts).select(F.col("grp").alias("cohort"), "q", "n", "strong_n", "span_days", "exploratory", "provisional", "eligible", "reasons")


# ---- selection and freshness ---------------------------------------------------------------


@query("""WITH c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'body_fat' ELSE 'weight' END AS metric, o_custkey AS key, o_orderstatus <> 'P' AS confirmed, o_orderkey % 11 > 0 AS cur, CASE WHEN o_orderkey % 8 = 0 THEN NULL WHEN o_orderkey % 8 = 1 THEN 'b' ELSE 'a' END AS grp,
    o_orderkey % 5 = 0 AS derived, (o_orderkey % 4)::INT AS inputs, CASE WHEN o_orderkey % 15 = 0 THEN 'v0' ELSE 'v1' END AS version, o_orderkey % 2 AS revision, CASE WHEN o_orderkey % 6 > 0 THEN o_orderdate END AS ts, CASE WHEN o_orderkey % 7 > 0 THEN o_orderdate::DATE END AS day FROM orders),
  r AS (SELECT *, CASE WHEN NOT confirmed THEN 'not_confirmed' WHEN NOT cur THEN 'superseded' WHEN metric = 'body_fat' AND grp IS DISTINCT FROM 'a' THEN 'incompatible_algorithm_group' WHEN derived AND inputs = 0 THEN 'missing_input_evidence' WHEN derived AND version <> 'v1' THEN 'derivation_version_mismatch' END AS reason FROM c),
  w AS (SELECT metric, key, max(struct_pack(a := revision, b := coalesce(ts, TIMESTAMP '0001-01-01'), c := coalesce(day, DATE '0001-01-01'), d := CASE WHEN derived THEN 0 ELSE 1 END, e := id::VARCHAR)).e AS best FROM r WHERE reason IS NULL GROUP BY ALL)
  SELECT id, coalesce(reason, CASE WHEN id::VARCHAR = best THEN 'selected' ELSE 'competing_evidence' END) AS outcome FROM r LEFT JOIN w ON w.metric = r.metric AND w.key = r.key""")
def h1_canonical_selection(spark, sf):
    k = F.col("o_orderkey")
    rows = load(spark, sf, "orders").select(
        k.alias("id"), F.when(k % 3 == 0, "body_fat").otherwise("weight").alias("metric"), F.col("o_custkey").alias("semantic_key"), (F.col("o_orderstatus") != "P").alias("confirmed"), (k % 11 > 0).alias("current"),
        F.when(k % 8 == 1, "b").when(k % 8 > 1, "a").alias("grp"), (k % 5 == 0).alias("derived"), (k % 4).alias("inputs"), F.when(k % 15 == 0, "v0").otherwise("v1").alias("version"), (k % 2).alias("revision"),
        F.when(k % 6 > 0, F.col("o_orderdate")).alias("ts"), F.when(k % 7 > 0, F.to_date("o_orderdate")).alias("day"), k.cast("string").alias("evidence_id"),
    )
    return identity.canonical(rows, ["body_fat", "muscle_mass"], "a", "v1").select("id", "outcome")


def _pick(n: Column, *values: str | None) -> Column:
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        if v is not None:
            out = F.when(n % len(values) == i, F.lit(v)).otherwise(out)
    return out


_SCOPES = """b AS (SELECT user_id, event_type, user_id * 5 + list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) AS n, date_trunc('second', max(ts)) AS last, date_trunc('second', max(ts) FILTER (WHERE value > 100)) AS good FROM events GROUP BY ALL),
  f AS (SELECT *, n % 17 > 0 AS requested, n % 19 = 0 AS disabled, ['daily', 'daily', 'activity', 'daily', 'weight'][n % 5 + 1] AS family, CASE WHEN n % 4 = 0 THEN 'optional' ELSE 'required' END AS role, last AS attempt, CASE WHEN n % 6 > 0 THEN good END AS success,
    ['succeeded', 'failed', 'partial', 'succeeded', 'reauth_required', 'required_stream_unavailable', NULL][n % 7 + 1] AS terminal, CASE WHEN n % 3 > 0 THEN last - INTERVAL 1 DAY * (n % 8) END AS evidence_at, CASE WHEN n % 3 = 0 OR n % 31 = 1 THEN (last - INTERVAL 1 DAY * (n % 5))::DATE END AS evidence_day,
    CASE WHEN n % 23 = 0 THEN 'invalid_chronology' WHEN n % 23 = 1 THEN 'chronology_unresolved' END AS issue, n % 29 > 0 AS attributed, CASE WHEN n % 3 > 0 THEN 'complete' ELSE 'partial' END AS coverage, CASE WHEN n % 13 > 0 THEN n % 6 - 1 END AS activities, n % 2 = 0 AS once, n % 10 = 4 AS cw FROM b),
  c AS (SELECT *, TIMESTAMP '2024-01-30 12:00:00' AS now, attempt IS NOT NULL AND (success IS NULL OR attempt > success) AS since FROM f),
  z AS (SELECT *, since AND terminal IN ('failed', 'reauth_required', 'required_stream_unavailable') AS dead, now - success > INTERVAL 48 HOURS AS overdue, epoch(now - evidence_at) / 3600 AS hours, date_diff('day', evidence_day, now::DATE) AS days FROM c),
  sr AS (SELECT user_id, event_type, role, CASE
    WHEN disabled THEN 'not_requested/disabled' WHEN NOT requested THEN 'not_requested/not_requested' WHEN attempt > now OR success > now THEN 'unknown/future_chronology'
    WHEN dead THEN 'unavailable/' || CASE terminal WHEN 'failed' THEN 'refresh_failed' ELSE terminal END WHEN evidence_at > now OR evidence_day > now::DATE THEN 'unknown/future_chronology' WHEN issue IS NOT NULL THEN 'unknown/' || issue
    WHEN NOT attributed THEN 'unknown/scope_unresolved' WHEN since AND terminal = 'partial' THEN 'unknown/acquisition_incomplete' WHEN since AND success IS NOT NULL AND terminal = 'succeeded' THEN 'unknown/chronology_unresolved'
    WHEN family = 'weight' THEN CASE WHEN cw THEN 'quiet/voluntary_sampling' ELSE 'unknown/never_observed' END
    WHEN family = 'activity' THEN CASE WHEN success IS NULL THEN CASE WHEN coverage <> 'complete' THEN 'unknown/coverage_unknown' ELSE 'unknown/chronology_unresolved' END WHEN overdue THEN 'stale/refresh_overdue'
      WHEN coverage <> 'complete' OR activities IS NULL THEN 'unknown/coverage_unknown' WHEN activities < 0 THEN 'unknown/invalid_chronology' WHEN activities > 0 THEN 'fresh/evidence_current' ELSE 'quiet/event_window_confirmed_empty' END
    WHEN role = 'optional' AND NOT once THEN 'unknown/never_observed' WHEN success IS NULL THEN CASE WHEN once THEN 'unknown/chronology_unresolved' ELSE 'unknown/never_observed' END
    WHEN evidence_at IS NULL AND evidence_day IS NULL THEN 'unknown/never_observed' WHEN evidence_at IS NOT NULL AND evidence_day IS NOT NULL THEN 'unknown/chronology_unresolved' WHEN overdue THEN 'stale/refresh_overdue'
    WHEN hours <= 36 OR days <= 1 THEN 'fresh/evidence_current' WHEN hours <= 72 OR days = 2 THEN 'quiet/evidence_within_grace' ELSE 'stale/expected_evidence_absent' END AS sr FROM z),
  s AS (SELECT user_id, event_type, role, split_part(sr, '/', 1) AS state, split_part(sr, '/', 2) AS reason FROM sr)"""


def scopes(spark: SparkSession, sf: str) -> DataFrame:
    """Acquisition facts of every user and event type, with faults of every kind among them."""
    types = F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")])
    second = lambda c: F.date_trunc("second", c).cast("timestamp")
    base = load(spark, sf, "events").groupBy(*KEYS).agg(second(F.max("ts")).alias("last"), second(F.max(F.when(F.col("value") > 100, F.col("ts")))).alias("good"))
    n = F.col("n")
    back = lambda days: F.timestamp_seconds(F.unix_seconds("last") - days * 86400)
    return base.withColumn("n", F.col("user_id") * 5 + F.array_position(types, F.col("event_type"))).select(
        *KEYS, (n % 17 > 0).alias("requested"), (n % 19 == 0).alias("disabled"), _pick(n, "daily", "daily", "activity", "daily", "weight").alias("family"), F.when(n % 4 == 0, "optional").otherwise("required").alias("role"),
        F.col("last").alias("attempt"), F.when(n % 6 > 0, F.col("good")).alias("success"), _pick(n, "succeeded", "failed", "partial", "succeeded", "reauth_required", "required_stream_unavailable", None).alias("terminal"),
        F.when(n % 3 > 0, back(n % 8)).alias("evidence_at"), F.when((n % 3 == 0) | (n % 31 == 1), F.to_date(back(n % 5))).alias("evidence_day"), F.when(n % 23 == 0, "invalid_chronology").when(n % 23 == 1, "chronology_unresolved").alias("chronology_issue"),
        (n % 29 > 0).alias("attributed"), F.when(n % 3 > 0, "complete").otherwise("partial").alias("coverage"), F.when(n % 13 > 0, n % 6 - 1).alias("activities"), (n % 2 == 0).alias("observed_once"), (n % 10 == 4).alias("confirmed_weight"),
    )


@query(f"WITH {_SCOPES} SELECT user_id, event_type, role, state, reason, role = 'required' AND state IN ('stale', 'unavailable', 'unknown') AS actionable FROM s")
def f1_freshness_ladder(spark, sf):
    return period.freshness_state(scopes(spark, sf), "2024-01-30 12:00:00").select(*KEYS, "role", "state", "reason", "actionable")


@query(f"""WITH {_SCOPES}, a AS (SELECT user_id, count(*) AS scopes, count(*) FILTER (WHERE role = 'required' AND state IN ('stale', 'unavailable', 'unknown')) AS actionable, count(*) FILTER (WHERE role = 'required') AS req,
    min(list_position(['unavailable', 'stale', 'unknown', 'quiet', 'fresh'], state)) FILTER (WHERE role = 'required' AND state <> 'not_requested') AS worst FROM s GROUP BY user_id)
  SELECT user_id, CASE WHEN req = 0 THEN 'unknown' WHEN worst IS NULL THEN 'not_requested' ELSE ['unavailable', 'stale', 'unknown', 'quiet', 'fresh'][worst] END AS state, scopes, actionable FROM a""")
def f3_freshness_roll_up(spark, sf):
    return period.roll_up(period.freshness_state(scopes(spark, sf), "2024-01-30 12:00:00"), ["user_id"])


@query(f"""WITH {_SCOPES} SELECT user_id, count(*) FILTER (WHERE state = 'fresh') AS fresh, count(*) FILTER (WHERE state = 'quiet') AS quiet, count(*) FILTER (WHERE state IN ('stale', 'unavailable', 'unknown')) AS needs_action,
  string_agg(event_type || ':' || reason, ',' ORDER BY event_type) FILTER (WHERE role = 'required' AND state IN ('stale', 'unavailable', 'unknown')) AS reasons FROM s WHERE state <> 'not_requested' GROUP BY user_id""")
def f4_consumer_projection(spark, sf):
    """What a reader of freshness is shown: counts by state and the reasons that ask for action."""
    s = period.freshness_state(scopes(spark, sf), "2024-01-30 12:00:00").where("state <> 'not_requested'")
    why = F.array_sort(F.collect_list(F.when(F.col("actionable"), F.concat_ws(":", "event_type", "reason"))))
    is_ = lambda *x: F.count_if(F.col("state").isin(*x))
    return s.groupBy("user_id").agg(is_("fresh").alias("fresh"), is_("quiet").alias("quiet"), is_("stale", "unavailable", "unknown").alias("needs_action"), F.when(F.size(why) > 0, F.array_join(why, ",")).alias("reasons"))


# ---- days, streaks, gaps, overlaps, sets -----------------------------------------------------


@query("""WITH v AS (SELECT user_id, ts::DATE AS day, sum((value * 100)::BIGINT) AS steps FROM events GROUP BY 1, 2), d AS (SELECT * FROM v WHERE steps >= 10000), i AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day)::INT AS run FROM d),
  r AS (SELECT user_id, min(day) AS s, max(day) AS e, count(*) AS days FROM i GROUP BY user_id, run), t AS (SELECT *, max(days) OVER (PARTITION BY user_id) AS most FROM r)
  SELECT user_id, s AS start, e AS "end", days FROM t WHERE days = most""", dates="start end")
def r8_longest_streaks(spark, sf):
    steps = adapters.measurements(spark, sf).groupBy("user_id", "day").agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("steps"))
    return coverage.longest_islands(steps, ["user_id"], "steps", 10000)


@query(f"""WITH {C}, e AS (SELECT DISTINCT cust, day FROM o UNION ALL SELECT cust, DATE '1994-12-31' FROM spans UNION ALL SELECT cust, DATE '2002-01-01' FROM spans),
  g AS (SELECT *, lead(day) OVER w AS nxt, row_number() OVER w AS n, count(*) OVER (PARTITION BY cust) AS c FROM e WINDOW w AS (PARTITION BY cust ORDER BY day))
  SELECT cust, (day + 1)::DATE AS gap_start, (nxt - 1)::DATE AS gap_end, (date_diff('day', day, nxt) - 1)::INT AS days,
  CASE WHEN n = 1 THEN 'leading' WHEN n = c - 1 THEN 'trailing' ELSE 'internal' END AS kind FROM g WHERE date_diff('day', day, nxt) > 1""", dates="gap_start gap_end")
def a5_gaps(spark, sf):
    spans = adapters.customer_spans(spark, sf).select("cust", F.lit("1995-01-01").cast("date").alias("start"), F.lit("2001-12-31").cast("date").alias("end"))
    return coverage.gaps(adapters.customer_days(spark, sf), spans, ["cust"])


@query("""SELECT a.event_id AS left_id, b.event_id AS right_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.event_id < b.event_id
  WHERE b.ts < a.ts + INTERVAL 2 HOURS AND a.ts < b.ts + INTERVAL 2 HOURS""")
def y16_overlapping_intervals(spark, sf):
    e = load(spark, sf, "events").select(*KEYS, F.col("event_id").alias("id"), F.col("ts").alias("s"), (F.col("ts") + F.expr("interval 2 hours")).alias("e"))
    return joins.overlapping(e, e, KEYS, 7200).where("left_id < right_id").select("left_id", "right_id")


@query("""WITH r AS (SELECT user_id, ts::DATE AS day, count(*) FILTER (WHERE event_type = 'click') AS na, count(*) FILTER (WHERE event_type = 'view') AS nb, max(value) FILTER (WHERE event_type = 'click') AS a, max(value) FILTER (WHERE event_type = 'view') AS b FROM events GROUP BY 1, 2)
  SELECT user_id, day, CASE WHEN na = 0 THEN 'left_missing' WHEN nb = 0 THEN 'right_missing' WHEN na > 1 AND nb > 1 THEN 'both_ambiguous' WHEN na > 1 THEN 'left_ambiguous' WHEN nb > 1 THEN 'right_ambiguous' ELSE 'paired' END AS outcome,
  CASE WHEN na = 1 AND nb = 1 THEN round(a, 7) END AS a, CASE WHEN na = 1 AND nb = 1 THEN round(b, 7) END AS b FROM r WHERE na > 0 OR nb > 0""", dates="day")
def j8_cohort_pairing(spark, sf):
    m = adapters.measurements(spark, sf).select("user_id", "day", "value", "event_type")
    return rounded(joins.pair_by_day(m.where("event_type = 'click'"), m.where("event_type = 'view'"), ["user_id"]))


@query(f"""WITH {P}, c AS (SELECT user_id, day, event_type, count(value) AS eligible, count(*) FILTER (WHERE status = 'ambiguous') AS ambiguous FROM p GROUP BY ALL),
  a AS (SELECT user_id, day, count(*) FILTER (WHERE eligible > 0 OR ambiguous > 0) AS competing, count(*) FILTER (WHERE eligible > 0) AS able, arg_max(event_type, eligible) AS s FROM c GROUP BY ALL)
  SELECT user_id, day, CASE WHEN competing = 1 AND able = 1 THEN s END AS source, CASE WHEN competing = 0 THEN 'no_source' WHEN competing > 1 THEN 'several_sources' WHEN able = 0 THEN 'only_ambiguous' END AS reason FROM a""", dates="day")
def p8_source_selection(spark, sf):
    cells = points(spark, sf).groupBy("user_id", "day", F.col("event_type").alias("source")).agg(F.count("value").alias("eligible"), F.count_if(F.col("status") == "ambiguous").alias("ambiguous"))
    return period.unique_source(cells, ["user_id", "day"])


@query(f"""WITH {M}, c AS (SELECT user_id, day, avg(value) FILTER (WHERE event_type = 'click') AS l, avg(value) FILTER (WHERE event_type = 'purchase') AS r FROM m GROUP BY ALL)
  SELECT user_id, day, round(r - l, 7) AS delta, CASE WHEN l IS NULL THEN 'left_unavailable' WHEN r IS NULL THEN 'right_unavailable' END AS reason FROM c WHERE l IS NOT NULL OR r IS NOT NULL""", dates="day")
def p5_signed_delta(spark, sf):
    m = adapters.measurements(spark, sf)
    side = lambda t: m.where(F.col("event_type") == t).groupBy("user_id", "day").agg(F.avg("value").alias("mean"), F.count("*").alias("eligible"))
    return rounded(evidence.signed_delta(side("click"), side("purchase"), ["user_id", "day"]))


@query("""SELECT user_id, event_type, count(*) AS attempts, CASE WHEN bool_and(value > 20) THEN 'succeeded' WHEN NOT bool_or(value > 20) THEN 'failed' ELSE 'partial' END AS run_status FROM events GROUP BY user_id, event_type""")
def y10_run_status(spark, sf):
    return evidence.run_status(load(spark, sf, "events").select(*KEYS, F.when(F.col("value") > 20, "ok").otherwise("error").alias("status")), KEYS)


@query("""SELECT user_id, ts::DATE AS day FROM events WHERE event_type = 'click' UNION SELECT user_id, ts::DATE FROM events WHERE event_type = 'view'""", dates="day")
def u2_union_of_days(spark, sf):
    m = adapters.measurements(spark, sf)
    return m.where("event_type = 'click'").select("user_id", "day").union(m.where("event_type = 'view'").select("user_id", "day")).distinct()


@query("""SELECT c_custkey FROM customer EXCEPT SELECT user_id FROM events""")
def u3_missing_ids(spark, sf):
    return load(spark, sf, "customer").select("c_custkey").distinct().join(load(spark, sf, "events"), F.col("c_custkey") == F.col("user_id"), "left_anti")
