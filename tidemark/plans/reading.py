"""Queries of the period and daily readers, of acquisition states, and of the composite packets made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.functions import idempotency_key, rounded_double
from tidemark.operators import association, baseline, coverage, identity, joins, period, reading, weight
from tidemark.operators.order_statistics import quantiles
from tidemark.operators.slopes import slope_range
from tidemark.plans import adapters
from tidemark.plans.adapters import A, C, D, M, P, W
from tidemark.plans.payloads import measured
from tidemark.plans.registry import KEYS, medians, points, query, rounded
from tidemark.plans.rules import _SCOPES, scopes
from tidemark.session import load

# ---- windows and reducers --------------------------------------------------------------------


@query("""WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders), w AS (SELECT day, unnest(['last_7', 'last_30', 'calendar_year', 'trailing_365', 'year_to_date']) AS "window" FROM d),
  r AS (SELECT day, "window", CASE "window" WHEN 'last_7' THEN day - 6 WHEN 'last_30' THEN day - 29 WHEN 'trailing_365' THEN day - 364 ELSE make_date(year(day), 1, 1) END::DATE AS start, CASE "window" WHEN 'calendar_year' THEN make_date(year(day), 12, 31) ELSE day END AS "end" FROM w)
  SELECT day, "window", start, "end", (date_diff('day', start, "end") + 1)::INT AS days FROM r""", dates="day start end")
def p1_windows(spark, sf):
    return reading.windows(load(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct())


_ACTIVITIES = f"""{M}, a AS (SELECT event_id, user_id, event_type, CASE WHEN k % 19 > 0 THEN day || '/' || (k // 10) END AS identity, CASE WHEN k % 7 = 0 THEN 'min' ELSE 's' END AS unit, CASE WHEN k % 11 = 0 THEN NULL ELSE value - 5 END AS v, k % 23 = 0 AS retired FROM m),
  c AS (SELECT *, count(*) OVER (PARTITION BY user_id, identity) AS n FROM a),
  r AS (SELECT *, CASE WHEN retired THEN 'retired' WHEN identity IS NULL THEN 'missing_identity' WHEN n > 1 THEN 'duplicate_identity' WHEN unit <> 's' THEN 'invalid_unit' WHEN v IS NULL THEN 'not_finite' WHEN v < 0 THEN 'negative' END AS reason FROM c)"""


def activities(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    rows = measured(spark, sf).select(
        "event_id", "user_id", "event_type", "day", "ts", F.when(k % 19 > 0, F.concat_ws("/", "day", F.floor(k / 10).cast("int"))).alias("identity"), F.when(k % 7 == 0, "min").otherwise("s").alias("unit"),
        F.when(k % 11 > 0, F.col("value") - 5).alias("value"), (k % 23 == 0).alias("retired"),
    )
    return reading.activity_reducer(rows, ["user_id"])


@query(f"WITH {_ACTIVITIES} SELECT event_id, reason FROM r")
def p3_activity_reducer(spark, sf):
    return activities(spark, sf).select("event_id", "reason")


@query(f"WITH {_ACTIVITIES} SELECT user_id, CASE WHEN count(*) FILTER (WHERE reason IS NULL) <= 30 THEN count(*) FILTER (WHERE reason IS NULL) END AS shown, count(*) FILTER (WHERE reason IS NULL) > 30 AS has_more, count(*) FILTER (WHERE reason IS NOT NULL) AS excluded FROM r GROUP BY user_id")
def p10_bounded_sessions(spark, sf):
    ok = F.count_if(F.col("reason").isNull())
    return activities(spark, sf).groupBy("user_id").agg(F.when(ok <= 30, ok).alias("shown"), (ok > 30).alias("has_more"), F.count_if(F.col("reason").isNotNull()).alias("excluded"))


@query(f"""WITH {_ACTIVITIES}, e AS (SELECT user_id, event_type AS source, count(*) FILTER (WHERE reason IS NULL) AS eligible, count(*) FILTER (WHERE reason = 'duplicate_identity') AS ambiguous FROM r GROUP BY ALL),
  g AS (SELECT user_id, count(*) FILTER (WHERE eligible > 0 OR ambiguous > 0) AS competing, count(*) FILTER (WHERE eligible > 0) AS able FROM e GROUP BY user_id) SELECT user_id, competing, able, CASE WHEN able = 0 THEN 'none' WHEN competing = 1 THEN 'unique' ELSE 'several' END AS state FROM g""")
def p11_source_discovery(spark, sf):
    ok, twice = F.count_if(F.col("reason").isNull()), F.count_if(F.col("reason") == "duplicate_identity")
    each = activities(spark, sf).groupBy("user_id", "event_type").agg(ok.alias("eligible"), twice.alias("ambiguous"))
    competing, able = F.count_if((F.col("eligible") > 0) | (F.col("ambiguous") > 0)), F.count_if(F.col("eligible") > 0)
    return each.groupBy("user_id").agg(competing.alias("competing"), able.alias("able"), F.when(able == 0, "none").when(competing == 1, "unique").otherwise("several").alias("state"))


@query(f"""WITH {M}, u AS (SELECT user_id, unnest(generate_series((SELECT min(ts)::DATE FROM events), (SELECT max(ts)::DATE FROM events), INTERVAL 1 DAY))::DATE AS day FROM (SELECT DISTINCT user_id FROM m)), c AS (SELECT user_id, day, count(*) AS n FROM m GROUP BY ALL)
  SELECT u.user_id, u.day, CASE WHEN n IS NULL AND (u.user_id + day(u.day)) % 2 = 0 THEN 0 ELSE n END AS n, NULL::DOUBLE AS mean FROM u LEFT JOIN c ON c.user_id = u.user_id AND c.day = u.day WHERE n IS NULL""", dates="day")
def p6_proven_zero(spark, sf):
    """Days without a row: a true zero where the day is proven empty, for counts only."""
    m = adapters.measurements(spark, sf)
    spans = adapters.user_spans(spark, sf)
    missing = coverage.missing_days(m, spans, ["user_id"])
    status = F.when((F.col("user_id") + F.dayofmonth("day")) % 2 == 0, "confirmed_empty").otherwise("unknown")
    none = F.lit(None).cast("bigint")
    return missing.select("user_id", "day", reading.proven_zero(none, status, F.lit(True)).alias("n"), reading.proven_zero(none.cast("double"), status, F.lit(False)).alias("mean"))


@query(f"""WITH {M}, s AS (SELECT event_type, count(*) AS n, sum((value * 100)::BIGINT) AS c FROM m GROUP BY 1) SELECT event_type, n, round(c / 100.0, 2) AS total, round(c / 100.0 / n, 3) AS mean FROM s""")
def p16_exact_mean(spark, sf):
    return reading.exact_mean(adapters.measurements(spark, sf).withColumn("value", F.round("value", 2)), ["event_type"], "value", places=3, half_even=False)


@query(f"""WITH {M}, d AS (SELECT user_id, day, sum(k)::BIGINT AS steps FROM m GROUP BY ALL) SELECT user_id, count(*) AS n, sum(steps)::DOUBLE AS total, round_even(sum(steps)::DOUBLE / count(*), 1) AS mean FROM d GROUP BY user_id""")
def r10_steps_summary(spark, sf):
    days = adapters.measurements(spark, sf).groupBy("user_id", "day").agg(F.sum("k").alias("steps"))
    return reading.exact_mean(days, ["user_id"], "steps", scale=0)


@query(f"""WITH {M} SELECT user_id, count(*) AS n, sum(k)::DOUBLE AS total, floor(sum(k) * 10.0 / count(*) + 0.5) / 10 AS mean FROM m WHERE event_type = 'view' AND state = 'value' GROUP BY user_id""")
def r13_half_up_mean(spark, sf):
    rows = adapters.measurements(spark, sf).where("event_type = 'view' AND state = 'value'")
    return reading.exact_mean(rows, ["user_id"], "k", scale=0, half_even=False)


@query(f"""WITH {M}, d AS (SELECT user_id, day, sum(CASE WHEN event_type = 'click' THEN k END) AS a, sum(CASE WHEN event_type = 'view' THEN k END) AS b FROM m GROUP BY ALL) SELECT user_id, day, a::BIGINT AS moderate, b::BIGINT AS vigorous, (a + 2 * b)::BIGINT AS total FROM d""", dates="day")
def r2_intensity_minutes(spark, sf):
    """A total only where both parts are there."""
    of = lambda t: F.sum(F.when(F.col("event_type") == t, F.col("k")))
    days = adapters.measurements(spark, sf).groupBy("user_id", "day").agg(of("click").alias("moderate"), of("view").alias("vigorous"))
    return days.withColumn("total", F.col("moderate") + 2 * F.col("vigorous"))


@query(f"""WITH {M}, d AS (SELECT user_id, day, count(*) AS n, count(DISTINCT hour(ts)) AS c, max(k) AS most FROM m GROUP BY ALL) SELECT user_id, day, n AS samples, CASE WHEN n = c THEN most END AS most, CASE WHEN n <> c THEN 'ambiguous_coordinate' END AS reason FROM d""", dates="day")
def r4_daily_maximum(spark, sf):
    return reading.daily_maximum(measured(spark, sf).withColumn("hour", F.hour("ts")), ["user_id"], "hour", "k")


@query(f"""WITH {M}, i AS (SELECT user_id, day AS s, (day + 1 + (k % 3 = 0)::INT)::DATE AS e, state, k FROM m WHERE event_type = 'click'), x AS (SELECT *, unnest(generate_series(s, e - 1, INTERVAL 1 DAY))::DATE AS day FROM i)
  SELECT user_id, day, CASE WHEN count(*) > 1 THEN 'ambiguous' WHEN bool_or(e - s > 1) THEN 'spans_days' WHEN any_value(state) <> 'value' THEN 'invalid' ELSE 'value' END AS state, CASE WHEN count(*) = 1 AND bool_and(e - s = 1) AND any_value(state) = 'value' THEN any_value(k) END AS value FROM x GROUP BY ALL""", dates="day")
def r9_steps_day_cells(spark, sf):
    rows = adapters.measurements(spark, sf).where("event_type = 'click'").select("user_id", F.col("day").alias("start_day"), F.date_add("day", F.when(F.col("k") % 3 == 0, 2).otherwise(1)).alias("end_day"), "state", F.col("k").alias("value"))
    return reading.interval_day_cells(rows, ["user_id"])


_VITALS = f"""{M}, v AS (SELECT user_id, event_type, day, count(*) AS n, any_value(state) AS s, any_value(CASE WHEN k % 6 = 0 THEN 'hz' ELSE 'bpm' END) AS u, any_value(value) AS x FROM m GROUP BY ALL),
  d AS (SELECT user_id, event_type, day, CASE WHEN n > 1 THEN 'ambiguous' WHEN s = 'null' THEN 'missing' WHEN s <> 'value' THEN 'invalid' WHEN u <> 'bpm' THEN 'unit_mismatch' ELSE 'value' END AS state, x FROM v)"""


def _vitals(spark, sf) -> DataFrame:
    rows = adapters.measurements(spark, sf).withColumn("unit", F.when(F.col("k") % 6 == 0, "hz").otherwise("bpm"))
    return reading.daily_vitals(rows, KEYS, "bpm")


@query(f"WITH {_VITALS} SELECT user_id, event_type, day, state, CASE WHEN state = 'value' THEN round(x, 7) END AS value FROM d", dates="day")
def r11_daily_vitals(spark, sf):
    return rounded(_vitals(spark, sf))


@query(f"""WITH {_VITALS}, e AS (SELECT user_id, event_type, max(day) AS latest, arg_max(x, day) AS value, count(*) AS eligible FROM d WHERE state = 'value' GROUP BY ALL), c AS (SELECT user_id, event_type, count(*) AS days FROM d GROUP BY ALL)
  SELECT c.user_id, c.event_type, latest, round(value, 7) AS value, days - coalesce(eligible, 0) AS missing FROM c LEFT JOIN e USING (user_id, event_type)""", dates="latest")
def r18_snapshot_days(spark, sf):
    """Eligible snapshot days of each source: the latest value, never a mean, and how many days have none."""
    ok = F.col("state") == "value"
    return rounded(_vitals(spark, sf).groupBy(*KEYS).agg(F.max(F.when(ok, F.col("day"))).alias("latest"), F.max_by("value", F.when(ok, F.col("day"))).alias("value"), F.count_if(~ok).alias("missing")))


@query(f"WITH {_ACTIVITIES}, t AS (SELECT r.*, m.ts, row_number() OVER (PARTITION BY r.user_id ORDER BY m.ts DESC, r.event_id DESC) AS place FROM r JOIN m ON m.event_id = r.event_id WHERE reason IS NULL) SELECT user_id, event_id, round(v, 7) AS value FROM t WHERE place = 1")
def r14_latest_session(spark, sf):
    newest = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return rounded(activities(spark, sf).where("reason IS NULL").withColumn("n", newest).where("n = 1").select("user_id", "event_id", "value"))


@query(f"""WITH {M} SELECT user_id, event_type, arg_max(value, (ts, event_id)) FILTER (WHERE state = 'value') AS latest, max(day) FILTER (WHERE state = 'value') AS day, count(*) FILTER (WHERE state = 'value') AS usable FROM m GROUP BY ALL""", dates="day")
def r15_latest_picks(spark, sf):
    ok = F.col("state") == "value"
    place = F.when(ok, F.struct("ts", "event_id"))
    return measured(spark, sf).groupBy(*KEYS).agg(F.max_by("value", place).alias("latest"), F.max(F.when(ok, F.col("day"))).alias("day"), F.count_if(ok).alias("usable"))


@query(f"""WITH {M}, {W}, x AS (SELECT 'event' AS domain, event_type AS metric, day, value FROM m WHERE state = 'value' UNION ALL SELECT 'weight', grp, day, value FROM w WHERE confirmed AND NOT superseded AND unit = 'kg')
  SELECT domain, metric, count(*) AS n, count(DISTINCT day) AS days, round(avg(value), 6) AS mean, min(day) AS first_day, max(day) AS last_day FROM x GROUP BY ALL""", dates="first_day last_day")
def r17_domains(spark, sf):
    """One table of several domains, each with its own eligibility."""
    e = adapters.measurements(spark, sf).where("state = 'value'").select(F.lit("event").alias("domain"), F.col("event_type").alias("metric"), "day", "value")
    w = weight.candidates(adapters.weights(spark, sf)).where("reason IS NULL").select(F.lit("weight").alias("domain"), F.col("grp").alias("metric"), "day", "value")
    return rounded(e.unionByName(w).groupBy("domain", "metric").agg(F.count("*").alias("n"), F.count_distinct("day").alias("days"), F.avg("value").alias("mean"), F.min("day").alias("first_day"), F.max("day").alias("last_day")), 6)


@query(f"""WITH {M}, s AS (SELECT user_id, event_type, max(day) AS day FROM m GROUP BY ALL) SELECT user_id, event_type, day, count(*) AS "rows", max(k) AS most, sum(k)::BIGINT AS total, count(DISTINCT k) AS different FROM m JOIN s USING (user_id, event_type, day) GROUP BY ALL""", dates="day")
def f2_latest_slice(spark, sf):
    """Also J19: the newest day of each source, joined back."""
    return reading.latest_slice(adapters.measurements(spark, sf), KEYS, "k")


# ---- trips -------------------------------------------------------------------------------------

_TRIP = f"""{M}, d AS (SELECT user_id, day, sum(k) FILTER (WHERE event_type = 'click') AS c, sum(k) FILTER (WHERE event_type = 'view') AS o FROM m GROUP BY ALL),
  s AS (SELECT *, CASE WHEN day > DATE '2024-01-25' THEN 'future' WHEN c < o THEN 'conflict' WHEN c = 0 THEN 'zero' WHEN c IS NOT NULL THEN 'completed' WHEN o IS NOT NULL THEN 'incomplete' ELSE 'missing' END AS state FROM d)"""


def _trip(spark, sf) -> DataFrame:
    of = lambda t: F.sum(F.when(F.col("event_type") == t, F.col("k")))
    return period.trip_day(adapters.measurements(spark, sf).groupBy("user_id", "day").agg(of("click").alias("completed"), of("view").alias("observed")), "2024-01-25")


@query(f"WITH {_TRIP} SELECT user_id, count(*) FILTER (WHERE state IN ('completed', 'zero')) AS n, (sum(c) FILTER (WHERE state IN ('completed', 'zero')))::DOUBLE AS total, round_even((sum(c) FILTER (WHERE state IN ('completed', 'zero')))::DOUBLE / nullif(count(*) FILTER (WHERE state IN ('completed', 'zero')), 0), 1) AS mean FROM s GROUP BY user_id")
def t2_counted_days(spark, sf):
    return reading.exact_mean(_trip(spark, sf), ["user_id"], "counted", scale=0)


@query(f"""WITH {_TRIP}, w AS (SELECT user_id, CASE WHEN day BETWEEN DATE '2024-01-16' AND DATE '2024-01-25' THEN 'now' WHEN day BETWEEN DATE '2024-01-06' AND DATE '2024-01-15' THEN 'before' END AS w, CASE WHEN state IN ('completed', 'zero') THEN c END AS c FROM s),
  a AS (SELECT user_id, sum(c) FILTER (WHERE w = 'now') AS n, sum(c) FILTER (WHERE w = 'before') AS b, count(c) FILTER (WHERE w = 'now') AS nd, count(c) FILTER (WHERE w = 'before') AS bd FROM w WHERE w IS NOT NULL GROUP BY user_id)
  SELECT user_id, n::BIGINT AS now_total, nd AS now_days, b::BIGINT AS before_total, bd AS before_days, CASE WHEN nd = bd THEN (n - b)::BIGINT END AS delta, CASE WHEN nd <> bd THEN 'different_days' END AS reason FROM a""")
def t4_previous_trip_window(spark, sf):
    """A window against the equal one before it; totals compare only over as many counted days."""
    at = lambda a, b: F.col("day").between(F.lit(a).cast("date"), F.lit(b).cast("date"))
    w = F.when(at("2024-01-16", "2024-01-25"), "now").when(at("2024-01-06", "2024-01-15"), "before")
    of = lambda f, x: f(F.when(F.col("w") == x, F.col("counted")))
    wide = _trip(spark, sf).withColumn("w", w).where("w IS NOT NULL").groupBy("user_id").agg(of(F.sum, "now").alias("now_total"), of(F.count, "now").alias("now_days"), of(F.sum, "before").alias("before_total"), of(F.count, "before").alias("before_days"))
    same = F.col("now_days") == F.col("before_days")
    return wide.select("*", F.when(same, F.col("now_total") - F.col("before_total")).alias("delta"), F.when(~same, "different_days").alias("reason"))


@query(f"""WITH {M} SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M') WHEN 1 THEN strftime(ts + INTERVAL 2 HOURS, '%Y-%m-%d %H:%M') WHEN 2 THEN strftime(ts + INTERVAL 9 HOURS, '%Y-%m-%d %H:%M') END AS local_start, CASE event_id % 4 WHEN 0 THEN 'wall' WHEN 1 THEN 'offset' WHEN 2 THEN 'zone' ELSE 'unresolved' END AS basis FROM m""")
def t5_local_start(spark, sf):
    """The local start of a workout: its own wall time, else instant and offset, else instant and zone."""
    i, shape = F.col("event_id") % 4, "yyyy-MM-dd HH:mm"
    wall = F.when(i == 0, F.date_format("ts", shape))
    offset = F.when(i == 1, F.date_format(F.timestamp_micros(F.unix_micros("ts") + 7_200_000_000), shape))
    zone = F.when(i == 2, F.date_format(F.from_utc_timestamp("ts", F.lit("Asia/Tokyo")), shape))
    basis = F.when(wall.isNotNull(), "wall").when(offset.isNotNull(), "offset").when(zone.isNotNull(), "zone").otherwise("unresolved")
    return measured(spark, sf).select("event_id", F.coalesce(wall, offset, zone).alias("local_start"), basis.alias("basis"))


@query(f"""WITH {_TRIP}, z AS (SELECT user_id, day, count(DISTINCT event_type) AS zones FROM m GROUP BY ALL) SELECT user_id, count(*) AS days, count(*) FILTER (WHERE state = 'completed') AS completed, count(*) FILTER (WHERE state = 'conflict') AS conflicts, count(*) FILTER (WHERE state = 'future') AS future,
  (sum(c) FILTER (WHERE state IN ('completed', 'zero')))::BIGINT AS total, count(*) FILTER (WHERE zones > 1) AS days_of_several_zones FROM s JOIN z USING (user_id, day) GROUP BY user_id""")
def q11_trip_passport(spark, sf):
    """Day states, counted total and days of several zones of each traveller."""
    zones = adapters.measurements(spark, sf).groupBy("user_id", "day").agg(F.count_distinct("event_type").alias("zones"))
    is_ = lambda s: F.count_if(F.col("state") == s)
    return _trip(spark, sf).join(zones, ["user_id", "day"]).groupBy("user_id").agg(F.count("*").alias("days"), is_("completed").alias("completed"), is_("conflict").alias("conflicts"), is_("future").alias("future"), F.sum("counted").alias("total"), F.count_if(F.col("zones") > 1).alias("days_of_several_zones"))


# ---- joins -------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, o_orderpriority, count(*) AS lines, round(sum(l_extendedprice), 2) AS price FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P' AND l_returnflag = 'R' GROUP BY ALL""")
def j1_metrics_of_records(spark, sf):
    met = load(spark, sf, "lineitem").where("l_returnflag = 'R'").join(load(spark, sf, "orders").where("o_orderstatus <> 'P'"), F.col("l_orderkey") == F.col("o_orderkey"))
    return met.groupBy("o_orderkey", "o_orderpriority").agg(F.count("*").alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("""SELECT o_orderkey, count(l_orderkey) AS parts, count(l_orderkey) = 0 AS without FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 45 GROUP BY o_orderkey""")
def j2_records_with_parts(spark, sf):
    parts = load(spark, sf, "lineitem").where("l_quantity > 45").select("l_orderkey")
    n = F.count("l_orderkey")
    return load(spark, sf, "orders").join(parts, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderkey").agg(n.alias("parts"), (n == 0).alias("without"))


@query("""SELECT r_name, n_name, c_mktsegment, o_orderpriority, count(*) AS lines, count(DISTINCT s_suppkey) AS suppliers, count(DISTINCT p_type) AS types FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
  LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY ALL""")
def j3_provenance_spine(spark, sf):
    """Every line with all that it came from; what is missing stays null."""
    t = lambda n: load(spark, sf, n)
    c = F.col
    spine = (
        t("lineitem").join(t("orders"), c("o_orderkey") == c("l_orderkey"), "left").join(t("customer"), c("c_custkey") == c("o_custkey"), "left").join(t("nation"), c("n_nationkey") == c("c_nationkey"), "left")
        .join(t("region"), c("r_regionkey") == c("n_regionkey"), "left").join(t("supplier"), c("s_suppkey") == c("l_suppkey"), "left").join(t("part"), c("p_partkey") == c("l_partkey"), "left")
    )
    return spine.groupBy("r_name", "n_name", "c_mktsegment", "o_orderpriority").agg(F.count("*").alias("lines"), F.count_distinct("s_suppkey").alias("suppliers"), F.count_distinct("p_type").alias("types"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.09)""")
def j4_records_with_metric(spark, sf):
    return load(spark, sf, "orders").join(load(spark, sf, "lineitem").where("l_discount > 0.09"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("o_orderkey")


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = 'purchase')""")
def j5_sources_with_rows(spark, sf):
    seen = load(spark, sf, "events").where("event_type = 'purchase'").select("user_id")
    return load(spark, sf, "customer").join(seen, F.col("user_id") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


@query("""SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A')""")
def j6_records_without(spark, sf):
    return load(spark, sf, "orders").join(load(spark, sf, "lineitem").where("l_returnflag = 'A'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey")


@query("""WITH d AS (SELECT user_id, ts::DATE AS day, sum(value) AS v FROM events GROUP BY 1, 2), l AS (SELECT d.*, k FROM d, (SELECT unnest(range(0, 15)) AS k)) SELECT k::INT AS lag, count(y.v) AS pairs, count(*) - count(y.v) AS absent FROM l LEFT JOIN d y ON y.user_id = l.user_id AND y.day = l.day + l.k::INT GROUP BY k""")
def j9_lagged_pairs(spark, sf):
    d = adapters.measurements(spark, sf).groupBy("user_id", "day").agg(F.sum("value").alias("v"))
    left = d.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(14)))).select("user_id", "lag", F.date_add("day", F.col("lag")).alias("day"))
    return left.join(d, ["user_id", "day"], "left").groupBy("lag").agg(F.count("v").alias("pairs"), F.count_if(F.col("v").isNull()).alias("absent"))


@query(f"""WITH {C}, b AS (SELECT cust, unnest(range(0, date_diff('day', s, e) // 7 + 1)) AS n, s, e FROM spans), i AS (SELECT o_custkey AS cust, o_orderdate::DATE AS s, (o_orderdate::DATE + 1 + (o_orderkey % 20)::INT)::DATE AS e FROM orders)
  SELECT b.cust, count(*) AS meetings, count(DISTINCT n) AS bins FROM b JOIN i ON i.cust = b.cust AND i.s <= least((b.s + (7 * n + 6)::INT)::DATE, b.e) AND i.e > (b.s + (7 * n)::INT)::DATE GROUP BY b.cust""")
def j10_interval_bins(spark, sf):
    """Coverage intervals against calendar bins: an interval meets the run of bins from its first day's to its last day's."""
    spans = adapters.customer_spans(spark, sf)
    i = load(spark, sf, "orders").select(F.col("o_custkey").alias("cust"), F.to_date("o_orderdate").alias("s"), F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 20).cast("int")).alias("last"))
    met = i.join(spans, "cust").select("cust", F.explode(F.sequence(coverage.bin_number(F.col("s"), F.col("start"), 7), coverage.bin_number(F.least("last", "end"), F.col("start"), 7))).alias("bin"))
    return met.groupBy("cust").agg(F.count("*").alias("meetings"), F.count_distinct("bin").alias("bins"))


@query(f"""WITH {C} SELECT o.cust, (date_diff('day', s, day) // 7)::INT AS bin, count(*) AS n FROM o JOIN spans ON spans.cust = o.cust GROUP BY ALL""")
def j11_bins_of_days(spark, sf):
    met = adapters.customer_days(spark, sf).join(adapters.customer_spans(spark, sf), "cust")
    return met.groupBy("cust", coverage.bin_number(F.col("day"), F.col("start"), 7).alias("bin")).agg(F.count("*").alias("n"))


@query(f"""WITH {P} SELECT a.user_id, a.event_type, count(*) AS pairs, round(min((b.value - a.value) / (b.day - a.day)), 6) AS least, round(max((b.value - a.value) / (b.day - a.day)), 6) AS most FROM p a JOIN p b ON a.user_id = b.user_id AND a.event_type = b.event_type AND b.day > a.day WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY ALL""")
def j14_pairwise_slopes(spark, sf):
    return rounded(slope_range(points(spark, sf).where("value IS NOT NULL"), KEYS), 6)


@query("""WITH v AS (SELECT l_orderkey AS o, l_returnflag AS metric, max(l_extendedprice) AS v FROM lineitem GROUP BY ALL), r AS (SELECT metric, max(v) AS ref FROM v GROUP BY metric) SELECT o AS session, metric, round(v - ref, 2) AS below FROM v JOIN r USING (metric)""")
def j16_against_best_session(spark, sf):
    v = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("session"), F.col("l_returnflag").alias("metric")).agg(F.max("l_extendedprice").alias("value"))
    best = v.groupBy("metric").agg(F.max("value").alias("reference"))
    return joins.against_reference(v, ["metric"], best).select("session", "metric", F.round("delta", 2).alias("below"))


# ---- coverage, gates, selection ------------------------------------------------------------------


@query(f"""WITH {C}, n AS (SELECT o_custkey AS cust, o_orderdate::DATE AS day, o_orderpriority AS source FROM orders) SELECT n.cust, (date_diff('day', s, day) // 30)::INT AS bin, count(DISTINCT day) AS observed, least(30, date_diff('day', s, e) - 30 * (date_diff('day', s, day) // 30) + 1)::INT AS expected, count(DISTINCT source) AS sources FROM n JOIN spans ON spans.cust = n.cust GROUP BY n.cust, s, e, date_diff('day', s, day) // 30""")
def c3_bin_counts(spark, sf):
    """Observed and expected days of each bin, and the sources it has."""
    rows = load(spark, sf, "orders").select(F.col("o_custkey").alias("cust"), F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("source")).join(adapters.customer_spans(spark, sf), "cust")
    k = coverage.bin_number(F.col("day"), F.col("start"), 30)
    out = rows.groupBy("cust", "start", "end", k.alias("bin")).agg(F.count_distinct("day").alias("observed"), F.count_distinct("source").alias("sources"))
    return out.select("cust", "bin", "observed", F.least(F.lit(30), F.datediff("end", "start") - 30 * F.col("bin") + 1).alias("expected"), "sources")


@query(f"""WITH {W}, h AS (SELECT * FROM w WHERE confirmed AND NOT superseded), s AS (SELECT grp, min(day) AS s, max(day) AS e FROM h GROUP BY grp), b AS (SELECT grp, (date_diff('day', s, e) // 7 + 1) AS bins FROM s), o AS (SELECT h.grp, count(DISTINCT date_diff('day', s, day) // 7) AS filled, count(*) AS n FROM h JOIN s ON s.grp = h.grp GROUP BY h.grp)
  SELECT grp, bins::BIGINT AS bins, filled, n FROM b JOIN o USING (grp)""")
def c6_stored_coverage(spark, sf):
    """Coverage of the current heads by 7-day bins."""
    heads = adapters.weights(spark, sf).where("confirmed AND NOT superseded")
    spans = heads.groupBy("grp").agg(F.min("day").alias("start"), F.max("day").alias("end"))
    met = heads.join(spans, "grp").withColumn("bin", coverage.bin_number(F.col("day"), F.col("start"), 7))
    total = F.max(coverage.bin_number(F.col("end"), F.col("start"), 7) + 1).cast("long")
    return met.groupBy("grp").agg(total.alias("bins"), F.count_distinct("bin").alias("filled"), F.count("*").alias("n"))


@query("""WITH s AS (SELECT DISTINCT c_mktsegment AS acq, c_nationkey AS source FROM customer), n AS (SELECT *, count(*) OVER (PARTITION BY acq) AS siblings FROM s), e AS (SELECT c_custkey AS id, c_mktsegment AS acq, c_nationkey AS source FROM customer) SELECT id, siblings = 1 AS proves_source FROM e JOIN n USING (acq, source)""")
def c7_source_completeness(spark, sf):
    """Completeness of an acquisition proves a source only where the acquisition has that one source."""
    rows = load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("acq"), F.col("c_nationkey").alias("source"))
    siblings = rows.groupBy("acq").agg(F.count_distinct("source").alias("siblings"))
    return rows.join(siblings, "acq").select("id", (F.col("siblings") == 1).alias("proves_source"))


@query(f"""WITH {P} SELECT user_id, event_type, round(quantile_cont(value, 0.05), 7) AS p05, round(quantile_cont(value, 0.95), 7) AS p95 FROM p GROUP BY ALL""")
def b2_type7_quantiles(spark, sf):
    return rounded(quantiles(points(spark, sf), KEYS, "value", {"p05": 0.05, "p95": 0.95}))


@query(f"""WITH {P} SELECT event_type, CASE WHEN status IN ('value', 'zero', 'partial') THEN CASE status WHEN 'value' THEN 'usable' ELSE status END WHEN status = 'ambiguous' THEN 'excluded' ELSE status END AS class, count(*) AS n FROM p GROUP BY ALL""")
def b7_input_classes(spark, sf):
    s = F.col("status")
    kind = F.when(s == "value", "usable").when(s == "ambiguous", "excluded").otherwise(s)
    return points(spark, sf).groupBy("event_type", kind.alias("class")).agg(F.count("*").alias("n"))


@query(f"""WITH {P}, c AS (SELECT event_type, count(DISTINCT (user_id, day)) AS cells, count(DISTINCT (user_id, day)) FILTER (WHERE value IS NOT NULL) AS usable FROM p GROUP BY 1) SELECT event_type, cells, usable, CASE WHEN usable = 0 THEN 'none' WHEN usable * 3 >= cells * 2 THEN 'sufficient' ELSE 'low' END AS coverage FROM c""")
def b10_metric_coverage(spark, sf):
    p = points(spark, sf).groupBy("event_type").agg(F.count("*").alias("cells"), F.count("value").alias("usable"))
    return p.withColumn("coverage", F.when(F.col("usable") == 0, "none").when(F.col("usable") * 3 >= F.col("cells") * 2, "sufficient").otherwise("low"))


#: Which aggregates a kind of metric allows (fixed values).
AGGREGATES = [("click", "total"), ("click", "mean"), ("view", "mean"), ("purchase", "total"), ("error", "count"), ("signup", "latest")]


@query(f"""WITH r(event_type, kind) AS (VALUES {', '.join(str(x) for x in AGGREGATES)}), a AS (SELECT DISTINCT event_type, ['total', 'mean', 'count', 'latest'][(event_id % 4 + 1)::INT] AS kind FROM events) SELECT a.event_type, a.kind, CASE WHEN r.kind IS NULL THEN 'forbidden_substitution' ELSE 'allowed' END AS outcome FROM a LEFT JOIN r ON r.event_type = a.event_type AND r.kind = a.kind""")
def b12_aggregate_kinds(spark, sf):
    registry = spark.createDataFrame(AGGREGATES, "event_type string, kind string").withColumn("outcome", F.lit("allowed"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("total", "mean", "count", "latest")]), (F.col("event_id") % 4 + 1).cast("int"))
    asked = load(spark, sf, "events").select("event_type", kind.alias("kind")).distinct()
    return asked.join(F.broadcast(registry), ["event_type", "kind"], "left").fillna("forbidden_substitution", ["outcome"])


@query(f"WITH {P} SELECT user_id, event_type, count(*) AS days, count(*) FILTER (WHERE status = 'ambiguous') AS ambiguous FROM p GROUP BY ALL")
def l1_one_scalar_a_day(spark, sf):
    one = association.one_per_day(adapters.measurements(spark, sf), KEYS)
    return one.groupBy(*KEYS).agg(F.count("*").alias("days"), F.count_if(F.col("status") == "ambiguous").alias("ambiguous"))


@query("""SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS rank FROM events""")
def l2_mid_ranks(spark, sf):
    """Ties share their mean rank (also V1)."""
    return load(spark, sf, "events").select("event_id", association.mid_rank("value", ["event_type"]).alias("rank"))


@query(f"""WITH {M}, r AS (SELECT user_id, rank() OVER (PARTITION BY user_id ORDER BY k) + (count(*) OVER (PARTITION BY user_id, k) - 1) / 2.0 AS a, rank() OVER (PARTITION BY user_id ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2.0 AS b FROM m) SELECT user_id, round(corr(a, b), 6) AS rho FROM r GROUP BY user_id""")
def l3_spearman(spark, sf):
    ranked = adapters.measurements(spark, sf).select("user_id", association.mid_rank("k", ["user_id"]).alias("a"), association.mid_rank("value", ["user_id"]).alias("b"))
    return rounded(ranked.groupBy("user_id").agg(association.safe_correlation("a", "b").alias("rho")), 6)


@query(f"""WITH {M}, g AS (SELECT user_id, day, count(DISTINCT k % 3) AS n FROM m GROUP BY ALL) SELECT user_id, count(*) FILTER (WHERE n = 1) AS kept, count(*) FILTER (WHERE n > 1) AS duplicate_days FROM g GROUP BY user_id""")
def a1_duplicate_days(spark, sf):
    """A day with one difference keeps it, however often it is told; a day with several is left out."""
    rows = adapters.measurements(spark, sf).select("user_id", "day", (F.col("k") % 3).alias("diff"), F.lit(0).alias("a"), F.lit(0).alias("b"))
    kept = association.agreement_dedup(rows, ["user_id"]).groupBy("user_id").agg(F.count("*").alias("kept"))
    days = rows.groupBy("user_id").agg(F.count_distinct("day").alias("days"))
    return days.join(kept, "user_id", "left").select("user_id", F.coalesce("kept", F.lit(0).cast("long")).alias("kept"), (F.col("days") - F.coalesce("kept", F.lit(0))).alias("duplicate_days"))


@query(f"""WITH {D}, s AS (SELECT *, date_diff('day', lag(day) OVER (PARTITION BY grp ORDER BY day), day) AS gap FROM d) SELECT grp, day, gap::INT AS gap, round(1 - pow(2::DOUBLE, -gap / 21.0), 7) AS alpha FROM s WHERE gap IS NOT NULL""", dates="day")
def w2_smoothing_factors(spark, sf):
    gap = F.datediff("day", F.lag("day").over(Window.partitionBy("grp").orderBy("day")))
    return rounded(medians(spark, sf).select("grp", "day", gap.alias("gap")).where("gap IS NOT NULL").withColumn("alpha", 1 - F.pow(F.lit(2.0), -F.col("gap") / weight.HALF_LIFE)))


@query("""SELECT l_orderkey AS session, m.metric, max(CASE WHEN l_returnflag = m.metric THEN l_extendedprice END) AS value, CASE WHEN count(*) FILTER (WHERE l_returnflag = m.metric) = 0 THEN 'metric_absent_from_projection' END AS reason FROM lineitem, (SELECT unnest(['A', 'N', 'R']) AS metric) m GROUP BY ALL""")
def g1_session_metrics(spark, sf):
    """Every session by every metric code; a code without a row says so."""
    li = load(spark, sf, "lineitem")
    every = li.select(F.col("l_orderkey").alias("session")).distinct().withColumn("metric", F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R"))))
    have = li.groupBy(F.col("l_orderkey").alias("session"), F.col("l_returnflag").alias("metric")).agg(F.max("l_extendedprice").alias("value"))
    return every.join(have, ["session", "metric"], "left").withColumn("reason", F.when(F.col("value").isNull(), "metric_absent_from_projection"))


@query("""WITH f AS (SELECT DISTINCT l_orderkey AS s, l_returnflag AS metric FROM lineitem), n AS (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem) SELECT metric, count(*) AS present, n - count(*) AS absent FROM f, n GROUP BY metric, n""")
def g3_comparison_coverage(spark, sf):
    every = g1_session_metrics(spark, sf)
    return every.groupBy("metric").agg(F.count_if(F.col("reason").isNull()).alias("present"), F.count_if(F.col("reason").isNotNull()).alias("absent"))


@query("""WITH p AS (SELECT event_id, ['averageHR', 'summary.averageHR', 'summary.averageHRx', 'x.summary.maxHR', 'xaverageHR'][event_id % 5 + 1] AS path FROM events) SELECT event_id, path IN ('averageHR', 'maxHR') OR path LIKE '%.averageHR' OR path LIKE '%.maxHR' AS reviewed FROM p""")
def g5_reviewed_paths(spark, sf):
    paths = F.array(*[F.lit(x) for x in ("averageHR", "summary.averageHR", "summary.averageHRx", "x.summary.maxHR", "xaverageHR")])
    path = F.element_at(paths, (F.col("event_id") % 5 + 1).cast("int"))
    return load(spark, sf, "events").select("event_id", reading.reviewed_path(path, ["averageHR", "maxHR"]).alias("reviewed"))


@query("""SELECT o_orderkey AS id, sha256(concat_ws(chr(31), 'v' || o_orderpriority, 'v' || o_custkey, 'v' || o_orderdate::DATE, coalesce('v' || CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END, 'n'))) AS hash FROM orders""")
def h2_candidate_hash(spark, sf):
    """What a candidate says, without when it was received."""
    status = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus"))
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), idempotency_key(F.col("o_orderpriority"), F.col("o_custkey"), F.to_date("o_orderdate"), status).alias("hash"))


@query("""WITH r AS (SELECT o_custkey AS scope, o_orderpriority AS rule, o_orderstatus AS input, o_orderkey AS run FROM orders) SELECT run, min(run) OVER (PARTITION BY scope, rule, input) AS replays FROM r""")
def h3_replayed_runs(spark, sf):
    """A run of the same scope, rule and input replays the first one."""
    same = Window.partitionBy("o_custkey", "o_orderpriority", "o_orderstatus")
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("run"), F.min("o_orderkey").over(same).alias("replays"))


@query("""WITH h AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 11 > 0), d AS (SELECT c_custkey AS key, list(o_orderkey) FILTER (WHERE o_orderkey IS NOT NULL AND o_orderkey % 5 = 0) AS inputs FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1), x AS (SELECT key, unnest(inputs) AS id FROM d)
  SELECT d.key, coalesce(b.ok, false) AS current FROM d LEFT JOIN (SELECT x.key, bool_and(h.id IS NOT NULL) AS ok FROM x LEFT JOIN h ON h.id = x.id GROUP BY x.key) b ON b.key = d.key""")
def h4_derived_currentness(spark, sf):
    o = load(spark, sf, "orders")
    inputs = o.where("o_orderkey % 5 = 0").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("inputs"))
    derived = load(spark, sf, "customer").join(inputs, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("key"), "inputs")
    return reading.live_inputs(derived, o.where("o_orderstatus <> 'P' AND o_orderkey % 11 > 0").select(F.col("o_orderkey").alias("id")), "key", "inputs")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderdate::DATE < DATE '1996-01-01' THEN 'before_period' WHEN o_orderdate::DATE > DATE '1999-12-31' THEN 'after_period' ELSE 'inside' END AS place FROM orders""")
def h5_period_filter(spark, sf):
    d = F.to_date("o_orderdate")
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(d < F.lit("1996-01-01").cast("date"), "before_period").when(d > F.lit("1999-12-31").cast("date"), "after_period").otherwise("inside").alias("place"))


# ---- windows, orders, sets -----------------------------------------------------------------------


@query(f"WITH {C}, s AS (SELECT DISTINCT * FROM o) SELECT cust, day, date_diff('day', lag(day) OVER (PARTITION BY cust ORDER BY day), day)::INT AS gap FROM s", dates="day")
def v2_gaps_to_previous(spark, sf):
    return adapters.customer_days(spark, sf).distinct().withColumn("gap", F.datediff("day", F.lag("day").over(Window.partitionBy("cust").orderBy("day"))))


@query(f"WITH {A}, h AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY day) <= count(*) OVER (PARTITION BY cohort) // 2 AS first FROM x) SELECT cohort, first, count(*) AS n, min(day) AS first_day, max(day) AS last_day FROM h GROUP BY ALL", dates="first_day last_day")
def v4_half_split(spark, sf):
    w = Window.partitionBy("cohort")
    halves = adapters.paired(spark, sf).select("cohort", "day", (F.row_number().over(w.orderBy("day")) <= F.floor(F.count("*").over(w) / 2)).alias("first"))
    return halves.groupBy("cohort", "first").agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query(f"WITH {D}, l AS (SELECT *, max(day) OVER (PARTITION BY grp) AS latest FROM d) SELECT grp, count(*) AS n, min(day) AS first_day, round(avg(value), 6) AS mean FROM l WHERE day > latest - 90 GROUP BY grp", dates="first_day")
def v5_trailing_days(spark, sf):
    last = F.max("day").over(Window.partitionBy("grp"))
    inside = medians(spark, sf).withColumn("latest", last).where(F.datediff("latest", "day") < 90)
    return rounded(inside.groupBy("grp").agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.avg("value").alias("mean")), 6)


@query("""SELECT user_id, event_type, count(*) AS tied FROM (SELECT *, rank() OVER (PARTITION BY user_id, event_type ORDER BY date_trunc('day', ts) DESC) AS r FROM events) WHERE r = 1 GROUP BY ALL""")
def v8_top_group(spark, sf):
    top = F.rank().over(Window.partitionBy(*KEYS).orderBy(F.desc("day")))
    return adapters.measurements(spark, sf).withColumn("r", top).where("r = 1").groupBy(*KEYS).agg(F.count("*").alias("tied"))


@query(f"""WITH {C}, s AS (SELECT DISTINCT * FROM o), i AS (SELECT *, day - row_number() OVER (PARTITION BY cust ORDER BY day)::INT AS run FROM s) SELECT cust, min(day) AS start, max(day) AS "end", count(*) AS days FROM i GROUP BY cust, run""", dates="start end")
def v9_islands(spark, sf):
    return coverage.islands(adapters.customer_days(spark, sf), ["cust"])


@query(f"WITH {P} SELECT user_id, event_type, max(day) FILTER (WHERE value IS NOT NULL) AS day, arg_max(value, day) AS value FROM p GROUP BY ALL", dates="day")
def v10_latest_usable(spark, sf):
    ok = F.when(F.col("value").isNotNull(), F.col("day"))
    return points(spark, sf).groupBy(*KEYS).agg(F.max(ok).alias("day"), F.max_by("value", ok).alias("value"))


@query("""WITH p AS (SELECT event_id, user_id, ts AS s, ts + INTERVAL 1 HOUR AS e FROM events), w AS (SELECT *, lag(e) OVER (PARTITION BY user_id ORDER BY s, event_id) AS b FROM p) SELECT event_id, CASE WHEN b IS NULL THEN 'first' WHEN b > s THEN 'overlap' WHEN b < s THEN 'hole' ELSE 'adjacent' END AS relation FROM w""")
def v12_adjacency(spark, sf):
    end = F.col("ts") + F.expr("interval 1 hour")
    before = F.lag(end).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return measured(spark, sf).select("event_id", F.when(before.isNull(), "first").when(before > F.col("ts"), "overlap").when(before < F.col("ts"), "hole").otherwise("adjacent").alias("relation"))


@query("""SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 3 > 0 THEN ts END NULLS FIRST, event_type, event_id) AS place FROM events""")
def o7_null_first_order(spark, sf):
    """A total order of evidence with undated rows first (also O1)."""
    at = F.when(F.col("event_id") % 3 > 0, F.col("ts"))
    order = Window.partitionBy("user_id").orderBy(at.asc_nulls_first(), "event_type", "event_id")
    return load(spark, sf, "events").select("event_id", F.row_number().over(order).cast("long").alias("place"))


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderpriority, o_totalprice DESC, o_orderstatus, o_orderkey DESC) AS place FROM orders""")
def o8_mixed_order(spark, sf):
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderpriority", F.desc("o_totalprice"), "o_orderstatus", F.desc("o_orderkey"))
    return load(spark, sf, "orders").select("o_orderkey", F.row_number().over(order).cast("long").alias("place"))


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT user_id, count(*) FILTER (WHERE n <= 10) AS shown, max(n) > 10 AS has_more, min(event_id) FILTER (WHERE n <= 10) AS oldest FROM r GROUP BY user_id""")
def o5_pages(spark, sf):
    """The first page of each user and whether there is more."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    page = load(spark, sf, "events").withColumn("n", n).where("n <= 11")
    return page.groupBy("user_id").agg(F.count_if(F.col("n") <= 10).alias("shown"), (F.max("n") > 10).alias("has_more"), F.min(F.when(F.col("n") <= 10, F.col("event_id"))).alias("oldest"))


@query("""SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def u6_intersection(spark, sf):
    return load(spark, sf, "events").where("event_type = 'click'").select("user_id").intersect(load(spark, sf, "orders").where("o_orderstatus = 'P'").select("o_custkey"))


@query("""WITH c AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events WHERE event_type = 'view'), s AS (SELECT DISTINCT user_id FROM events) SELECT s.user_id, (SELECT date_diff('day', min(ts)::DATE, max(ts)::DATE) + 1 FROM events) - count(c.day) AS missing FROM s LEFT JOIN c USING (user_id) GROUP BY s.user_id""")
def u4_missing_dates(spark, sf):
    m = adapters.measurements(spark, sf)
    spans = adapters.user_spans(spark, sf)
    gone = coverage.missing_days(m.where("event_type = 'view'"), spans, ["user_id"])
    return spans.join(gone, "user_id", "left").groupBy("user_id").agg(F.count("day").alias("missing"))


# ---- acquisition -------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT DISTINCT c_nationkey AS s FROM customer WHERE c_custkey % 3 > 0), c AS (SELECT DISTINCT s_nationkey AS s FROM supplier) SELECT (SELECT count(*) FROM r) AS records, (SELECT count(*) FROM c WHERE s NOT IN (SELECT s FROM r)) AS coverage_only, (SELECT count(*) FROM r) + (SELECT count(*) FROM c WHERE s NOT IN (SELECT s FROM r)) AS sources""")
def y2_source_resolution(spark, sf):
    """Sources of records, and those that only coverage names."""
    r = load(spark, sf, "customer").where("c_custkey % 3 > 0").select(F.col("c_nationkey").alias("s")).distinct()
    only = load(spark, sf, "supplier").select(F.col("s_nationkey").alias("s")).distinct().join(r, "s", "left_anti")
    n = r.select(F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(only.select(F.lit(0), F.lit(1)))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return n.agg(total("a").alias("records"), total("b").alias("coverage_only"), (total("a") + total("b")).alias("sources"))


@query("""WITH k AS (SELECT user_id, CASE event_id % 4 WHEN 0 THEN 'stream:' || event_type WHEN 3 THEN 'stream:' || event_type || ':bad' ELSE 'stream:' || event_type || ':' || ts::DATE END AS key, event_id AS cursor, event_type, ts::DATE AS day, event_id % 4 AS c FROM events),
  d AS (SELECT user_id, event_type, arg_max(cursor, (day, cursor)) AS dated FROM k WHERE c IN (1, 2) AND day <= DATE '2024-01-20' GROUP BY ALL), b AS (SELECT user_id, event_type, max(cursor) AS base FROM k WHERE c = 0 GROUP BY ALL), s AS (SELECT DISTINCT user_id, event_type FROM k)
  SELECT user_id, event_type, coalesce(dated, base) AS checkpoint FROM s LEFT JOIN d USING (user_id, event_type) LEFT JOIN b USING (user_id, event_type)""")
def y3_newest_checkpoint(spark, sf):
    """The newest dated checkpoint up to a day, read out of a key, else the base one."""
    i = F.col("event_id") % 4
    name = F.concat(F.lit("stream:"), "event_type")
    key = F.when(i == 0, name).when(i == 3, F.concat(name, F.lit(":bad"))).otherwise(F.concat(name, F.lit(":"), "day"))
    rows = adapters.measurements(spark, sf).select(*KEYS, key.alias("key"), F.col("event_id").alias("cursor"))
    dated = F.try_to_date(F.regexp_extract("key", r":(\d{4}-\d{2}-\d{2})$", 1), "yyyy-MM-dd")
    base = ~F.col("key").rlike("^stream:[a-z]+:")
    at = F.when(dated <= F.lit("2024-01-20").cast("date"), F.struct(dated.alias("d"), "cursor"))
    return rows.groupBy(*KEYS).agg(F.coalesce(F.max_by("cursor", at), F.max(F.when(base, F.col("cursor")))).alias("checkpoint"))


@query("""WITH s AS (SELECT user_id, event_type, max(ts) AS attempt, max(ts) FILTER (WHERE value > 60) AS success FROM events GROUP BY ALL), p AS (SELECT user_id, max(ts) - INTERVAL 1 DAY * (user_id % 5) AS failed_at, CASE WHEN user_id % 2 = 0 THEN 'reauth_required' ELSE 'failed' END AS failure FROM events WHERE user_id % 3 > 0 GROUP BY user_id)
  SELECT user_id, event_type, CASE WHEN failed_at > attempt AND (success IS NULL OR failed_at > success) THEN failure ELSE 'stream' END AS state FROM s LEFT JOIN p USING (user_id)""")
def y4_provider_failure(spark, sf):
    e = measured(spark, sf)
    streams = e.groupBy(*KEYS).agg(F.max("ts").alias("attempt"), F.max(F.when(F.col("value") > 60, F.col("ts"))).alias("success")).withColumn("state", F.lit("stream"))
    at = F.timestamp_micros(F.unix_micros(F.max("ts")) - F.first("user_id") % 5 * 86_400_000_000)
    failures = e.where("user_id % 3 > 0").groupBy("user_id").agg(at.alias("failed_at")).withColumn("failure", F.when(F.col("user_id") % 2 == 0, "reauth_required").otherwise("failed"))
    return reading.provider_failure(streams, failures, ["user_id"]).select(*KEYS, "state")


#: Diagnostic tokens and the terminal status they stand for (fixed values).
TERMINAL = {"reauth_required": ("unauthorized", "token_expired", "reauth"), "failed": ("timeout", "server_error"), "partial": ("page_missing", "rate_limited")}
_TOKENS = ["unauthorized", " Timeout ", "page_missing", "strange", "REAUTH", "server_error", "rate_limited", "token_expired"]


@query(f"""SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'reauth_required' WHEN 1 THEN 'failed' WHEN 2 THEN 'partial' WHEN 3 THEN 'unknown' WHEN 4 THEN 'reauth_required' WHEN 5 THEN 'failed' WHEN 6 THEN 'partial' WHEN 7 THEN 'reauth_required' END AS status FROM events""")
def y5_terminal_status(spark, sf):
    token = F.get(F.array(*[F.lit(x) for x in _TOKENS]), (F.col("event_id") % 9).cast("int"))
    return load(spark, sf, "events").select("event_id", reading.terminal_status(token, TERMINAL).alias("status"))


@query(f"WITH {_SCOPES} SELECT family, role, count(*) AS scopes, count(success) AS succeeded, count(evidence_at) AS with_instant, count(evidence_day) AS with_day, count(*) FILTER (WHERE coverage = 'complete') AS complete FROM f GROUP BY ALL")
def y6_scope_facts(spark, sf):
    return scopes(spark, sf).groupBy("family", "role").agg(F.count("*").alias("scopes"), F.count("success").alias("succeeded"), F.count("evidence_at").alias("with_instant"), F.count("evidence_day").alias("with_day"), F.count_if(F.col("coverage") == "complete").alias("complete"))


@query("""WITH s AS (SELECT DISTINCT user_id, event_type FROM events), d AS (SELECT user_id, event_type, unnest(generate_series((SELECT min(ts)::DATE FROM events), (SELECT max(ts)::DATE FROM events), INTERVAL 1 DAY))::DATE AS day FROM s), c AS (SELECT DISTINCT user_id, event_type, ts::DATE AS day FROM events)
  SELECT user_id, event_type, CASE WHEN day >= DATE '2024-01-24' THEN 'inside_trailing' ELSE 'outside_trailing' END AS place, count(*) AS gaps FROM d ANTI JOIN c USING (user_id, event_type, day) GROUP BY ALL""")
def y7_history_gaps(spark, sf):
    m = adapters.measurements(spark, sf)
    return reading.history_gaps(m, m, KEYS, "2024-01-01", "2024-01-30", "2024-01-24").groupBy(*KEYS, "place").agg(F.count("*").alias("gaps"))


@query("""WITH w AS (SELECT DISTINCT user_id, ts::DATE AS day, 'v' || (user_id % 3) AS version FROM events), d AS (SELECT DISTINCT user_id, ts::DATE AS day, 'v' || (event_id % 3) AS version FROM events WHERE event_type = 'view') SELECT user_id, day, version, EXISTS (SELECT 1 FROM d WHERE d.user_id = w.user_id AND d.day = w.day AND d.version = w.version) AS current FROM w""", dates="day")
def y8_current_windows(spark, sf):
    """A window is current only if it was done by the same version."""
    m = adapters.measurements(spark, sf)
    tag = lambda c: F.concat(F.lit("v"), c % 3)
    done = m.where("event_type = 'view'").select("user_id", "day", tag(F.col("event_id")).alias("version")).distinct().withColumn("current", F.lit(True))
    return m.select("user_id", "day", tag(F.col("user_id")).alias("version")).distinct().join(done, ["user_id", "day", "version"], "left").fillna(False, ["current"])


@query("""WITH a AS (SELECT user_id, max(ts) AS at1, max(ts) FILTER (WHERE value > 50) AS ok1 FROM events WHERE event_type IN ('click', 'view') GROUP BY 1), b AS (SELECT user_id, max(ts) AS at2, max(ts) FILTER (WHERE value > 50) AS ok2 FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1),
  r AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_kind, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1) SELECT user_id, greatest(at1, at2) AS attempt, greatest(ok1, ok2) AS success, last_kind, errors FROM r LEFT JOIN a USING (user_id) LEFT JOIN b USING (user_id)""")
def y9_provider_quality(spark, sf):
    """Latest attempt and success over two sources, the latest run's kind, and counts."""
    e = load(spark, sf, "events")
    a = F.col("event_type").isin("click", "view")
    latest = lambda ok, side: F.max(F.when(side & ok, F.col("ts")))
    every, good = F.lit(True), F.col("value") > 50
    return e.groupBy("user_id").agg(
        F.greatest(latest(every, a), latest(every, ~a)).alias("attempt"), F.greatest(latest(good, a), latest(good, ~a)).alias("success"),
        F.max_by("event_type", F.struct("ts", "event_id")).alias("last_kind"), F.count_if(F.col("event_type") == "error").alias("errors"),
    )


@query(f"""WITH {M}, d AS (SELECT user_id, day, count(*) FILTER (WHERE event_type = 'view') AS n, bool_or(k % 4 = 0) AS whole, bool_or(k % 9 = 0) AS failed FROM m GROUP BY ALL) SELECT user_id, day, CASE WHEN failed THEN 'failed' WHEN n > 0 THEN 'present' WHEN whole THEN 'confirmed_empty' ELSE 'unknown' END AS status FROM d""", dates="day")
def y11_acquired_status(spark, sf):
    d = adapters.measurements(spark, sf).groupBy("user_id", "day").agg(F.count_if(F.col("event_type") == "view").alias("n"), F.bool_or(F.col("k") % 4 == 0).alias("whole"), F.bool_or(F.col("k") % 9 == 0).alias("failed"))
    return d.select("user_id", "day", reading.acquired_status(F.col("n"), F.col("whole"), F.col("failed")).alias("status"))


@query(f"""WITH {_SCOPES} SELECT event_type AS scope, arg_min(state, list_position(['unavailable', 'stale', 'unknown', 'quiet', 'fresh', 'not_requested'], state)) AS state, count(*) AS members FROM s GROUP BY event_type""")
def y14_merged_freshness(spark, sf):
    """The worst freshness over the members of a scope."""
    order = F.array(*[F.lit(x) for x in ("unavailable", "stale", "unknown", "quiet", "fresh", "not_requested")])
    s = period.freshness_state(scopes(spark, sf), "2024-01-30 12:00:00")
    return s.groupBy(F.col("event_type").alias("scope")).agg(F.min_by("state", F.array_position(order, F.col("state"))).alias("state"), F.count("*").alias("members"))


@query("""SELECT user_id, ts::DATE AS day, min(event_id) AS first_id, max(event_id) AS cursor, count(*) AS originals FROM events GROUP BY 1, 2""", dates="day")
def y21_saved_dates(spark, sf):
    """The index of originals by day, with the cursor from which the next batch goes on."""
    return adapters.measurements(spark, sf).groupBy("user_id", "day").agg(F.min("event_id").alias("first_id"), F.max("event_id").alias("cursor"), F.count("*").alias("originals"))


@query("""WITH h AS (SELECT o_custkey AS report, max(o_orderkey) AS head, max(o_orderkey) FILTER (WHERE o_orderkey % 2 = 0) AS expected, count(*) AS n FROM orders GROUP BY 1) SELECT report, CASE WHEN expected IS NULL THEN 'missing_expected_head' WHEN expected <> head THEN 'head_moved' ELSE 'accepted' END AS decision FROM h""")
def y25_revision_decision(spark, sf):
    """A revision is accepted only on top of the head that its author saw."""
    h = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("report")).agg(F.max("o_orderkey").alias("head"), F.max(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey"))).alias("expected"))
    return h.select("report", F.when(F.col("expected").isNull(), "missing_expected_head").when(F.col("expected") != F.col("head"), "head_moved").otherwise("accepted").alias("decision"))


@query(f"""WITH {_ACTIVITIES}, e AS (SELECT user_id, identity, count(*) AS n, count(DISTINCT v) AS different, min(event_id) AS first FROM r WHERE identity IS NOT NULL GROUP BY ALL) SELECT user_id, identity, n, CASE WHEN n = 1 THEN 'single' WHEN different > 1 THEN 'conflicting' ELSE 'repeated' END AS evidence FROM e""")
def y30_activity_evidence(spark, sf):
    different = F.count_distinct("value")
    rows = activities(spark, sf).where("identity IS NOT NULL").groupBy("user_id", "identity")
    return rows.agg(F.count("*").alias("n"), F.when(F.count("*") == 1, "single").when(different > 1, "conflicting").otherwise("repeated").alias("evidence"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'purchase') SELECT user_id, event_id, round(value, 7) AS value, n AS place FROM r WHERE n <= 5""")
def y34_activity_listing(spark, sf):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return rounded(load(spark, sf, "events").where("event_type = 'purchase'").withColumn("place", n.cast("long")).where("place <= 5").select("user_id", "event_id", "value", "place"))


@query(f"""WITH {M}, l AS (SELECT *, max(day) OVER (PARTITION BY user_id, event_type) AS newest FROM m), t AS (SELECT *, max(ts) OVER (PARTITION BY user_id, event_type) AS top FROM l WHERE day = newest) SELECT user_id, event_type, max(round(value, 7)) AS value, count(*) AS tied FROM t WHERE ts = top GROUP BY ALL""")
def y35_overview_values(spark, sf):
    """The latest snapshot of each metric."""
    return rounded(identity.latest_snapshot(adapters.measurements(spark, sf), KEYS).groupBy(*KEYS).agg(F.max("value").alias("value"), F.count("*").alias("tied")))


@query("""WITH c AS (SELECT user_id, event_type, max(event_id) AS cursor, (max(ts)::DATE - (user_id % 2)::INT)::DATE AS stored FROM events GROUP BY user_id, event_type), w AS (SELECT user_id, max(ts)::DATE AS day FROM events GROUP BY 1) SELECT user_id, event_type, CASE WHEN stored = day THEN cursor END AS resume, CASE WHEN stored <> day THEN 'another_window' END AS reason FROM c JOIN w USING (user_id)""")
def y39_resume_tokens(spark, sf):
    """A stored cursor is taken up only if it names exactly the asked window."""
    m = adapters.measurements(spark, sf)
    stored = m.groupBy(*KEYS).agg(F.max("event_id").alias("cursor"), F.max("day").alias("last")).withColumn("stored", F.date_sub("last", (F.col("user_id") % 2).cast("int")))
    asked = m.groupBy("user_id").agg(F.max("day").alias("day"))
    same = F.col("stored") == F.col("day")
    return stored.join(asked, "user_id").select(*KEYS, F.when(same, F.col("cursor")).alias("resume"), F.when(~same, "another_window").alias("reason"))


@query("""WITH r AS (SELECT o_orderkey AS run, o_orderdate AS started, CASE o_orderstatus WHEN 'O' THEN 'running' ELSE 'done' END AS status FROM orders) SELECT run, CASE WHEN status = 'running' AND started < TIMESTAMP '1999-01-01' THEN 'interrupted' ELSE status END AS status FROM r""")
def x11_stale_runs(spark, sf):
    rows = load(spark, sf, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderdate").alias("started"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("done").alias("status"))
    return reading.stale_runs(rows, "1999-01-01").select("run", "status")


@query(f"""WITH {M}, p AS (SELECT user_id, day, event_id, row_number() OVER (PARTITION BY user_id, day ORDER BY event_id) - 1 AS page, count(*) OVER (PARTITION BY user_id, day) AS n, k % 13 > 0 AS ok FROM m), q AS (SELECT *, page = n - 1 AND user_id % 4 > 0 AS terminal FROM p)
  SELECT user_id, day, count(*) AS pages, bool_and(ok) AND bool_or(terminal) AS promoted FROM q GROUP BY ALL""", dates="day")
def x9_promoted_refreshes(spark, sf):
    """A refresh counts only if its whole page set came in."""
    w = Window.partitionBy("user_id", "day")
    pages = adapters.measurements(spark, sf).select("user_id", "day", (F.row_number().over(w.orderBy("event_id")) - 1).alias("page"), F.count("*").over(w).alias("n"), (F.col("k") % 13 > 0).alias("ok"))
    marked = reading.promoted(pages.withColumn("terminal", (F.col("page") == F.col("n") - 1) & (F.col("user_id") % 4 > 0)), ["user_id", "day"])
    return marked.groupBy("user_id", "day").agg(F.count("*").alias("pages"), F.bool_and("promoted").alias("promoted"))


# ---- composite packets ---------------------------------------------------------------------------------


def _halves(spark, sf) -> tuple[DataFrame, DataFrame]:
    p = points(spark, sf).where("value IS NOT NULL")
    cut = F.lit("2024-01-16").cast("date")
    side = lambda c: baseline.ordered_means(p.where(c), KEYS, ["day"], "value")
    return side(F.col("day") >= cut), side(F.col("day") < cut)


_HALVES = f"""{P}, n AS (SELECT user_id, event_type, avg(value) AS m, count(*) AS c FROM p WHERE value IS NOT NULL AND day >= DATE '2024-01-16' GROUP BY ALL), b AS (SELECT user_id, event_type, avg(value) AS m, count(*) AS c FROM p WHERE value IS NOT NULL AND day < DATE '2024-01-16' GROUP BY ALL),
  j AS (SELECT coalesce(n.user_id, b.user_id) AS user_id, coalesce(n.event_type, b.event_type) AS event_type, n.m AS nm, b.m AS bm, (n.m - b.m) / abs(b.m) AS r FROM n FULL JOIN b ON n.user_id = b.user_id AND n.event_type = b.event_type),
  f AS (SELECT user_id, event_type, CASE WHEN nm IS NULL THEN 'no_current_values' WHEN bm IS NULL THEN 'no_previous_values' END AS reason, r, CASE WHEN r > 0.1 THEN 'higher' WHEN r < -0.1 THEN 'lower' WHEN r IS NOT NULL THEN 'similar' END AS change FROM j)"""


@query(f"WITH {_HALVES} SELECT user_id, event_type, change, round(r, 6) AS ratio, reason FROM f")
def p12_notable_changes(spark, sf):
    return reading.notable_changes(*_halves(spark, sf), KEYS).withColumn("ratio", rounded_double(F.col("ratio"), 6))


@query(f"WITH {_HALVES} SELECT user_id, count(*) FILTER (WHERE change = 'higher') AS higher, count(*) FILTER (WHERE change = 'lower') AS lower, count(*) FILTER (WHERE change = 'similar') AS similar, count(reason) AS unsaid FROM f GROUP BY user_id")
def q4_period_brief(spark, sf):
    n = lambda x: F.count_if(F.col("change") == x).alias(x)
    return reading.notable_changes(*_halves(spark, sf), KEYS).groupBy("user_id").agg(n("higher"), n("lower"), n("similar"), F.count("reason").alias("unsaid"))


@query(f"""WITH {_ACTIVITIES}, aa AS (SELECT user_id, count(*) FILTER (WHERE reason IS NULL) AS activities, round(sum(v) FILTER (WHERE reason IS NULL), 3) AS seconds, count(*) FILTER (WHERE reason IS NOT NULL) AS refused FROM r GROUP BY user_id), d AS (SELECT user_id, count(DISTINCT day) AS observed_days, 30 - count(DISTINCT day) AS missing_days FROM m GROUP BY user_id)
  SELECT * FROM aa JOIN d USING (user_id)""")
def q3_period_summary(spark, sf):
    """Activities and observed days of a period for each user."""
    ok = F.col("reason").isNull()
    a = activities(spark, sf).groupBy("user_id").agg(F.count_if(ok).alias("activities"), F.round(F.sum(F.when(ok, F.col("value"))), 3).alias("seconds"), F.count_if(~ok).alias("refused"))
    d = adapters.measurements(spark, sf).groupBy("user_id").agg(F.count_distinct("day").alias("observed_days"))
    return a.join(d.withColumn("missing_days", 30 - F.col("observed_days")), "user_id")


@query(f"""WITH {_ACTIVITIES}, t AS (SELECT event_type, reason, count(*) AS n FROM r GROUP BY ALL) SELECT event_type, sum(n) FILTER (WHERE reason IS NULL)::BIGINT AS counted, string_agg(reason || ':' || n, ',' ORDER BY reason) FILTER (WHERE reason IS NOT NULL) AS reasons FROM t GROUP BY event_type""")
def q7_activity_evidence(spark, sf):
    t = activities(spark, sf).groupBy("event_type", "reason").agg(F.count("*").alias("n"))
    why = F.array_join(F.sort_array(F.collect_list(F.when(F.col("reason").isNotNull(), F.concat_ws(":", "reason", "n")))), ",")
    return t.groupBy("event_type").agg(F.sum(F.when(F.col("reason").isNull(), F.col("n"))).alias("counted"), why.alias("reasons"))


@query(f"""WITH {P}, q AS (SELECT user_id, event_type, count(value) AS n, median(value) AS med, arg_max(value, day) AS latest FROM p GROUP BY ALL) SELECT user_id, count(*) AS series, sum(n)::BIGINT AS usable, count(*) FILTER (WHERE n >= 5) AS with_baseline, count(*) FILTER (WHERE n >= 5 AND latest > med) AS above_median FROM q GROUP BY user_id""")
def q2_series_packet(spark, sf):
    """What the baseline suite can say about each user's series."""
    b = baseline.summary(points(spark, sf), KEYS).select(*KEYS, "n", F.col("p50").alias("med"))
    met = b.join(v10_latest_usable(spark, sf).select(*KEYS, F.col("value").alias("latest")), KEYS)
    enough = F.col("n") >= 5
    return met.groupBy("user_id").agg(F.count("*").alias("series"), F.sum("n").alias("usable"), F.count_if(enough).alias("with_baseline"), F.count_if(enough & (F.col("latest") > F.col("med"))).alias("above_median"))


@query(f"""WITH {P}, {W}, e AS (SELECT 'event' AS domain, event_type AS item, count(value) AS usable, count(*) - count(value) AS unusable FROM p GROUP BY 2 UNION ALL SELECT 'weight', grp, count(*) FILTER (WHERE confirmed AND NOT superseded AND unit = 'kg'), count(*) FILTER (WHERE NOT (confirmed AND NOT superseded AND unit = 'kg')) FROM w GROUP BY 2)
  SELECT domain, item, usable, unusable FROM e""")
def q5_chat_evidence(spark, sf):
    e = points(spark, sf).groupBy(F.lit("event").alias("domain"), F.col("event_type").alias("item")).agg(F.count("value").alias("usable"), F.count_if(F.col("value").isNull()).alias("unusable"))
    ok = F.col("reason").isNull()
    w = weight.candidates(adapters.weights(spark, sf)).groupBy(F.lit("weight").alias("domain"), F.col("grp").alias("item")).agg(F.count_if(ok).alias("usable"), F.count_if(~ok).alias("unusable"))
    return e.unionByName(w)


@query(f"""WITH {_ACTIVITIES}, aa AS (SELECT user_id, count(*) FILTER (WHERE reason IS NULL) AS n FROM r GROUP BY 1), e AS (SELECT user_id, count(DISTINCT (event_type, day)) AS n FROM m GROUP BY 1) SELECT 'activity' AS section, user_id, n FROM aa UNION ALL SELECT 'series', user_id, n FROM e""")
def q8_combined_evidence(spark, sf):
    """Sections of several readers as one table."""
    a = activities(spark, sf).groupBy("user_id").agg(F.count_if(F.col("reason").isNull()).alias("n"))
    s = points(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"))
    return a.select(F.lit("activity").alias("section"), "user_id", "n").unionByName(s.select(F.lit("series").alias("section"), "user_id", "n"))


@query(f"""WITH {_ACTIVITIES}, aa AS (SELECT user_id, count(*) FILTER (WHERE reason IS NULL) AS n FROM r GROUP BY 1) SELECT user_id, n, sha256(concat_ws(chr(31), 'v' || user_id, 'v' || n)) AS frozen FROM aa""")
def q9_frozen_period(spark, sf):
    """A period's evidence with the hash that freezes it."""
    a = activities(spark, sf).groupBy("user_id").agg(F.count_if(F.col("reason").isNull()).alias("n"))
    return a.withColumn("frozen", idempotency_key(F.col("user_id"), F.col("n")))


@query(f"""WITH {P}, w AS (SELECT event_type, CASE WHEN day BETWEEN DATE '2024-01-16' AND DATE '2024-01-29' THEN 'now' WHEN day BETWEEN DATE '2024-01-02' AND DATE '2024-01-15' THEN 'before' END AS w, day, value FROM p WHERE value IS NOT NULL),
  a AS (SELECT event_type, avg(value) FILTER (WHERE w = 'now') AS nm, avg(value) FILTER (WHERE w = 'before') AS bm, count(DISTINCT day) FILTER (WHERE w = 'now') AS nd, count(DISTINCT day) FILTER (WHERE w = 'before') AS bd FROM w WHERE w IS NOT NULL GROUP BY 1)
  SELECT event_type, round(nm, 6) AS now_mean, nd AS now_days, round(bm, 6) AS before_mean, bd AS before_days, CASE WHEN nd >= 28.0 / 3 AND bd >= 28.0 / 3 THEN round(nm - bm, 6) END AS delta, CASE WHEN NOT (nd >= 28.0 / 3 AND bd >= 28.0 / 3) THEN 'low_coverage' END AS reason FROM a""")
def q12_overview_comparison(spark, sf):
    return rounded(period.previous_window(points(spark, sf).where("value IS NOT NULL"), ["event_type"], "2024-01-16", 14), 6)


@query("""WITH h AS (SELECT o_custkey AS cust, lower(trim(o_orderpriority)) AS analyte, o_orderkey, o_orderdate::DATE AS day, o_totalprice AS v FROM orders) SELECT analyte, count(*) AS results, count(DISTINCT cust) AS patients, min(day) AS first_day, max(day) AS last_day, arg_max(v, (day, o_orderkey)) AS latest FROM h GROUP BY analyte""", dates="first_day last_day")
def q15_lab_history(spark, sf):
    rows = load(spark, sf, "orders").select("o_custkey", F.lower(F.trim("o_orderpriority")).alias("analyte"), F.to_date("o_orderdate").alias("day"), "o_orderkey", F.col("o_totalprice").alias("v"))
    return rows.groupBy("analyte").agg(F.count("*").alias("results"), F.count_distinct("o_custkey").alias("patients"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.max_by("v", F.struct("day", "o_orderkey")).alias("latest"))


@query(f"""WITH {_ACTIVITIES}, x AS (SELECT event_type, count(*) FILTER (WHERE reason IS NULL) AS counted FROM r GROUP BY 1), s AS (SELECT event_type, sum(k)::BIGINT AS steps, count(DISTINCT (user_id, day)) AS days FROM m GROUP BY 1) SELECT event_type, counted, steps, days, round_even(steps::DOUBLE / days, 1) AS mean FROM x JOIN s USING (event_type)""")
def q16_statistics_page(spark, sf):
    a = activities(spark, sf).groupBy("event_type").agg(F.count_if(F.col("reason").isNull()).alias("counted"))
    d = adapters.measurements(spark, sf).groupBy(*KEYS, "day").agg(F.sum("k").alias("steps"))
    s = reading.exact_mean(d, ["event_type"], "steps", scale=0).select("event_type", F.col("total").cast("long").alias("steps"), F.col("n").alias("days"), "mean")
    return a.join(s, "event_type")


@query(f"""WITH {A} SELECT cohort, count(*) AS n, round(avg(diff), 3) AS bias, round(avg(diff) - 1.96 * stddev_samp(diff), 3) AS low, round(avg(diff) + 1.96 * stddev_samp(diff), 3) AS high, CASE WHEN count(*) < 14 THEN 'insufficient_n' ELSE 'exploratory' END AS exploratory FROM x GROUP BY cohort""")
def q14_agreement_report(spark, sf):
    """The published summary of each cohort."""
    s = association.agreement_summary(association.agreement_dedup(adapters.paired(spark, sf), ["cohort"]), ["cohort"])
    return rounded(s.select("cohort", "n", "bias", F.col("loa_low").alias("low"), F.col("loa_high").alias("high"), F.when(F.col("n") < 14, "insufficient_n").otherwise("exploratory").alias("exploratory")), 3)


@query(f"""WITH {D}, w4 AS (SELECT grp, count(*) AS n, median(value) AS med FROM d GROUP BY grp), l AS (SELECT grp, max(day) AS day, arg_max(value, day) AS v FROM d GROUP BY grp) SELECT grp, n, round(med, 6) AS median, day, round(v, 6) AS latest, round(v - med, 6) AS above_median FROM w4 JOIN l USING (grp)""", dates="day")
def w10_weight_summary(spark, sf):
    d = medians(spark, sf).groupBy("grp").agg(F.count("*").alias("n"), F.median("value").alias("median"), F.max("day").alias("day"), F.max_by("value", "day").alias("latest"))
    return rounded(d.withColumn("above_median", F.col("latest") - F.col("median")), 6)


@query("""WITH n AS (SELECT user_id, count(*) FILTER (WHERE ts::DATE >= DATE '2024-01-24') AS late, count(*) AS every FROM events GROUP BY 1) SELECT user_id, late AS "trailing", every - late AS settled FROM n""")
def x1_trailing_rereads(spark, sf):
    """Rows that the trailing window reads again, and those that are settled."""
    late = F.count_if(F.col("day") >= F.lit("2024-01-24").cast("date"))
    return adapters.measurements(spark, sf).groupBy("user_id").agg(late.alias("trailing"), (F.count("*") - late).alias("settled"))


@query("""SELECT time_bucket(INTERVAL 7 DAYS, ts, TIMESTAMP '2024-01-01') AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL""")
def x8_anchored_bins(spark, sf):
    """Tumbling weeks anchored at a start."""
    w = F.window(F.col("ts"), "7 days", startTime=f"{(19723 % 7)} days")
    return rounded(load(spark, sf, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total"), 3)


@query(f"""WITH {C}, d AS (SELECT cust, count(DISTINCT day) AS n FROM o GROUP BY cust) SELECT n AS days, count(*) AS customers FROM d GROUP BY n""")
def y36_acquisition_listing(spark, sf):
    """How many scopes have how many acquired days."""
    days = adapters.customer_days(spark, sf).groupBy("cust").agg(F.count_distinct("day").alias("days"))
    return days.groupBy("days").agg(F.count("*").alias("customers"))


@query("""WITH s AS (SELECT user_id, event_type, ts::DATE AS day, sum((value * 100)::BIGINT) AS v FROM events GROUP BY ALL) SELECT user_id, day, count(DISTINCT v) AS different, CASE WHEN count(DISTINCT v) = 1 THEN max(v) END::BIGINT AS value FROM s GROUP BY user_id, day""", dates="day")
def y22_observed_projection(spark, sf):
    """A day's value if all its observations agree."""
    s = adapters.measurements(spark, sf).groupBy(*KEYS, "day").agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("v"))
    n = F.count_distinct("v")
    return s.groupBy("user_id", "day").agg(n.alias("different"), F.when(n == 1, F.max("v")).alias("value"))
