"""Further queries: evidence bookkeeping, set operations, listings and composite readers."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidemark.functions import noon_unwrapped_median, to_kilograms
from tidemark.operators import association, coverage, evidence, weight
from tidemark.plans import adapters
from tidemark.plans.adapters import A, C, D, M, P
from tidemark.plans.registry import medians, points, query, rounded
from tidemark.session import load


@query("""SELECT user_id, ts::DATE AS day, count(*) AS samples, CASE WHEN count(DISTINCT event_type) = 1 THEN min(event_type) END AS value, CASE WHEN count(DISTINCT event_type) > 1 THEN 'conflict' END AS reason FROM events GROUP BY 1, 2""", dates="day")
def n9_sample_conflicts(spark, sf):
    return evidence.sample_conflicts(adapters.measurements(spark, sf), ["user_id", "day"], "event_type")


@query("""SELECT event_id, CASE WHEN value < 5 THEN 'below_bound' WHEN value > 150 THEN 'above_bound' END AS reason FROM events""")
def n18_bounded_quality(spark, sf):
    return load(spark, sf, "events").select("event_id", evidence.bounded_quality(F.col("value"), 5.0, 150.0).alias("reason"))


@query("""WITH g AS (SELECT l_orderkey, avg(l_extendedprice) AS a, max(l_quantity) * 1800 AS m FROM lineitem GROUP BY 1) SELECT l_orderkey, CASE WHEN a > m THEN 'average_above_maximum' END AS quality FROM g""")
def n17_cross_field_quality(spark, sf):
    g = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.avg("l_extendedprice").alias("a"), (F.max("l_quantity") * 1800).alias("m"))
    return evidence.cross_field_quality(g, "a", "m").select("l_orderkey", "quality")


@query("""SELECT event_id, round(CASE WHEN event_id % 3 = 0 THEN value WHEN event_id % 3 = 1 THEN value * 0.45359237 END, 7) AS kg FROM events""")
def n34_unit_conversion(spark, sf):
    unit = F.when(F.col("event_id") % 3 == 0, "kg").when(F.col("event_id") % 3 == 1, "lb").otherwise("st")
    return rounded(load(spark, sf, "events").select("event_id", to_kilograms(F.col("value"), unit).alias("kg")))


@query("""WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events WHERE value > 100), s AS (SELECT user_id, unnest(generate_series((SELECT min(ts)::DATE FROM events), (SELECT max(ts)::DATE FROM events), INTERVAL 1 DAY))::DATE AS day FROM (SELECT DISTINCT user_id FROM events)),
  t AS (SELECT *, CASE WHEN (user_id + day(day)) % 2 = 0 THEN 'confirmed_empty' ELSE 'present' END AS status FROM s)
  SELECT t.user_id, t.day, CASE WHEN status = 'confirmed_empty' AND d.day IS NOT NULL THEN 'contradictory' ELSE status END AS status FROM t LEFT JOIN d ON d.user_id = t.user_id AND d.day = t.day""", dates="day")
def c8_contradictions(spark, sf):
    m = adapters.measurements(spark, sf)
    spans = adapters.user_spans(spark, sf)
    status = F.when((F.col("user_id") + F.dayofmonth("day")) % 2 == 0, "confirmed_empty").otherwise("present")
    return evidence.contradictions(m.where("value > 100"), coverage.calendar(spans).select("user_id", "day", status.alias("status")), ["user_id"])


@query("""WITH z AS (SELECT *, coalesce(event_type <> lag(event_type) OVER w, false) AS changed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
  SELECT event_id, changed, coalesce(lag(changed) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS after FROM z""")
def z18_travel_detection(spark, sf):
    rows = load(spark, sf, "events").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("id"), "event_type")
    return evidence.zone_changes(rows, ["user_id"], "event_type").select(F.col("id").alias("event_id"), "changed", "after")


@query("""SELECT user_id, ts::DATE AS day, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS zones, count(DISTINCT event_type) AS n FROM events GROUP BY 1, 2""", dates="day")
def t3_zones_per_day(spark, sf):
    return evidence.zones_per_day(adapters.measurements(spark, sf), ["user_id"], "event_type")


@query("""SELECT user_id, count(*) AS attempts, CASE WHEN count(*) FILTER (WHERE value > 20) = count(*) THEN 'succeeded' WHEN count(*) FILTER (WHERE value > 20) = 0 THEN 'failed' ELSE 'partial' END AS run_status FROM events GROUP BY user_id""")
def y10_run_status_of_all(spark, sf):
    return evidence.run_status(load(spark, sf, "events").select("user_id", F.when(F.col("value") > 20, "ok").otherwise("error").alias("status")), ["user_id"])


@query("""WITH w AS (SELECT user_id, max(ts)::DATE AS watermark FROM events GROUP BY 1) SELECT user_id, watermark, CASE WHEN watermark < DATE '2024-01-29' THEN watermark ELSE DATE '2024-01-28' END AS start, DATE '2024-01-29' AS "end" FROM w""", dates="watermark start end")
def y37_incremental_window(spark, sf):
    return evidence.incremental_window(load(spark, sf, "events").groupBy("user_id").agg(F.to_date(F.max("ts")).alias("watermark")), "2024-01-28")


@query("""SELECT event_id FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type, ts::DATE) AS n FROM events) WHERE n = 1""")
def y17_unambiguous_match(spark, sf):
    return evidence.unambiguous_match(adapters.measurements(spark, sf), ["user_id", "event_type", "day"]).select("event_id")


@query("""WITH h AS (SELECT o_custkey AS cust, o_orderpriority AS series, o_orderkey AS id, o_totalprice AS v, CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate::DATE END AS day FROM orders),
  f AS (SELECT *, row_number() OVER (PARTITION BY cust, series ORDER BY day, id) AS a, row_number() OVER (PARTITION BY cust, series ORDER BY day DESC, id DESC) AS b FROM h WHERE day IS NOT NULL)
  SELECT h.cust, h.series, count(h.day) AS dated, count(*) FILTER (WHERE h.day IS NULL) AS undated, any_value(x.v) AS first, any_value(y.v) AS latest, round(any_value(y.v) - any_value(x.v), 3) AS change
  FROM h LEFT JOIN f x ON x.cust = h.cust AND x.series = h.series AND x.a = 1 LEFT JOIN f y ON y.cust = h.cust AND y.series = h.series AND y.b = 1 GROUP BY h.cust, h.series""")
def h6_series_history(spark, sf):
    rows = load(spark, sf, "orders").select(F.col("o_custkey").alias("cust"), F.col("o_orderpriority").alias("series"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"), F.when(F.col("o_orderkey") % 5 > 0, F.to_date("o_orderdate")).alias("day"))
    return rounded(evidence.history(rows, ["cust", "series"]), 3)


@query(f"""WITH {M} SELECT event_type, isodow(day)::INT AS weekday, count(*) FILTER (WHERE k % 4 = 0) AS paired_n, count(*) FILTER (WHERE k % 4 > 0) AS reference_n,
  CASE WHEN count(*) FILTER (WHERE k % 4 = 0) >= 3 AND count(*) FILTER (WHERE k % 4 > 0) >= 3 THEN round(avg(value) FILTER (WHERE k % 4 = 0) - avg(value) FILTER (WHERE k % 4 > 0), 7) END AS difference FROM m GROUP BY 1, 2""")
def z19_context_recovery(spark, sf):
    m = adapters.measurements(spark, sf).select("event_type", (F.weekday("day") + 1).alias("weekday"), "value", F.when(F.col("k") % 4 == 0, "paired").otherwise("reference").alias("role"))
    return rounded(evidence.context_recovery(m, ["event_type", "weekday"]))


@query(f"""WITH {A}, r AS (SELECT cohort, rank() OVER (PARTITION BY cohort ORDER BY a) + (count(*) OVER (PARTITION BY cohort, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY cohort ORDER BY b) + (count(*) OVER (PARTITION BY cohort, b) - 1) / 2.0 AS rb FROM x)
  SELECT cohort, count(*) AS n, round(corr(ra, rb), 5) AS rho FROM r GROUP BY cohort""")
def a3_rank_agreement(spark, sf):
    ranked = adapters.paired(spark, sf).select("cohort", association.mid_rank("a", ["cohort"]).alias("a"), association.mid_rank("b", ["cohort"]).alias("b"))
    return rounded(ranked.groupBy("cohort").agg(F.count("*").alias("n"), association.safe_correlation("a", "b").alias("rho")), 5)


@query("""SELECT event_type, round((median(((hour(ts) * 60 + minute(ts) - 720) % 1440 + 1440) % 1440) + 720) % 1440, 3) AS median_minute FROM events GROUP BY 1""")
def z21_noon_unwrapped_median(spark, sf):
    rows = load(spark, sf, "events").select("event_type", (F.hour("ts") * 60 + F.minute("ts")).cast("double").alias("m"))
    return rounded(rows.groupBy("event_type").agg(noon_unwrapped_median("m").alias("median_minute")), 3)


@query("""SELECT role, sum(strlen(coalesce(text, '')))::BIGINT AS seconds, count(*) AS parts, count(DISTINCT conv_id) AS sessions FROM conversations GROUP BY role""")
def z2_stage_totals(spark, sf):
    n = F.octet_length(F.coalesce("text", F.lit("")))
    return load(spark, sf, "conversations").groupBy("role").agg(F.sum(n).cast("long").alias("seconds"), F.count("*").alias("parts"), F.count_distinct("conv_id").alias("sessions"))


@query(f"""WITH {C}, a AS (SELECT cust, count(*) AS n FROM o GROUP BY cust) SELECT cust, n FROM a WHERE n = (SELECT max(n) FROM a)""")
def o6_record_ties(spark, sf):
    counts = adapters.customer_days(spark, sf).groupBy("cust").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.max("n").alias("n"))), "n").select("cust", "n")


@query(f"""WITH {M}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day, event_id) AS n FROM m), c AS (SELECT user_id, day AS cutoff FROM r WHERE n = 41)
  SELECT r.user_id, count(*) FILTER (WHERE cutoff IS NULL OR day < cutoff) AS kept, any_value(cutoff) AS cutoff FROM r LEFT JOIN c ON c.user_id = r.user_id GROUP BY r.user_id""", dates="cutoff")
def o9_prefix_complete_cutoff(spark, sf):
    order = Window.partitionBy("user_id").orderBy("day", "event_id")
    numbered = adapters.measurements(spark, sf).withColumn("n", F.row_number().over(order))
    cut = numbered.withColumn("cutoff", F.max(F.when(F.col("n") == 41, F.col("day"))).over(Window.partitionBy("user_id")))
    return cut.groupBy("user_id").agg(F.count_if(F.col("cutoff").isNull() | (F.col("day") < F.col("cutoff"))).alias("kept"), F.max("cutoff").alias("cutoff"))


@query("""SELECT DISTINCT coalesce(a.id, b.id) AS id, coalesce(a.day, b.day) AS day FROM (SELECT DISTINCT user_id AS id, ts::DATE AS day FROM events) a FULL JOIN (SELECT DISTINCT o_custkey AS id, o_orderdate::DATE AS day FROM orders) b ON a.id = b.id AND a.day = b.day""", dates="day")
def u2_union_of_days_of_all(spark, sf):
    orders = load(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.to_date("o_orderdate").alias("day"))
    return adapters.measurements(spark, sf).select(F.col("user_id").alias("id"), "day").union(orders).distinct()


@query("""SELECT 'event' AS section, event_type AS item, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'order', o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority""")
def u5_sections(spark, sf):
    e = load(spark, sf, "events").groupBy(F.lit("event").alias("section"), F.col("event_type").alias("item")).agg(F.count("*").alias("n"))
    return e.unionByName(load(spark, sf, "orders").groupBy(F.lit("order").alias("section"), F.col("o_orderpriority").alias("item")).agg(F.count("*").alias("n")))


@query("""SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id, ts::DATE AS day, event_type FROM events) GROUP BY 1""")
def u7_distinct_breakdown(spark, sf):
    return adapters.measurements(spark, sf).select("user_id", "day", "event_type").distinct().groupBy("user_id").agg(F.count("*").alias("n"))


@query(f"""WITH {M}, n AS (SELECT event_id, count(*) OVER (PARTITION BY user_id, day, event_type) AS n, count(*) OVER (PARTITION BY user_id, day) AS d FROM m) SELECT event_id, n > 1 AS duplicate, d FROM n""")
def v13_duplicate_identity(spark, sf):
    m = adapters.measurements(spark, sf)
    return m.select("event_id", (F.count("*").over(Window.partitionBy("user_id", "day", "event_type")) > 1).alias("duplicate"), F.count("*").over(Window.partitionBy("user_id", "day")).alias("d"))


@query(f"""WITH {P}, a AS (SELECT user_id, count(*) FILTER (WHERE status = 'ambiguous') AS ambiguous, count(value) AS usable, count(*) AS candidate, count(*) FILTER (WHERE status IN ('null', 'invalid')) AS excluded FROM p GROUP BY user_id)
  SELECT *, usable + ambiguous + excluded = candidate AS partitioned FROM a""")
def p13_partition_check(spark, sf):
    p = points(spark, sf).groupBy("user_id").agg(F.count_if(F.col("status") == "ambiguous").alias("ambiguous"), F.count("value").alias("usable"), F.count("*").alias("candidate"), F.count_if(F.col("status").isin("null", "invalid")).alias("excluded"))
    return p.withColumn("partitioned", F.col("usable") + F.col("ambiguous") + F.col("excluded") == F.col("candidate"))


@query(f"""WITH {D}, l AS (SELECT grp, arg_max(day, day) AS day, arg_max(value, day) AS v FROM d GROUP BY grp), q AS (SELECT grp, count(*) AS n, median(value) AS med, avg(value) AS mean FROM d GROUP BY grp),
  g AS (SELECT grp, max(step) AS longest FROM (SELECT grp, date_diff('day', lag(day) OVER (PARTITION BY grp ORDER BY day), day) AS step FROM d) GROUP BY grp),
  e AS (SELECT w.grp, count(*) AS excluded FROM w WHERE NOT confirmed OR superseded OR unit <> 'kg' GROUP BY w.grp)
  SELECT grp, day, round(v, 7) AS latest, n, round(med, 7) AS median, round(mean, 7) AS mean, longest::INT AS longest_gap, excluded FROM l JOIN q USING (grp) JOIN g USING (grp) LEFT JOIN e USING (grp)""", dates="day")
def q1_weight_dashboard(spark, sf):
    d = medians(spark, sf)
    last = d.groupBy("grp").agg(F.max("day").alias("day"), F.max_by("value", "day").alias("latest"), F.count("*").alias("n"), F.median("value").alias("median"), F.avg("value").alias("mean"))
    gap = coverage.freshness(d, ["grp"], "2002-01-01").select("grp", F.col("longest_step").alias("longest_gap"))
    out = weight.candidates(adapters.weights(spark, sf)).where("reason IS NOT NULL").groupBy("grp").agg(F.count("*").alias("excluded"))
    return rounded(last.join(gap, "grp").join(out, "grp", "left"))


@query(f"""WITH {P}, w AS (SELECT *, CASE WHEN day BETWEEN DATE '2024-01-22' AND DATE '2024-01-28' THEN 1 ELSE 0 END AS inside FROM p)
  SELECT event_type, count(value) FILTER (WHERE inside = 1) AS n, round(avg(value) FILTER (WHERE inside = 1), 7) AS mean, count(DISTINCT day) FILTER (WHERE inside = 1 AND value IS NOT NULL) AS days,
  7 - count(DISTINCT day) FILTER (WHERE inside = 1 AND value IS NOT NULL) AS missing_days, count(*) FILTER (WHERE inside = 1 AND status = 'ambiguous') AS ambiguous FROM w GROUP BY event_type""")
def q10_weekly_digest(spark, sf):
    p = points(spark, sf).withColumn("inside", F.col("day").between(F.lit("2024-01-22").cast("date"), F.lit("2024-01-28").cast("date")))
    v = F.when(F.col("inside"), F.col("value"))
    days = F.count_distinct(F.when(F.col("inside") & F.col("value").isNotNull(), F.col("day")))
    return rounded(p.groupBy("event_type").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), days.alias("days"), (7 - days).alias("missing_days"), F.count_if(F.col("inside") & (F.col("status") == "ambiguous")).alias("ambiguous")))
