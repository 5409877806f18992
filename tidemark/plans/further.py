"""More queries: typed provider values, clock parts, streams' state, lookups and plain windows."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidemark.functions import idempotency_key
from tidemark.operators import clock, coverage, identity, joins, payload, revision
from tidemark.operators.payload import Spec
from tidemark.plans import adapters
from tidemark.plans.adapters import C, D, M
from tidemark.plans.payloads import E, K, json_object, measured, provider_payloads, token
from tidemark.plans.registry import KEYS, medians, query, rounded
from tidemark.session import load


@query(f"""WITH {M} SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'value' WHEN 1 THEN 'null' WHEN 2 THEN 'missing' ELSE 'invalid' END AS text_state, CASE WHEN event_id % 5 = 0 THEN 'abc' END AS text,
  CASE event_id % 3 WHEN 0 THEN 'value' WHEN 1 THEN 'invalid' ELSE 'missing' END AS flag_state, CASE WHEN event_id % 3 = 0 THEN event_id % 2 = 0 END AS flag, CASE event_id % 4 WHEN 0 THEN 'value' WHEN 3 THEN 'missing' ELSE 'invalid' END AS count_state, CASE WHEN event_id % 4 = 0 THEN k END::DOUBLE AS n FROM m""")
def n24_typed_values(spark, sf):
    quoted = F.concat(F.lit('"'), K(), F.lit('"'))
    text = json_object(t=token(5, '" abc "', "null", None, "7", '""'), b=F.when(E() % 3 == 0, F.when(E() % 2 == 0, "true").otherwise("false")).when(E() % 3 == 1, '"true"'), c=token(4, quoted, K(), '"1.5"', None))
    v = F.try_parse_json(text)
    t, b, c = payload.typed(v, "t", "text"), payload.typed(v, "b", "boolean"), payload.typed(v, "c", "count")
    return measured(spark, sf).select("event_id", t["state"].alias("text_state"), t["text"].alias("text"), b["state"].alias("flag_state"), b["flag"].alias("flag"), c["state"].alias("count_state"), c["number"].alias("n"))


@query(f"""WITH {M} SELECT event_id, CASE event_id % 5 WHEN 0 THEN 60 WHEN 1 THEN -330 WHEN 4 THEN 0 END::INT AS offset_minutes, CASE WHEN event_id % 4 = 0 THEN NULL WHEN k < 60 THEN (event_id % 24) * 3600 + k * 60 END::INT AS clock, CASE WHEN event_id % 6 > 0 THEN day END AS civil FROM m""", dates="civil")
def n25_parsed_times(spark, sf):
    o = payload.offset_minutes(token(5, "3600s", "-19800s", "90s", "86400s", "0s"))
    clock_ = payload.clock_time(F.when(E() % 4 > 0, (E() % 24).cast("int")), F.when(E() % 4 > 0, K()), F.lit(None).cast("int"))
    civil = payload.civil_date(F.year("day"), F.when(E() % 6 > 0, F.month("day")).otherwise(13), F.dayofmonth("day"))
    return measured(spark, sf).select("event_id", o.alias("offset_minutes"), clock_.alias("clock"), civil.alias("civil"))


#: Metrics of each stream (fixed values).
STREAMS = {"click": [Spec("pulse", ("heartRate",), "number", "bpm")], "view": [Spec("score", ("score",), "number_or_text"), Spec("note", ("note",), "text")]}


@query(f"""WITH {M} SELECT event_id, 'pulse' AS metric, CASE WHEN event_id % 97 = 0 OR event_id % 8 = 0 THEN 'missing' WHEN event_id % 8 = 1 THEN 'null' WHEN event_id % 8 >= 5 THEN 'value' ELSE 'invalid' END AS state FROM m WHERE event_type = 'click'
  UNION ALL SELECT event_id, 'score', CASE WHEN event_id % 97 = 0 OR event_id % 6 = 3 THEN 'missing' WHEN event_id % 6 < 2 THEN 'value' ELSE 'invalid' END FROM m WHERE event_type = 'view'
  UNION ALL SELECT event_id, 'note', CASE WHEN event_id % 97 = 0 OR event_id % 4 = 0 THEN 'missing' WHEN event_id % 4 = 2 THEN 'value' ELSE 'invalid' END FROM m WHERE event_type = 'view'""")
def n21_stream_normalizers(spark, sf):
    """Each stream by its own specs (N20 chooses by stream)."""
    rows = provider_payloads(spark, sf)
    parts = [payload.normalize(rows.where(F.col("event_type") == s), ["event_id"], "payload", specs) for s, specs in STREAMS.items()]
    return parts[0].unionByName(parts[1]).select("event_id", "metric", "state")


@query(f"""WITH {M}, q AS (SELECT event_id, ['training_readiness', 'training_load', 'aerobic_training_effect'][event_id % 3 + 1] AS metric, k - 10 AS v, event_id % 7 AS c FROM m)
  SELECT event_id, metric, CASE WHEN c = 0 THEN 'missing' WHEN c = 1 THEN 'null' WHEN (event_id % 3 = 0 AND (v < 1 OR v > 100)) OR (event_id % 3 = 1 AND v < 0) OR (event_id % 3 = 2 AND (v < 0 OR v > 5)) THEN 'invalid' ELSE 'value' END AS state FROM q""")
def n19_training_payloads(spark, sf):
    """Training metrics: typed first, then held to their bounds."""
    names = ["training_readiness", "training_load", "aerobic_training_effect"]
    value = F.when(E() % 7 == 1, F.lit("null")).when(E() % 7 > 1, (K() - 10).cast("string"))
    rows = measured(spark, sf).select("event_id", F.element_at(F.array(*[F.lit(x) for x in names]), (E() % 3 + 1).cast("int")).alias("metric"), json_object(value=value).alias("payload"))
    typed = payload.normalize(rows, ["event_id"], "payload", [Spec("value", ("value",))]).drop("metric", "reason").join(rows.select("event_id", "metric"), "event_id")
    refused = payload.activity_quality(F.col("metric"), F.col("number")).isNotNull() & (F.col("state") == "value")
    return typed.select("event_id", "metric", F.when(refused, "invalid").otherwise(F.col("state")).alias("state"))


@query(f"""WITH {M}, e AS (SELECT user_id, event_id, value, CASE WHEN event_id % 7 = 0 THEN 'create' WHEN event_id % 11 = 0 THEN 'remove' ELSE 'revise' END AS action, event_id % 5 AS s FROM m),
  b AS (SELECT user_id, s, max(event_id) FILTER (WHERE action = 'create') AS born, max(event_id) FILTER (WHERE action = 'remove') AS gone FROM e GROUP BY ALL),
  t AS (SELECT e.*, born, gone FROM e JOIN b USING (user_id, s) WHERE born IS NOT NULL AND action <> 'remove' AND (gone IS NULL OR (gone < born AND event_id > gone) OR (gone > born AND event_id < gone)))
  SELECT user_id, s, CASE WHEN coalesce(gone > born, false) THEN 'removed' ELSE 'active' END AS state, CASE WHEN NOT coalesce(gone > born, false) THEN count(*) FILTER (WHERE action = 'revise') END AS revision, CASE WHEN NOT coalesce(gone > born, false) THEN round(arg_max(value, event_id), 7) END AS value FROM t GROUP BY user_id, s, born, gone""")
def k10_session_states(spark, sf):
    action = F.when(E() % 7 == 0, "create").when(E() % 11 == 0, "remove").otherwise("revise")
    rows = load(spark, sf, "events").select(F.struct("user_id", (E() % 5).alias("s")).alias("key"), "event_id", "value", action.alias("action"))
    return rounded(revision.session_state(rows, "key", ["event_id"]).select("key.user_id", "key.s", "state", "revision", "value"))


@query("""SELECT o_custkey AS scope, sha256(concat_ws(chr(31), 'v' || o_custkey, 'v' || string_agg(o_orderkey, ',' ORDER BY o_orderkey))) AS run, count(*) AS inputs FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""")
def k11_selection_runs(spark, sf):
    """A selection run is named by its scope and its sorted inputs, so a repeated run is the same run."""
    rows = load(spark, sf, "orders").where("o_orderstatus <> 'P'").groupBy(F.col("o_custkey").alias("scope")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("ids"))
    return rows.select("scope", idempotency_key(F.col("scope"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")).alias("run"), F.size("ids").cast("long").alias("inputs"))


@query("""SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)""")
def j7_without_incoming_keys(spark, sf):
    keys = load(spark, sf, "events").select(F.col("user_id").alias("o_custkey")).where("o_custkey IS NOT NULL").distinct()
    return load(spark, sf, "orders").join(keys, "o_custkey", "left_anti").select("o_orderkey")


@query("""SELECT event_type, user_id, max(ts) AS watermark, max(ts) FILTER (WHERE value > 50) AS success FROM events GROUP BY ALL""")
def x2_monotone_state(spark, sf):
    """The greatest instants seen, however late rows arrive."""
    rows = load(spark, sf, "events").withColumn("good", F.when(F.col("value") > 50, F.col("ts")))
    return rows.groupBy(*KEYS).agg(F.max("ts").alias("watermark"), F.max("good").alias("success"))


@query("""SELECT user_id, ts::DATE AS day, event_type, min(event_id) AS event_id, count(*) - 1 AS replays FROM events GROUP BY 1, 2, 3""", dates="day")
def x5_replays(spark, sf):
    """Of the rows of one observation key the first counts, the others are replays."""
    rows = revision.observed_once(adapters.measurements(spark, sf), ["user_id", "day", "event_type"], ["event_id"])
    return rows.groupBy("user_id", "day", "event_type").agg(F.min(F.when(F.col("outcome") == "new", F.col("event_id"))).alias("event_id"), F.count_if(F.col("outcome") == "replay").alias("replays"))


@query("""WITH c AS (SELECT user_id, event_type, ts::DATE AS day, max(event_id) AS cursor FROM events GROUP BY ALL) SELECT user_id, event_type, day, cursor, lead(cursor) OVER (PARTITION BY user_id, event_type ORDER BY day) AS next FROM c""", dates="day")
def x4_daily_cursors(spark, sf):
    """The cursor that each day's partition ends with, and the one that follows it."""
    c = adapters.measurements(spark, sf).groupBy(*KEYS, "day").agg(F.max("event_id").alias("cursor"))
    return c.withColumn("next", F.lead("cursor").over(Window.partitionBy(*KEYS).orderBy("day")))


@query(f"WITH {D} SELECT grp, day, round(avg(value) OVER w, 7) AS mean, count(*) OVER w AS n FROM d WINDOW w AS (PARTITION BY grp ORDER BY day RANGE BETWEEN INTERVAL 28 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING)", dates="day")
def v6_preceding_days(spark, sf):
    return rounded(joins.preceding_mean(medians(spark, sf), ["grp"], 28, 1).select("grp", "day", F.col("reference").alias("mean"), "n"))


@query("""SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n = 1""")
def v7_top_by_composite_key(spark, sf):
    best = revision.winner(load(spark, sf, "orders"), ["o_custkey", "o_orderpriority"], [F.desc("o_totalprice"), F.desc("o_orderdate"), "o_orderkey"])
    return best.select("o_custkey", "o_orderpriority", "o_orderkey")


@query("""WITH z AS (SELECT user_id, event_id, coalesce(event_type <> lag(event_type) OVER w, false) AS changed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, count(*) FILTER (WHERE changed) AS changes, count(*) AS n FROM z GROUP BY user_id""")
def v11_change_counts(spark, sf):
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    marked = load(spark, sf, "events").withColumn("changed", F.coalesce(F.col("event_type") != before, F.lit(False)))
    return marked.groupBy("user_id").agg(F.count_if("changed").alias("changes"), F.count("*").alias("n"))


@query("""SELECT user_id, max(event_id) AS event_id FROM events WHERE event_type = 'view' AND value > 30 GROUP BY user_id""")
def o4_latest_seek(spark, sf):
    """The newest row that fits, as one aggregate."""
    return load(spark, sf, "events").where("event_type = 'view' AND value > 30").groupBy("user_id").agg(F.max("event_id").alias("event_id"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity) AS place FROM lineitem""")
def o1_total_order(spark, sf):
    order = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(order).cast("long").alias("place"))


@query("""SELECT o_orderkey AS id, o_orderdate::DATE AS start FROM orders WHERE coalesce(CASE WHEN o_orderkey % 2 = 0 THEN (o_orderdate + INTERVAL 10 DAY)::DATE END, o_orderdate::DATE) >= DATE '1997-06-01' AND o_orderdate::DATE <= DATE '1997-06-30'""", dates="start")
def j18_context_window(spark, sf):
    """Context that overlaps a window; without an end it lasts its first day."""
    start = F.to_date("o_orderdate")
    end = F.coalesce(F.when(F.col("o_orderkey") % 2 == 0, F.date_add(start, 10)), start)
    return load(spark, sf, "orders").where((end >= F.lit("1997-06-01").cast("date")) & (start <= F.lit("1997-06-30").cast("date"))).select(F.col("o_orderkey").alias("id"), start.alias("start"))


@query(f"""WITH {C}, d AS (SELECT DISTINCT * FROM o), e AS (SELECT DISTINCT user_id AS cust, ts::DATE AS day FROM events) SELECT d.cust, count(*) AS days, count(e.day) AS also_observed FROM d LEFT JOIN e ON e.cust = d.cust AND e.day = d.day GROUP BY d.cust""")
def j21_day_intersection(spark, sf):
    """Days of one packet that another one has, too."""
    days = adapters.customer_days(spark, sf).distinct()
    seen = adapters.measurements(spark, sf).select(F.col("user_id").alias("cust"), "day").distinct().withColumn("seen", F.lit(1))
    return days.join(seen, ["cust", "day"], "left").groupBy("cust").agg(F.count("*").alias("days"), F.count("seen").alias("also_observed"))


@query("""SELECT o_orderkey, o_totalprice, l_linenumber, max(l_extendedprice) AS price, round(100 * max(l_extendedprice) / o_totalprice, 5) AS share FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY o_orderkey, o_totalprice, l_linenumber""")
def g6_session_detail(spark, sf):
    met = load(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").join(load(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return met.groupBy("o_orderkey", "o_totalprice", "l_linenumber").agg(F.max("l_extendedprice").alias("price")).withColumn("share", F.round(100 * F.col("price") / F.col("o_totalprice"), 5))


@query("""WITH c AS (SELECT c_custkey AS id, c_mktsegment AS s, c_acctbal AS v FROM customer), x AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1) SELECT s AS lineage, arg_max(c.id, (n, c.id)) AS latest, max(n) AS runs FROM c JOIN x USING (id) GROUP BY s""")
def y13_latest_listing(spark, sf):
    runs = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    met = load(spark, sf, "customer").join(runs, "c_custkey")
    return met.groupBy(F.col("c_mktsegment").alias("lineage")).agg(F.max_by("c_custkey", F.struct("n", "c_custkey")).alias("latest"), F.max("n").alias("runs"))


@query("""WITH n AS (SELECT event_id, event_type, user_id FROM events), s AS (SELECT e.event_id, c_mktsegment AS source, n_name AS place, o.orders FROM n e LEFT JOIN customer ON c_custkey = e.user_id LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1) o ON o.o_custkey = e.user_id)
  SELECT event_id, source, place, orders, CASE WHEN source IS NULL THEN 'missing_source' WHEN orders IS NULL THEN 'missing_attempt' ELSE 'proven' END AS provenance FROM s""")
def y32_evidence_provenance(spark, sf):
    """Where each row comes from, and what of it is missing."""
    attempts = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("orders"))
    met = load(spark, sf, "events").join(load(spark, sf, "customer"), F.col("c_custkey") == F.col("user_id"), "left").join(load(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left").join(attempts, "user_id", "left")
    state = F.when(F.col("c_mktsegment").isNull(), "missing_source").when(F.col("orders").isNull(), "missing_attempt").otherwise("proven")
    return met.select("event_id", F.col("c_mktsegment").alias("source"), F.col("n_name").alias("place"), "orders", state.alias("provenance"))


@query("""WITH h AS (SELECT user_id, event_type, max(event_id) AS head FROM events GROUP BY ALL) SELECT e.event_id, e.event_id = head AS current FROM events e JOIN h ON h.user_id = e.user_id AND h.event_type = e.event_type""")
def d23_current_snapshot(spark, sf):
    e = load(spark, sf, "events")
    heads = identity.newest_wins(e, KEYS, "event_id", "event_id").select("event_id", F.lit(True).alias("current"))
    return e.join(heads, "event_id", "left").select("event_id", F.coalesce("current", F.lit(False)).alias("current"))


@query("""SELECT user_id, event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY date_trunc('hour', ts) DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def d13_newest_receipt(spark, sf):
    received = load(spark, sf, "events").withColumn("received", F.date_trunc("hour", "ts"))
    return identity.newest_wins(received, KEYS, "received", "event_id").select(*KEYS, "event_id", "ts")


@query(f"""WITH {M}, d AS (SELECT user_id, event_type, round(avg(hour(ts) * 60.0 + minute(ts)), 3) AS mean, count(*) AS n, max(day) - min(day) AS span FROM m GROUP BY ALL) SELECT user_id, event_type, n, span::INT AS span, CASE WHEN n < 5 THEN 'too_few' WHEN span < 7 THEN 'too_short' END AS reason FROM d""")
def l5_lag_eligibility(spark, sf):
    """Series that have rows and days enough for lagged statistics."""
    d = adapters.measurements(spark, sf).groupBy(*KEYS).agg(F.count("*").alias("n"), F.datediff(F.max("day"), F.min("day")).alias("span"))
    return d.withColumn("reason", F.when(F.col("n") < 5, "too_few").when(F.col("span") < 7, "too_short"))


@query(f"""WITH {C}, s AS (SELECT cust, count(DISTINCT day) AS n, max(day) - min(day) + 1 AS span FROM o GROUP BY cust) SELECT cust, n, span::INT AS span, round(100.0 * n / span, 6) AS percent FROM s""")
def a8_group_coverage(spark, sf):
    """The share of its span that each group covers."""
    s = adapters.customer_days(spark, sf).groupBy("cust").agg(F.count_distinct("day").alias("n"), (F.datediff(F.max("day"), F.min("day")) + 1).alias("span"))
    return s.withColumn("percent", F.round(F.lit(100.0) * F.col("n") / F.col("span"), 6))


@query(f"""WITH {M}, r AS (SELECT user_id, event_type, day, count(*) AS n FROM m GROUP BY ALL), c AS (SELECT user_id, event_type, count(*) AS days, sum(n)::BIGINT AS n FROM r GROUP BY ALL) SELECT event_type AS metric, user_id % 3 AS cohort, count(*) AS runs, sum(days)::BIGINT AS days, sum(n)::BIGINT AS n FROM c GROUP BY ALL""")
def a11_report_groups(spark, sf):
    r = adapters.measurements(spark, sf).groupBy(*KEYS, "day").agg(F.count("*").alias("n")).groupBy(*KEYS).agg(F.count("*").alias("days"), F.sum("n").alias("n"))
    return r.groupBy(F.col("event_type").alias("metric"), (F.col("user_id") % 3).alias("cohort")).agg(F.count("*").alias("runs"), F.sum("days").alias("days"), F.sum("n").alias("n"))


@query(f"""WITH {M}, x AS (SELECT user_id, event_type, (hour(ts) * 60 + minute(ts)) * 2 * pi() / 1440 AS a FROM m), s AS (SELECT user_id, event_type, avg(cos(a)) AS c, avg(sin(a)) AS s, count(*) AS n FROM x GROUP BY ALL) SELECT user_id, event_type, n, round(sqrt(c * c + s * s), 6) AS resultant FROM s""")
def z16_regularity(spark, sf):
    """How regular each user's clock is, by type."""
    rows = measured(spark, sf).select(*KEYS, (F.hour("ts") * 60 + F.minute("ts")).cast("double").alias("minute"))
    return rounded(clock.circular(rows, KEYS).select(*KEYS, "n", "resultant"), 6)


@query(f"WITH {C}, s AS (SELECT DISTINCT * FROM o) SELECT cust, min(day) AS first_day, max(day) AS last_day, count(*) AS days, date_diff('day', max(day), DATE '2001-12-31')::INT AS age_days FROM s GROUP BY cust", dates="first_day last_day")
def j19_latest_day(spark, sf):
    f = coverage.freshness(adapters.customer_days(spark, sf), ["cust"], "2001-12-31")
    n = adapters.customer_days(spark, sf).distinct().groupBy("cust").agg(F.count("*").alias("days"))
    return f.join(n, "cust").select("cust", F.col("oldest").alias("first_day"), F.col("latest").alias("last_day"), "days", "age_days")
