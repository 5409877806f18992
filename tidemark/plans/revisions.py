"""Queries of identity keys, merges and revisions, over orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.functions import idempotency_key
from tidemark.operators import identity, revision
from tidemark.operators.payload import whole_pages
from tidemark.plans import adapters
from tidemark.plans.adapters import M
from tidemark.plans.registry import KEYS, query, rounded
from tidemark.session import load


def _k(n: int, *at: int):
    return (F.col("o_orderkey") % n).isin(*at)


# ---- merges --------------------------------------------------------------------------------


@query("""WITH o AS (SELECT event_id, ts, value FROM events WHERE event_id % 3 <> 0), n AS (SELECT event_id, ts + INTERVAL 1 HOUR * (event_id % 5 - 1) AS ts, CASE WHEN event_id % 4 = 0 THEN value + 1 ELSE value END AS value FROM events WHERE event_id % 7 <> 0),
  j AS (SELECT coalesce(o.event_id, n.event_id) AS event_id, o.event_id IS NOT NULL AS ho, n.event_id IS NOT NULL AND (o.event_id IS NULL OR n.ts >= o.ts) AS newer, o.ts AS ot, n.ts AS nt, o.value AS ov, n.value AS nv FROM o FULL JOIN n ON o.event_id = n.event_id)
  SELECT event_id, CASE WHEN newer THEN nt ELSE ot END AS ts, round(CASE WHEN newer THEN nv ELSE ov END, 7) AS value, CASE WHEN NOT newer THEN 'kept' WHEN NOT ho THEN 'inserted' WHEN nv = ov THEN 'same' ELSE 'changed' END AS action FROM j""")
def k2_record_upsert(spark, sf):
    """An older receipt never rolls back."""
    e = load(spark, sf, "events").select("event_id", "ts", "value")
    i = F.col("event_id")
    moved = e.where("event_id % 7 <> 0").select("event_id", (F.col("ts") + F.make_dt_interval(hours=(i % 5 - 1).cast("int"))).alias("ts"), F.when(i % 4 == 0, F.col("value") + 1).otherwise(F.col("value")).alias("value"))
    return rounded(identity.upsert(e.where("event_id % 3 <> 0"), moved, "event_id", ["value"], "ts"))


_MEMBERS = """v AS (SELECT l_orderkey AS o, l_linenumber AS n, max(l_quantity) AS q FROM lineitem GROUP BY ALL), o AS (SELECT * FROM v WHERE o % 5 <> 0 AND (o + n) % 4 <> 0), i AS (SELECT o, n, CASE WHEN (o + n) % 3 = 0 THEN q + 1 ELSE q END AS q FROM v WHERE o % 7 <> 0 AND (o + n) % 6 <> 0),
  c AS (SELECT DISTINCT o FROM i), j AS (SELECT coalesce(o.o, i.o) AS k, coalesce(o.n, i.n) AS n, o.q AS oq, i.q AS iq, o.o IS NOT NULL AS ho, i.o IS NOT NULL AS hi FROM o FULL JOIN i ON o.o = i.o AND o.n = i.n)"""


@query(f"""WITH {_MEMBERS} SELECT k AS owner, j.n AS member, CASE WHEN c.o IS NULL THEN oq ELSE iq END AS q, CASE WHEN c.o IS NULL THEN 'kept' WHEN NOT hi THEN 'deleted' WHEN NOT ho THEN 'inserted' WHEN oq = iq THEN 'same' ELSE 'changed' END AS action FROM j LEFT JOIN c ON c.o = j.k""")
def k3_member_upsert(spark, sf):
    """Metric rows of a record, stage rows by ordinal (K4): those that the owner came without are deleted."""
    v = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("owner"), F.col("l_linenumber").alias("member")).agg(F.max("l_quantity").alias("q"))
    s = F.col("owner") + F.col("member")
    incoming = v.where((F.col("owner") % 7 != 0) & (s % 6 != 0)).withColumn("q", F.when(s % 3 == 0, F.col("q") + 1).otherwise(F.col("q")))
    return revision.upsert_members(v.where((F.col("owner") % 5 != 0) & (s % 4 != 0)), incoming, "owner", "member", ["q"])


@query(f"""WITH {_MEMBERS} SELECT CASE WHEN c.o IS NULL THEN 'kept' WHEN NOT hi THEN 'deleted' WHEN NOT ho THEN 'inserted' WHEN oq = iq THEN 'same' ELSE 'changed' END AS action, j.n AS ordinal, count(*) AS n FROM j LEFT JOIN c ON c.o = j.k GROUP BY 1, 2""")
def k4_ordinal_upsert(spark, sf):
    return k3_member_upsert(spark, sf).groupBy("action", F.col("member").alias("ordinal")).agg(F.count("*").alias("n"))


@query("""SELECT user_id, event_id, user_id % 3 > 0 AND event_id % 4 = 0 AS retired FROM events""")
def k5_retired_members(spark, sf):
    """Users whose snapshot is complete lose the events it does not name."""
    e = load(spark, sf, "events").select("user_id", "event_id")
    snapshots = e.select("user_id").distinct().withColumn("complete", F.col("user_id") % 3 > 0)
    return revision.retire_vanished(e, snapshots, e.where("event_id % 4 <> 0"), "user_id", "event_id")


@query(f"""WITH {M} SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type, day, k // 25 ORDER BY ts, event_id) = 1 THEN 'new' ELSE 'replay' END AS outcome FROM m""")
def k7_observations(spark, sf):
    m = adapters.measurements(spark, sf).withColumn("slot", F.floor(F.col("k") / 25))
    return revision.observed_once(m, ["user_id", "event_type", "day", "slot"], ["ts", "event_id"]).select("event_id", "outcome")


@query(f"""WITH {M}, f AS (SELECT DISTINCT user_id, event_type, day, CASE WHEN k % 2 = 0 THEN 'present' ELSE 'failed' END AS status FROM m) SELECT user_id, event_type, count(*) AS facts, count(*) FILTER (WHERE status = 'present') AS present FROM f GROUP BY ALL""")
def k8_coverage_facts(spark, sf):
    """A fact that is told twice is one fact."""
    m = adapters.measurements(spark, sf).withColumn("status", F.when(F.col("k") % 2 == 0, "present").otherwise("failed"))
    once = revision.observed_once(m, [*KEYS, "day", "status"], ["ts", "event_id"]).where("outcome = 'new'")
    return once.groupBy(*KEYS).agg(F.count("*").alias("facts"), F.count_if(F.col("status") == "present").alias("present"))


@query("""SELECT user_id, event_type, max(ts) AS last_attempt, max(ts) FILTER (WHERE value > 20) AS last_success, max(ts::DATE) FILTER (WHERE value > 20) AS watermark FROM events GROUP BY ALL""", dates="watermark")
def k9_stream_state(spark, sf):
    rows = adapters.measurements(spark, sf).select(*KEYS, F.col("ts").alias("at"), "day", F.when(F.col("value") > 20, "ok").otherwise("error").alias("status"))
    return revision.stream_state(rows, KEYS)


@query("""WITH b AS (SELECT o_orderkey AS id, o_custkey AS cust, o_orderdate + INTERVAL 1 DAY * (o_orderkey % 900) AS received FROM orders WHERE o_orderkey % 2 = 0), s AS (SELECT o_custkey AS cust, max(o_orderdate) AS newest FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
  SELECT id, coalesce(received < newest, false) AS stale FROM b LEFT JOIN s USING (cust)""")
def d14_stale_collections(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), "o_orderdate")
    received = F.col("o_orderdate") + F.make_dt_interval(days=(F.col("id") % 900).cast("int"))
    stored = o.where("id % 2 = 1").withColumnRenamed("o_orderdate", "observed")
    return revision.stale_collections(o.where("id % 2 = 0").withColumn("received", received), stored, ["cust"]).select("id", "stale")


_REVISIONS = """o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 > 0 THEN o_orderdate END AS u, o_custkey AS iv, o_totalprice AS v FROM orders WHERE o_orderkey % 8 <> 0),
  n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 > 0 THEN o_orderdate + INTERVAL 1 DAY * (o_orderkey % 3 - 1) END AS u, CASE WHEN o_orderkey % 5 = 0 THEN o_custkey + 1 ELSE o_custkey END AS iv, CASE WHEN o_orderkey % 4 > 1 THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 9 <> 0),
  j AS (SELECT coalesce(o.id, n.id) AS id, o.id IS NULL AS fresh, n.id IS NULL AS alone, o.u AS ou, n.u AS nu, o.v AS ov, n.v AS nv, o.iv IS NOT DISTINCT FROM n.iv AS still, o.u IS NOT DISTINCT FROM n.u AS equal FROM o FULL JOIN n ON o.id = n.id),
  r AS (SELECT *, CASE WHEN alone THEN 'kept' WHEN fresh THEN 'inserted' WHEN equal AND still AND ov = nv THEN 'same' WHEN equal THEN 'tie' WHEN nu IS NOT NULL AND (ou IS NULL OR nu > ou) THEN 'revised' ELSE 'kept' END AS x FROM j)"""


def _revised(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    o = load(spark, sf, "orders")
    k = F.col("o_orderkey")
    shifted = F.col("o_orderdate") + F.make_dt_interval(days=(k % 3 - 1).cast("int"))
    current = o.where(k % 8 != 0).select(k.alias("id"), F.when(k % 6 > 0, F.col("o_orderdate")).alias("updated"), F.col("o_custkey").alias("interval"), F.col("o_totalprice").alias("v"))
    interval, v = F.col("o_custkey") + F.when(k % 5 == 0, 1).otherwise(0), F.col("o_totalprice") + F.when(k % 4 > 1, 1).otherwise(0)
    return current, o.where(k % 9 != 0).select(k.alias("id"), F.when(k % 7 > 0, shifted).alias("updated"), interval.alias("interval"), v.alias("v"))


@query(f"""WITH {_REVISIONS}, z AS (SELECT *, CASE WHEN x = 'tie' THEN CASE WHEN still THEN 'revised' ELSE 'kept' END ELSE x END AS outcome FROM r)
  SELECT id, CASE WHEN outcome IN ('inserted', 'revised') THEN nu ELSE ou END AS updated, round(CASE WHEN outcome IN ('inserted', 'revised') THEN nv ELSE ov END, 3) AS v, outcome FROM z""")
def d15_sleep_revisions(spark, sf):
    return rounded(revision.by_provider_time(*_revised(spark, sf), "id", ["v"], "unless_moved"), 3)


@query(f"""WITH {_REVISIONS}, z AS (SELECT *, CASE WHEN x = 'tie' THEN 'invalid' ELSE x END AS outcome FROM r) SELECT id, outcome FROM z""")
def d16_exercise_revisions(spark, sf):
    return revision.by_provider_time(*_revised(spark, sf), "id", ["v"], "invalid").select("id", "outcome")


@query(f"""WITH {_REVISIONS} SELECT x AS outcome, still, count(*) AS n FROM r GROUP BY ALL""")
def k6_revision_counts(spark, sf):
    """What a provider's upsert did, ties told apart by whether the primary interval stayed."""
    current, incoming = _revised(spark, sf)
    done = revision.by_provider_time(current, incoming, "id", ["v"], "invalid").select("id", F.when(F.col("outcome") == "invalid", "tie").otherwise(F.col("outcome")).alias("outcome"))
    met = current.select("id", F.col("interval").alias("a"), F.lit(True).alias("x")).join(incoming.select("id", F.col("interval").alias("b"), F.lit(True).alias("y")), "id", "full_outer")
    return done.join(met, "id").groupBy("outcome", F.col("a").eqNullSafe(F.col("b")).alias("still")).agg(F.count("*").alias("n"))


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 4 END DESC NULLS LAST, CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate END DESC NULLS LAST, o_totalprice, o_orderkey) AS n FROM orders) WHERE n = 1""")
def d17_legacy_winners(spark, sf):
    k = F.col("o_orderkey")
    rows = load(spark, sf, "orders").withColumns({"rev": F.when(k % 3 > 0, k % 4), "seen": F.when(k % 5 > 0, F.col("o_orderdate"))})
    return revision.winner(rows, ["o_custkey"], [F.desc_nulls_last("rev"), F.desc_nulls_last("seen"), "o_totalprice", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("""WITH r AS (SELECT o_orderkey AS id, o_custkey || '/' || year(o_orderdate) AS g, o_orderkey % 5 AS e, o_orderstatus AS s FROM orders), a AS (SELECT g, count(DISTINCT s) AS n, max(e) AS last FROM r GROUP BY g),
  b AS (SELECT r.g, count(DISTINCT s) AS m FROM r JOIN a ON a.g = r.g AND r.e = a.last GROUP BY r.g)
  SELECT id, CASE WHEN n = 1 THEN 'kept' WHEN m <> 1 THEN 'identity_conflict' WHEN e = last THEN 'kept' ELSE 'older_epoch' END AS outcome FROM r JOIN a USING (g) JOIN b USING (g)""")
def d18_identity_migration(spark, sf):
    rows = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.concat_ws("/", "o_custkey", F.year("o_orderdate")).alias("g"), (F.col("o_orderkey") % 5).alias("e"), F.col("o_orderstatus").alias("s"))
    return revision.migrated(rows, "g", "e", "s").select("id", "outcome")


_CHAIN = """c AS (SELECT o_orderkey AS id, o_custkey AS cust, o_orderpriority AS p, o_orderdate AS seen, o_orderstatus <> 'P' AS confirmed, lag(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS supersedes FROM orders)"""


@query(f"""WITH {_CHAIN} SELECT id FROM c WHERE confirmed AND id NOT IN (SELECT supersedes FROM c WHERE supersedes IS NOT NULL)""")
def d20_session_heads(spark, sf):
    rows = _chain(spark, sf)
    return identity.heads(rows, rows).where("confirmed").select("id")


@query(f"""WITH {_CHAIN}, h AS (SELECT * FROM c WHERE id NOT IN (SELECT supersedes FROM c WHERE supersedes IS NOT NULL)) SELECT cust, arg_max(id, (seen, id)) AS id FROM h GROUP BY cust""")
def d21_active_measurement(spark, sf):
    rows = _chain(spark, sf)
    return identity.newest_wins(identity.heads(rows, rows), ["cust"], "at", "id").select("cust", "id")


def _chain(spark, sf) -> DataFrame:
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey"))
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), F.col("o_orderdate").alias("at"), (F.col("o_orderstatus") != "P").alias("confirmed"), before.alias("supersedes"))


@query("""WITH v AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS rev, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS top FROM orders)
  SELECT o_orderkey AS id, rev, rev = top AS head FROM v WHERE coalesce(CASE WHEN o_orderkey % 3 > 0 THEN (o_orderdate + INTERVAL 30 DAY)::DATE END, o_orderdate::DATE) >= DATE '1996-01-01' AND o_orderdate::DATE <= DATE '1998-12-31'""")
def d22_context_revisions(spark, sf):
    """All revisions of context events that overlap a window (J18: coalesce(end, start) on or after its first day, start on or before its last), with whether they are heads."""
    w = Window.partitionBy("o_custkey", "o_orderpriority")
    start = F.to_date("o_orderdate")
    end = F.when(F.col("o_orderkey") % 3 > 0, F.date_add(start, 30))
    rows = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), start.alias("start"), end.alias("end"), F.row_number().over(w.orderBy("o_orderdate", "o_orderkey")).cast("long").alias("rev"), F.count("*").over(w).alias("top"))
    return rows.where((F.coalesce("end", "start") >= F.lit("1996-01-01").cast("date")) & (F.col("start") <= F.lit("1998-12-31").cast("date"))).select("id", "rev", (F.col("rev") == F.col("top")).alias("head"))


@query(f"""WITH {M}, e AS (SELECT user_id, event_id, event_id % 40 AS record, value, CASE event_id % 9 WHEN 0 THEN 'delete' WHEN 1 THEN 'ledger_only' ELSE CASE WHEN event_id % 53 = 0 THEN 'clear' ELSE 'upsert' END END AS action, event_id % 11 = 0 AS anonymous FROM m),
  c AS (SELECT user_id, max(event_id) AS cleared FROM e WHERE action = 'clear' GROUP BY 1), o AS (SELECT user_id, record, max(event_id) AS placed, arg_max(action, event_id) AS action, arg_max(value, event_id) AS value FROM e WHERE action IN ('upsert', 'delete') AND NOT anonymous GROUP BY ALL),
  s AS (SELECT o.*, CASE WHEN cleared > placed THEN 'cleared' WHEN action = 'delete' THEN 'deleted' ELSE 'active' END AS state FROM o LEFT JOIN c USING (user_id))
  SELECT user_id, record, state, CASE WHEN state = 'active' THEN round(value, 7) END AS value FROM s""")
def d24_webhook_ledger(spark, sf):
    i = F.col("event_id")
    action = F.when(i % 9 == 0, "delete").when(i % 9 == 1, "ledger_only").when(i % 53 == 0, "clear").otherwise("upsert")
    rows = load(spark, sf, "events").select("user_id", "event_id", F.when(i % 11 > 0, i % 40).alias("record"), "value", action.alias("action"))
    return rounded(revision.ledger(rows, "user_id", ["event_id"]))


@query("""WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate::DATE END AS l, CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate END AS t FROM orders) SELECT id FROM r WHERE coalesce(l, t::DATE) BETWEEN DATE '1996-03-01' AND DATE '1998-04-30' OR coalesce(l, t::DATE) IS NULL""")
def d26_clip_to_range(spark, sf):
    k = F.col("o_orderkey")
    rows = load(spark, sf, "orders").select(k.alias("id"), F.when(k % 3 == 0, F.to_date("o_orderdate")).alias("local_day"), F.when(k % 4 > 0, F.col("o_orderdate")).alias("ts"))
    return revision.clipped(rows, "1996-03-01", "1998-04-30", False).select("id")


@query(f"""WITH {M}, g AS (SELECT user_id, day, bool_or(k % 31 = 0) AS bad FROM m GROUP BY ALL) SELECT event_type AS source, count(*) AS members FROM m JOIN g USING (user_id, day) WHERE NOT bad GROUP BY 1""")
def d27_page_membership(spark, sf):
    """Points of a page by source; a page with one unresolved point is refused whole."""
    return whole_pages(adapters.measurements(spark, sf), ["user_id", "day"], F.col("k") % 31 == 0).groupBy(F.col("event_type").alias("source")).agg(F.count("*").alias("members"))


@query(f"""WITH {M}, o AS (SELECT user_id, k % 10 AS f, CASE WHEN max(k) % 3 = 0 THEN 'missing' ELSE 'value' END AS s, max(k) AS v FROM m WHERE event_type = 'click' GROUP BY ALL), n AS (SELECT user_id, k % 10 AS f, CASE WHEN max(k) % 4 = 0 THEN 'missing' ELSE 'value' END AS s, max(k) AS v FROM m WHERE event_type = 'view' GROUP BY ALL),
  j AS (SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.f, n.f) AS field, o.s AS os, o.v AS ov, n.s AS ns, n.v AS nv, n.s IS NULL OR (n.s = 'missing' AND o.s IS NOT NULL) AS keeps FROM o FULL JOIN n ON o.user_id = n.user_id AND o.f = n.f)
  SELECT user_id, field, CASE WHEN keeps THEN os ELSE ns END AS state, CASE WHEN keeps THEN ov ELSE nv END AS value, CASE WHEN keeps THEN 'kept' ELSE 'incoming' END AS origin FROM j""")
def d28_evidence_merge(spark, sf):
    m = adapters.measurements(spark, sf).withColumn("field", F.col("k") % 10)
    side = lambda t, n: m.where(F.col("event_type") == t).groupBy("user_id", "field").agg(F.max("k").alias("value")).withColumn("state", F.when(F.col("value") % n == 0, "missing").otherwise("value"))
    return revision.merged_fields(side("click", 3), side("view", 4), ["user_id"], "field")


# ---- keys and hashes -----------------------------------------------------------------------


@query("""WITH p AS (SELECT o_custkey, o_orderpriority, o_orderkey::VARCHAR AS id, sha256(o_orderstatus) AS h FROM orders UNION SELECT o_custkey, o_orderpriority, o_orderkey::VARCHAR, sha256('again') FROM orders WHERE o_orderkey % 97 = 0)
  SELECT o_custkey, o_orderpriority, count(*) AS inputs, CASE WHEN count(*) = count(DISTINCT id) THEN sha256('[' || string_agg('["' || id || '","' || h || '"]', ',' ORDER BY id, h) || ']') END AS hash, CASE WHEN count(*) <> count(DISTINCT id) THEN 'conflicting_content' END AS reason FROM p GROUP BY ALL""")
def d3_snapshot_hash(spark, sf):
    o = load(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderstatus")
    again = o.where("o_orderkey % 97 = 0").withColumn("o_orderstatus", F.lit("again"))
    return revision.snapshot_hash(o.unionByName(again), ["o_custkey", "o_orderpriority"], "o_orderkey", "o_orderstatus")


def _key_sql(*parts: str) -> str:
    return f"sha256(concat_ws(chr(31), {', '.join(parts)}))"


@query(f"""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN {_key_sql("'vrecord'", "'v' || event_id")} WHEN event_id % 4 < 3 THEN {_key_sql("'vsample'", "'v' || (event_id % 100)")} ELSE {_key_sql("'vindex'", "'v' || user_id", "'v' || (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)")} END AS key FROM events""")
def d5_reconciliation_key(spark, sf):
    """By record id, else by sample token, else by place."""
    i = F.col("event_id")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    key = F.when(i % 4 == 0, idempotency_key(F.lit("record"), i)).when(i % 4 < 3, idempotency_key(F.lit("sample"), i % 100)).otherwise(idempotency_key(F.lit("index"), F.col("user_id"), place))
    return load(spark, sf, "events").select("event_id", key.alias("key"))


@query(f"""SELECT event_id, CASE event_type WHEN 'click' THEN {_key_sql("'vprovider'", "'v' || event_id")} WHEN 'view' THEN {_key_sql("'vinterval'", "'v' || user_id", "'v' || epoch_us(ts)", "'v' || (epoch_us(ts) + 60000000)")} ELSE {_key_sql("'vinstant'", "'v' || user_id", "'v' || event_type", "'v' || epoch_us(ts)")} END AS key FROM events""")
def d7_record_identity(spark, sf):
    """Sessions by provider id, intervals by both ends, instants by source, stream and instant: no paths in a key."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    key = (
        F.when(F.col("event_type") == "click", idempotency_key(F.lit("provider"), F.col("event_id")))
        .when(F.col("event_type") == "view", idempotency_key(F.lit("interval"), F.col("user_id"), at, at + 60_000_000))
        .otherwise(idempotency_key(F.lit("instant"), F.col("user_id"), F.col("event_type"), at))
    )
    return load(spark, sf, "events").select("event_id", key.alias("key"))


@query(f"""SELECT {_key_sql("'v' || user_id", "'v' || event_type", "'v' || ts::DATE", "coalesce('v' || CASE WHEN event_id % 3 > 0 THEN event_id % 7 END, 'n')")} AS key, count(*) AS n FROM events GROUP BY 1""")
def d8_observation_keys(spark, sf):
    page = F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 7)
    return adapters.measurements(spark, sf).groupBy(idempotency_key(F.col("user_id"), F.col("event_type"), F.col("day"), page).alias("key")).agg(F.count("*").alias("n"))


@query(f"""WITH {M}, i AS (SELECT event_id, user_id, day AS s, (day + (event_id % 4)::INT)::DATE AS e FROM m) SELECT event_id, CASE WHEN e - s = 1 THEN {_key_sql("'v' || user_id", "'vsteps'", "'v' || s", "'v' || e")} END AS key, CASE WHEN e - s < 1 THEN 'empty_interval' WHEN e - s > 1 THEN 'not_one_day' END AS reason FROM i""")
def d9_civil_interval_key(spark, sf):
    """Only an interval of exactly one civil day has a key."""
    end = F.date_add("day", (F.col("event_id") % 4).cast("int"))
    apart = F.datediff(end, "day")
    key = F.when(apart == 1, idempotency_key(F.col("user_id"), F.lit("steps"), F.col("day"), end))
    return adapters.measurements(spark, sf).select("event_id", key.alias("key"), F.when(apart < 1, "empty_interval").when(apart > 1, "not_one_day").alias("reason"))


@query(f"""WITH x AS (SELECT conv_id, turn, {_key_sql("'v' || role", "coalesce('v' || text, 'n')")} AS key FROM conversations) SELECT key, count(*) AS n, min(conv_id * 100 + turn) AS first FROM x GROUP BY key""")
def d10_ingest_keys(spark, sf):
    rows = load(spark, sf, "conversations").select(idempotency_key(F.col("role"), F.col("text")).alias("key"), (F.col("conv_id") * 100 + F.col("turn")).alias("at"))
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.min("at").alias("first"))


@query(f"""WITH {M} SELECT event_id, CASE WHEN event_id % 3 > 0 THEN {_key_sql("'vstable'", "'v' || user_id", "'v' || event_id")} END AS stable, {_key_sql("'vdelete'", "'v' || user_id", "'v' || day")} AS fallback, {_key_sql("'vsemantic'", "'v' || user_id", "'v' || day", "'v' || k")} AS semantic FROM m""")
def d11_webhook_fingerprints(spark, sf):
    """The stable key of a record id, the fallback that finds it by time, and the key of what it says."""
    u, d = F.col("user_id"), F.col("day")
    stable = F.when(F.col("event_id") % 3 > 0, idempotency_key(F.lit("stable"), u, F.col("event_id")))
    return adapters.measurements(spark, sf).select("event_id", stable.alias("stable"), idempotency_key(F.lit("delete"), u, d).alias("fallback"), idempotency_key(F.lit("semantic"), u, d, F.col("k")).alias("semantic"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber || ':' || max(l_quantity)::INT AS part FROM lineitem GROUP BY l_orderkey, l_linenumber) SELECT l_orderkey, sha256(string_agg(part, ',' ORDER BY part)) AS fingerprint, count(*) AS parts FROM p GROUP BY 1""")
def y28_record_fingerprint(spark, sf):
    parts = load(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("int").alias("q")).select("l_orderkey", F.concat_ws(":", "l_linenumber", "q").alias("part"))
    return parts.groupBy("l_orderkey").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("part")), ","), 256).alias("fingerprint"), F.count("*").alias("parts"))


# ---- runs, queues, listings ----------------------------------------------------------------

_RUNS = """r AS (SELECT o_orderkey AS run, o_custkey AS lineage, o_orderdate AS seen, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'failed' ELSE 'partial' END AS status, CASE WHEN o_orderkey % 4 = 0 THEN lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) END AS supersedes, o_orderkey % 10 = 0 AS replay FROM orders)"""


def _runs(spark, sf) -> DataFrame:
    k = F.col("o_orderkey")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "failed").otherwise("partial")
    return load(spark, sf, "orders").select(k.alias("run"), F.col("o_custkey").alias("lineage"), F.col("o_orderdate").alias("at"), status.alias("status"), F.when(k % 4 == 0, before).alias("supersedes"), (k % 10 == 0).alias("replay"))


@query(f"""WITH {_RUNS}, g AS (SELECT r.*, EXISTS (SELECT 1 FROM r x WHERE x.lineage = r.lineage AND x.supersedes = r.run) AS gone FROM r)
  SELECT lineage, arg_max(run, (seen, run)) FILTER (WHERE status = 'succeeded' AND NOT gone AND NOT replay) AS successful, arg_max(run, (seen, run)) AS "any", arg_max(status, (seen, run)) AS any_status FROM g GROUP BY lineage""")
def y12_latest_runs(spark, sf):
    """Also Y13: the latest successful run and the latest of any status."""
    return revision.latest_runs(_runs(spark, sf), ["lineage"])


@query("""SELECT o_orderpriority AS decision, o_orderstatus AS status, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'O') AS pending FROM orders GROUP BY ALL""")
def y19_queue_counts(spark, sf):
    return load(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("decision"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("pending"))


@query("""SELECT o_custkey AS batch, count(*) FILTER (WHERE o_orderstatus = 'O') AS pending, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def y20_pending_by_batch(spark, sf):
    rows = load(spark, sf, "orders").join(load(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")
    return rows.groupBy(F.col("o_custkey").alias("batch")).agg(F.count_if(F.col("o_orderstatus") == "O").alias("pending"), F.count("*").alias("n"))


@query("""SELECT DISTINCT user_id, ts::DATE AS day FROM events WHERE NOT coalesce(CASE WHEN event_id % 3 > 0 THEN value > 20 END, false) OR ts::DATE = DATE '2024-01-10'""", dates="day")
def y23_candidate_originals(spark, sf):
    """Originals that are not trusted, or of the asked day; unknown trust is none."""
    trusted = F.coalesce(F.when(F.col("event_id") % 3 > 0, F.col("value") > 20), F.lit(False))
    return adapters.measurements(spark, sf).where(~trusted | (F.col("day") == F.lit("2024-01-10").cast("date"))).select("user_id", "day").distinct()


@query("""WITH h AS (SELECT o_custkey, max(o_orderkey) AS head FROM orders GROUP BY 1) SELECT o_orderkey AS revision, c_custkey AS report, c_mktsegment AS title, o_orderkey % 3 = 0 AS corrected FROM h JOIN orders ON o_orderkey = head JOIN customer ON c_custkey = h.o_custkey""")
def y26_report_listing(spark, sf):
    """Reports with the revision that their head names."""
    o = load(spark, sf, "orders")
    heads = o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    listed = heads.join(o.select("o_orderkey"), "o_orderkey").join(load(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return listed.select(F.col("o_orderkey").alias("revision"), F.col("c_custkey").alias("report"), F.col("c_mktsegment").alias("title"), (F.col("o_orderkey") % 3 == 0).alias("corrected"))


@query("""WITH s AS (SELECT o_orderkey AS id, o_custkey AS key, o_orderdate AS seen, o_orderkey % 3 = 0 AS confirmed FROM orders) SELECT key, arg_max(id, (seen, id)) FILTER (WHERE confirmed) AS id, count(*) FILTER (WHERE confirmed) AS found FROM s GROUP BY key HAVING count(*) FILTER (WHERE confirmed) > 0""")
def y18_session_lookup(spark, sf):
    """The newest confirmed session of a semantic key."""
    rows = load(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("at"))
    return rows.groupBy("key").agg(F.max_by("id", F.struct("at", "id")).alias("id"), F.count("*").alias("found"))


@query("""WITH g AS (SELECT DISTINCT o_orderpriority AS scope FROM orders WHERE o_orderstatus = 'F'), p AS (SELECT DISTINCT 'old-' || c_mktsegment AS scope FROM customer UNION SELECT DISTINCT o_orderpriority FROM orders), a AS (SELECT scope FROM g UNION SELECT scope FROM p UNION SELECT 'weight')
  SELECT a.scope, g.scope IS NOT NULL OR a.scope = 'weight' AS current FROM a LEFT JOIN g USING (scope)""")
def y15_scopes_to_recompute(spark, sf):
    """The weight scope, one for each group with evidence, and prior scopes whose evidence has gone."""
    o, c = load(spark, sf, "orders"), load(spark, sf, "customer")
    now = o.where("o_orderstatus = 'F'").select(F.col("o_orderpriority").alias("scope")).distinct()
    prior = c.select(F.concat(F.lit("old-"), "c_mktsegment").alias("scope")).union(o.select("o_orderpriority")).distinct()
    every = now.union(prior).union(spark.createDataFrame([("weight",)], "scope string")).distinct()
    return every.join(now.withColumn("there", F.lit(True)), "scope", "left").select("scope", (F.col("there").isNotNull() | (F.col("scope") == "weight")).alias("current"))
