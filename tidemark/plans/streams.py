"""Queries that run as streams over deliveries made from the tables: late corrections, staged refreshes, webhooks, replays."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.plans import adapters
from tidemark.plans.adapters import M
from tidemark.plans.registry import KEYS, query, rounded
from tidemark.session import load, shared_dir
from tidemark.sources.page_reader import LandedPages
from tidemark.streaming import corrections, pipelines, refreshes, webhooks


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}_{uuid.uuid4().hex}"


def thirds(rows: DataFrame, day: str) -> DataFrame:
    """rows with delivery 0 to 2: thirds of the days that day spans."""
    ends = rows.agg(F.min(day).alias("low"), F.max(day).alias("high"))
    part = F.least(F.lit(2), F.floor(F.datediff(day, F.col("low")) * 3 / (F.datediff("high", "low") + 1)))
    return rows.crossJoin(F.broadcast(ends)).withColumn("delivery", part.cast("int")).drop("low", "high")  # ends is one row


def _receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events that were received up to 10 days after their day."""
    m = adapters.measurements(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    received = F.timestamp_seconds(F.unix_seconds("ts") + F.col("k") % 11 * 86400)
    return thirds(m.select("event_id", "ts", "user_id", "event_type", "value", "day", received.alias("received")).withColumn("on", F.to_date("received")), "on").drop("on")


_RECEIPTS = f"""{M}, r AS (SELECT event_id, user_id, event_type, value, day, date_trunc('second', ts) + (k % 11) * INTERVAL 1 DAY AS received FROM m),
  z AS (SELECT min(received::DATE) AS low, date_diff('day', min(received::DATE), max(received::DATE)) + 1 AS days FROM r),
  s AS (SELECT r.*, least(2, 3 * date_diff('day', low, received::DATE) // days) AS delivery FROM r, z)"""


@query(f"""WITH {_RECEIPTS}, w AS (SELECT delivery, max(max(day)) OVER (ORDER BY delivery) AS newest FROM s GROUP BY delivery), a AS (SELECT s.* FROM s JOIN w USING (delivery) WHERE day >= newest - 6)
  SELECT user_id, event_type, day, event_id, round(value, 7) AS value, received FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, day ORDER BY received DESC, event_id DESC) AS n FROM a) WHERE n = 1""", dates="day")
def x1_trailing_corrections(spark, sf):
    """Three deliveries in order of receipt: each re-opens the seven days before the newest one, and the last receipt of a key and day stays."""
    path, rows = _folder(spark, "corrections"), _receipts(spark, sf)
    for delivery in range(3):
        one = rows.where(F.col("delivery") == delivery).drop("delivery")
        pipelines.land(one, f"{path}/landed")
        corrections.correct(one, path, KEYS, ["received", "event_id"], days=7)
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, received timestamp"
    return rounded(corrections.corrected(spark, path, schema).select("user_id", "event_type", "day", "event_id", "value", "received"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as pages of daily refreshes of a user: pages with k % 13 = 0 never came, users divisible by four send no terminal page."""
    w = Window.partitionBy("user_id", "day")
    m = adapters.measurements(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).withColumns({"page": (F.row_number().over(w.orderBy("event_id")) - 1).cast("int"), "n": F.count("*").over(w)})
    terminal = (F.col("page") == F.col("n") - 1) & (F.col("user_id") % 4 > 0)
    member = F.concat_ws(":", "event_type", (F.col("k") % 7).cast("string"))
    made = m.where("k % 13 > 0").select(F.col("user_id").alias("collection"), "ts", F.unix_date("day").alias("epoch"), "page", terminal.alias("terminal"), member.alias("member"), "day")
    return thirds(made, "day").drop("day")


@query(f"""WITH {M}, p AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY event_id) - 1 AS page, count(*) OVER (PARTITION BY user_id, day) AS n FROM m), c AS (SELECT user_id, day, page, page = n - 1 AND user_id % 4 > 0 AS terminal, event_type || ':' || (k % 7) AS member, ts FROM p WHERE k % 13 > 0),
  r AS (SELECT user_id, day, count(*) AS pages, max(page) + 1 = count(*) AND bool_or(terminal) AS whole, list(DISTINCT member) AS members FROM c GROUP BY ALL), t AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM c),
  g AS (SELECT *, lag(members) OVER (PARTITION BY user_id ORDER BY day) AS old FROM r WHERE whole)
  SELECT user_id AS collection, day, pages, 'promoted' AS outcome, len(list_filter(members, lambda x: NOT list_contains(coalesce(old, []), x))) AS added, len(list_filter(members, lambda x: list_contains(coalesce(old, []), x))) AS kept,
    len(list_filter(coalesce(old, []), lambda x: NOT list_contains(members, x))) AS retired FROM g
  UNION ALL SELECT user_id, day, pages, 'expired', 0, 0, 0 FROM r, t WHERE NOT whole AND (day + 2)::TIMESTAMP <= mark""", dates="day")
def x9_staged_refreshes(spark, sf):
    """Daily refreshes page by page: whole ones are promoted and retire what they no longer hold, incomplete ones expire after two days."""
    path, rows = _folder(spark, "refreshes"), _pages(spark, sf)
    for delivery in range(3):
        one = rows.where(F.col("delivery") == delivery).drop("delivery")
        pipelines.land(one, f"{path}/landed")
        refreshes.refresh(one, path)
    found = refreshes.outcomes(spark, path)
    return found.select("collection", F.date_from_unix_date("epoch").alias("day"), "pages", "outcome", "added", "kept", "retired")


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as webhook bodies in order of arrival; some are no JSON objects, some name no record."""
    i = F.col("event_id")
    event = F.when(i % 9 == 0, "delete").when(i % 9 == 1, "test").when(i % 53 == 0, "clear").when(i % 2 == 0, "insert").otherwise("update")
    body = F.to_json(F.struct(event.alias("event"), F.col("user_id").alias("userId"), F.when(i % 11 > 0, i % 40).alias("id"), F.col("value").alias("weight")))
    return load(spark, sf_dir, "events").select(i.alias("arrived"), F.when(i % 97 == 5, F.concat(F.lit("["), body)).otherwise(body).alias("body"))


@query(f"""WITH {M}, e AS (SELECT user_id, event_id, event_id % 40 AS record, value, CASE event_id % 9 WHEN 0 THEN 'delete' WHEN 1 THEN 'test' ELSE CASE WHEN event_id % 53 = 0 THEN 'clear' ELSE 'upsert' END END AS action, event_id % 11 = 0 AS anonymous FROM m WHERE event_id % 97 <> 5),
  c AS (SELECT user_id, max(event_id) AS cleared FROM e WHERE action = 'clear' GROUP BY 1), o AS (SELECT user_id, record, max(event_id) AS placed, arg_max(action, event_id) AS action, arg_max(value, event_id) AS value FROM e WHERE action IN ('upsert', 'delete') AND NOT anonymous GROUP BY ALL),
  s AS (SELECT o.*, CASE WHEN cleared > placed THEN 'cleared' WHEN action = 'delete' THEN 'deleted' ELSE 'active' END AS state FROM o LEFT JOIN c USING (user_id))
  SELECT user_id, record, state, CASE WHEN state = 'active' THEN round(value, 7) END AS value FROM s""")
def s16_webhook_ingest(spark, sf):
    """Landed bodies, a delivery in three out of turn, to the ledger of records with its tombstones."""
    path, bodies = _folder(spark, "webhooks"), _bodies(spark, sf)
    for delivery in (2, 0, 1):
        pipelines.land(bodies.where(F.col("arrived") % 3 == delivery), f"{path}/landed")
        webhooks.ingest(bodies, path)
    return rounded(webhooks.records(spark, path))


@query("""SELECT user_id, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL""")
def x5_replay_stream(spark, sf):
    """events, then a third of them once more: the stream takes each observation once within its watermark."""
    rows = load(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), *KEYS, "value")
    once = pipelines.replayed(spark, rows, rows.where("event_id % 3 = 0"), "event_id", "ts", "14 days")
    return rounded(once.groupBy(*KEYS).agg(F.count("*").alias("n"), F.sum("value").alias("total")), 3)


def paged(spark: SparkSession, path: str, window: str, columns: str, most: int = 2**31 - 1) -> DataFrame:
    """Takes up the pages that have newly landed below path/pages, from the token that the checkpoint holds; returns all rows so far."""
    spark.dataSource.register(LandedPages)
    schema = f"{columns}, page int, error string"
    rows = spark.readStream.format("landed_pages").schema(schema).option("path", f"{path}/pages").option("window", window).option("maxPages", most).load()
    pipelines.drain(rows.writeStream.outputMode("append").foreachBatch(pipelines.changes(path)), path)
    return pipelines.kept(spark, path, schema).drop("batch")


@query("""WITH p AS (SELECT (event_id // 250)::INT AS page, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1), t AS (SELECT max(page) AS last FROM p)
  SELECT page, CASE WHEN page % 10 = 7 AND page < last THEN 0 ELSE n END AS n, CASE WHEN page % 10 = 7 AND page < last THEN NULL ELSE total END AS total, CASE WHEN page % 10 = 7 AND page < last THEN 'missing_page' END AS error FROM p, t""")
def x4_resumed_pages(spark, sf):
    """events as pages of 250 ids, read up to the middle, then from the token on; every tenth page never came."""
    path = _folder(spark, "pages")
    pages = load(spark, sf, "events").select("event_id", "value", F.floor(F.col("event_id") / 250).cast("int").alias("page"))
    last = pages.agg(F.max("page")).first()[0] or 0
    there = pages.where((F.col("page") % 10 != 7) | (F.col("page") == last))
    for half in (F.col("page") <= last // 2, F.col("page") > last // 2):
        there.where(half).repartition("page").write.mode("append").partitionBy("page").parquet(f"{path}/pages")
        rows = paged(spark, path, "all", "event_id long, value double")
    return rounded(rows.groupBy("page").agg(F.count("event_id").alias("n"), F.sum("value").alias("total"), F.max("error").alias("error")), 3)
