"""Shapes of the driver tables as the operators read them, each with the same shape in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import ladder
from tidemark.session import load


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as dated measurements; states are derived from props.k, as the table has no natural ones."""
    k = F.get_json_object("props", "$.k").cast("int")
    state = ladder((k % 17 == 0, "null"), (k % 19 == 0, "invalid"), (k % 23 == 0, "partial"), (F.col("value") == 0, "zero"), otherwise=F.lit("value"))
    return load(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", F.to_date("ts").alias("day"), "value", k.alias("k"), state.alias("state"))


def user_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user with the first and the last day of the whole table."""
    m = measurements(spark, sf_dir)
    ends = m.agg(F.min("day").alias("start"), F.max("day").alias("end"))
    return m.select("user_id").distinct().crossJoin(F.broadcast(ends))  # ends is one row


M = """m AS (
  SELECT event_id, ts, user_id, event_type, ts::DATE AS day, value, k,
         CASE WHEN k % 17 = 0 THEN 'null' WHEN k % 19 = 0 THEN 'invalid' WHEN k % 23 = 0 THEN 'partial' WHEN value = 0 THEN 'zero' ELSE 'value' END AS state
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
)"""

#: One point for each (user_id, event_type, day), ambiguous where several rows claim it.
P = M + """, p AS (
  SELECT user_id, event_type, day, "rows", status, CASE WHEN status IN ('value', 'zero', 'partial') THEN v END AS value
  FROM (SELECT user_id, event_type, day, count(*) AS "rows", CASE WHEN count(*) > 1 THEN 'ambiguous' ELSE any_value(state) END AS status, any_value(value) AS v
        FROM m GROUP BY user_id, event_type, day)
)"""


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as dated weights of a group."""
    price = F.col("o_totalprice") / 1000
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("grp"), F.to_date("o_orderdate").alias("day"), price.alias("value"),
        (F.col("o_orderstatus") != "P").alias("confirmed"), (F.col("o_orderkey") % 11 == 0).alias("superseded"), F.when(F.col("o_orderkey") % 13 == 0, "lb").otherwise("kg").alias("unit"),
    )


W = """w AS (
  SELECT o_orderkey AS id, o_orderpriority AS grp, o_orderdate::DATE AS day, o_totalprice / 1000 AS value,
         o_orderstatus <> 'P' AS confirmed, o_orderkey % 11 = 0 AS superseded, CASE WHEN o_orderkey % 13 = 0 THEN 'lb' ELSE 'kg' END AS unit
  FROM orders
)"""

#: Daily medians by group.
D = W + """, d AS (SELECT grp, day, median(value) AS value, count(*) AS n FROM w GROUP BY grp, day)"""


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily means of two return flags by line status as paired measurements a and b."""
    flag = lambda f: F.avg(F.when(F.col("l_returnflag") == f, F.col("l_extendedprice")))
    days = load(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("cohort"), F.to_date("l_shipdate").alias("day")).agg(flag("A").alias("a"), flag("R").alias("b"))
    return days.where("a IS NOT NULL AND b IS NOT NULL").withColumn("diff", F.col("a") - F.col("b"))


A = """x AS (
  SELECT *, a - b AS diff FROM (
    SELECT l_linestatus AS cohort, l_shipdate::DATE AS day, avg(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END) AS a,
           avg(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END) AS b
    FROM lineitem GROUP BY 1, 2) WHERE a IS NOT NULL AND b IS NOT NULL
)"""


def customer_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and last order day of each customer."""
    day = F.to_date("o_orderdate")
    return load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("cust")).agg(F.min(day).alias("start"), F.max(day).alias("end"))


def customer_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cust"), F.to_date("o_orderdate").alias("day"))


C = """o AS (SELECT o_custkey AS cust, o_orderdate::DATE AS day FROM orders), spans AS (SELECT cust, min(day) AS s, max(day) AS e FROM o GROUP BY cust)"""
