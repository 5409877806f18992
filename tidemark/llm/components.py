"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.llm._common import discard, written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over (u, v) with u > v: every node's neighbours are tied to the least of them."""
    if large:
        sides = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("side")).select("side.*")
        least = sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        out = sides.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        tied = edges.join(least, "u")
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for all nodes of links (a, b); component is the least node reachable.

    Null ends and self-links are left out. Each round is written to the shared folder; the
    number of rounds grows with the logarithm of the nodes. The minima are pre-aggregated;
    the rows of a hub, two longs each, meet their minimum in one task.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links", merged=True)
    state = None
    while True:
        after = written(_stars(_stars(edges, True), False), "links", merged=True)
        now = after.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h")).first()
        discard(edges)
        edges = after
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
