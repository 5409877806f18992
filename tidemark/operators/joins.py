"""Joins with rules: cohort pairing, forward as-of, interval overlap, interval days, preceding windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions import ladder


def pair_by_day(left: DataFrame, right: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Days of either side, for each of keys: paired where each side has exactly one row, else the reason why not."""
    by = [*keys, "day"]
    one = lambda df, v: df.groupBy(*by).agg(F.count("*").alias(f"{v}_rows"), F.first("value").alias(v))
    met = one(left, "a").join(one(right, "b"), by, "full_outer")
    na, nb = F.coalesce("a_rows", F.lit(0)), F.coalesce("b_rows", F.lit(0))
    outcome = ladder((na == 0, "left_missing"), (nb == 0, "right_missing"), ((na > 1) & (nb > 1), "both_ambiguous"), (na > 1, "left_ambiguous"), (nb > 1, "right_ambiguous"), otherwise=F.lit("paired"))
    paired = outcome == "paired"
    return met.select(*by, outcome.alias("outcome"), F.when(paired, F.col("a")).alias("a"), F.when(paired, F.col("b")).alias("b"))


def forward_asof(anchors: DataFrame, events: DataFrame, keys: list[str], seconds: int, span: int = 32) -> DataFrame:
    """For each anchor the first event in [anchor, anchor + seconds]; several at the same first instant are left out.

    Both sides are sorted together by time, latest first, and each anchor takes the last event passed: no pairs are
    made. A key's time is cut into slots of span tolerances, so that a hot key lies in many tasks; the events of a
    slot's first tolerance are given to the slot before it, too. Anchors and events without a time meet nothing.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    width = seconds * 1_000_000
    slot = F.floor(F.col("at") / (width * span))
    own = [*keys, "slot", "at"]
    a = anchors.withColumn("at", at).where("at IS NOT NULL").select(*keys, slot.alias("slot"), "at", F.col("ts").alias("anchor_ts"), "anchor_id", F.lit(None).cast("struct<at: bigint, ties: bigint, event_id: bigint, event_ts: timestamp>").alias("event"))
    once = events.withColumn("at", at).where("at IS NOT NULL").groupBy(*keys, "at").agg(F.count("*").alias("ties"), F.min("event_id").alias("event_id"), F.min("ts").alias("event_ts"))
    both = F.when(F.col("at") - slot * (width * span) <= width, F.array(slot, slot - 1)).otherwise(F.array(slot))
    e = once.select(*keys, F.explode(both).alias("slot"), "at", F.lit(None).cast(anchors.schema["ts"].dataType).alias("anchor_ts"), F.lit(None).cast(anchors.schema["anchor_id"].dataType).alias("anchor_id"), F.struct("at", "ties", F.col("event_id").cast("bigint").alias("event_id"), F.col("event_ts").cast("timestamp").alias("event_ts")).alias("event"))
    following = Window.partitionBy(*keys, "slot").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, 0)
    met = a.select(*own, "anchor_ts", "anchor_id", "event").union(e.select(*own, "anchor_ts", "anchor_id", "event")).withColumn("next", F.last("event", ignorenulls=True).over(following))
    hit = F.col("event").isNull() & (F.col("next.at") - F.col("at") <= width) & (F.col("next.ties") == 1)
    return met.where(hit).select(*keys, "anchor_id", "anchor_ts", F.col("next.event_id").alias("event_id"), F.col("next.event_ts").alias("event_ts"))


def interval_days(intervals: DataFrame, start: str = "start_ts", end: str = "end_ts") -> DataFrame:
    """A row for each civil day that a half-open interval touches; an end at midnight does not touch its day."""
    last = F.to_date(F.col(end) - F.expr("interval 1 microsecond"))
    return intervals.where(F.col(start) < F.col(end)).withColumn("day", F.explode(F.sequence(F.to_date(start), last, F.expr("interval 1 day"))))


def preceding_mean(points: DataFrame, keys: list[str], days: int = 28, least: int = 3) -> DataFrame:
    """Each point with the mean of its group's points in the days before it, itself left out."""
    order = Window.partitionBy(*keys).orderBy(F.datediff("day", F.lit("1970-01-01"))).rangeBetween(-days, -1)
    n = F.count("value").over(order)
    return points.select(*keys, "day", "value", n.alias("n"), F.when(n >= least, F.avg("value").over(order)).alias("reference"))


def against_reference(rows: DataFrame, keys: list[str], reference: DataFrame) -> DataFrame:
    """Absolute and percent difference from the reference value of the same keys; a zero reference has no percent."""
    delta = F.col("value") - F.col("reference")
    return rows.join(reference, keys, "left").select("*", delta.alias("delta"), F.when(F.col("reference") != 0, F.lit(100.0) * delta / F.col("reference")).alias("percent"), ladder((F.col("value").isNull(), "value_absent"), (F.col("reference").isNull(), "reference_absent"), (F.col("reference") == 0, "zero_reference")).alias("reason"))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """Pairs (left_id, right_id) of half-open intervals [s, e) that overlap, of intervals up to seconds long.

    Equi-joined on the time buckets that each interval touches, two at most, and then each pair
    is kept only in the bucket in which the later of the two starts.
    """
    slot = lambda t: F.floor(F.unix_micros(F.col(t).cast("timestamp")) / (seconds * 1_000_000))
    last = F.floor((F.unix_micros(F.col("e").cast("timestamp")) - 1) / (seconds * 1_000_000))
    touched = lambda df: df.withColumns({"own": slot("s"), "slot": F.explode(F.sequence(slot("s"), F.greatest(slot("s"), last)))})
    a = touched(left).select(*keys, "slot", F.col("id").alias("left_id"), F.col("s").alias("ls"), F.col("e").alias("le"), F.col("own").alias("lo"))
    b = touched(right).select(*keys, "slot", F.col("id").alias("right_id"), F.col("s").alias("rs"), F.col("e").alias("re"), F.col("own").alias("ro"))
    meet = (F.col("ls") < F.col("re")) & (F.col("rs") < F.col("le")) & (F.col("slot") == F.greatest("lo", "ro"))
    return a.join(b, [*keys, "slot"]).where(meet).select(*keys, "left_id", "right_id")
