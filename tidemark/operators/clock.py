"""Clock statistics on a circle, sleep-like interval checks and stage totals."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions import ladder, noon_unwrapped_median, signed_circular

TURN = 1440.0


def circular(rows: DataFrame, keys: list[str], minutes: str = "minute") -> DataFrame:
    """Circular mean, deviation and resultant of clock minutes; a resultant under 1e-12 has no direction."""
    angle = F.col(minutes) * F.lit(2 * math.pi / TURN)
    c, s = F.avg(F.cos(angle)), F.avg(F.sin(angle))
    base = rows.groupBy(*keys).agg(F.count(minutes).alias("n"), c.alias("c"), s.alias("s"), noon_unwrapped_median(minutes).alias("median"))
    r = F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s"))
    ok = r >= 1e-12
    mean = F.pmod(F.atan2("s", "c") * F.lit(TURN / (2 * math.pi)), F.lit(TURN))
    sd = F.sqrt(F.lit(-2.0) * F.ln(F.least(r, F.lit(1.0)))) * F.lit(TURN / (2 * math.pi))
    return base.select(*keys, "n", F.when(ok, mean).alias("mean"), F.when(ok, sd).alias("sd"), r.alias("resultant"), "median", ladder((~ok, "undefined_direction")).alias("reason"))


def social_jetlag(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Signed difference of the circular means of free days (Saturday, Sunday) and work days."""
    kind = F.when(F.weekday("day") >= 5, "free").otherwise("work").alias("kind")
    means = circular(rows.select(*keys, kind, "minute"), [*keys, "kind"])
    side = lambda k: means.where(F.col("kind") == k).select(*keys, F.col("mean").alias(k), F.col("n").alias(f"{k}_n"))
    return side("free").join(side("work"), keys).select(*keys, "free", "work", "free_n", "work_n", signed_circular(F.col("free"), F.col("work")).alias("jetlag"))


def interval_check(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The first fault of each ordered run of intervals: ordinals, ends, overlaps, holes; and seconds by stage if there is none."""
    order = Window.partitionBy(*keys).orderBy("ordinal")
    before = F.lag("end_ts").over(order)
    fault = ladder(
        (F.col("ordinal") != F.row_number().over(order) - 1, "ordinal_gap"),
        (F.col("start_ts").isNull() | F.col("end_ts").isNull(), "missing_instant"),
        (F.col("end_ts") <= F.col("start_ts"), "end_not_after_start"),
        (before > F.col("start_ts"), "overlap"),
        (before < F.col("start_ts"), "hole"),
    )
    seen = parts.withColumn("fault", fault)
    seconds = F.sum(F.unix_seconds("end_ts") - F.unix_seconds("start_ts"))
    first = F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("ordinal")))
    return seen.groupBy(*keys).agg(F.count("*").alias("parts"), first.alias("fault"), F.when(F.count("fault") == 0, seconds).alias("seconds"))


def stage_seconds(parts: DataFrame, keys: list[str], stages: list[str]) -> DataFrame:
    """Seconds of each named stage of a night; one unmapped stage or reversed interval withholds them all, with the reason."""
    seconds = (F.unix_micros(F.col("end_ts").cast("timestamp")) - F.unix_micros(F.col("start_ts").cast("timestamp"))) / 1_000_000
    each = [F.sum(F.when(F.col("stage") == s, seconds).otherwise(0.0)).alias(s.lower()) for s in stages]
    reason = ladder((F.bool_or(F.col("stage").isNull()), "unmapped_stage"), (F.bool_or(F.col("end_ts") <= F.col("start_ts")), "end_not_after_start"))
    out = parts.groupBy(*keys).agg(*each, reason.alias("reason"))
    return out.select(*keys, *[F.when(F.col("reason").isNull(), F.col(s.lower())).alias(s.lower()) for s in stages], "reason")
