"""Nights: which session of a day counts, stage summaries, time in bed, timing, overlays and the comparison of two providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import finite, ladder, signed_circular


def resolve_nights(sessions: DataFrame, keys: list[str]) -> DataFrame:
    """sessions (day, status, role, duration) with the outcome of each: the gate it fails, else selected, not_main or ambiguous_night.

    Naps never count. Where a day has sessions marked main, only these compete; the only one
    left is the night, several are ambiguous and none counts.
    """
    gate = ladder((F.col("day").isNull(), "missing_wake_date"), (F.col("status") == "retired", "retired"), (F.col("status") == "invalid", "invalid_record"), (F.col("role") == "nap", "nap"), (~F.coalesce(finite(F.col("duration")) & (F.col("duration") > 0), F.lit(False)), "invalid_duration"))
    gated = sessions.withColumn("gate", gate)
    day = Window.partitionBy(*keys, "day")
    ok = F.col("gate").isNull()
    main = ok & (F.col("role") == "main")
    gated = gated.withColumns({"mains": F.count_if(main).over(day), "all": F.count_if(ok).over(day)})
    outcome = F.when(~ok, F.col("gate")).when((F.col("mains") > 0) & (F.col("role") != "main"), "not_main").when(F.when(F.col("mains") > 0, F.col("mains")).otherwise(F.col("all")) == 1, "selected").otherwise("ambiguous_night")
    return gated.withColumn("outcome", outcome).drop("gate", "mains", "all")


def summary_stage_seconds(items: Column, wanted: list[str]) -> Column:
    """struct(of each wanted stage, reason) from a list of (type, minutes, count); a negative or incomplete item, or a type told twice, refuses all."""
    bad = F.exists(items, lambda x: x["type"].isNull() | x["minutes"].isNull() | (x["minutes"] < 0) | (F.coalesce(x["count"], F.lit(0)) < 0))
    types = F.transform(items, lambda x: x["type"])
    reason = ladder((items.isNull() | (F.size(items) == 0), "missing_summary"), (bad, "invalid_item"), (F.size(F.array_distinct(types)) < F.size(types), "repeated_type"))
    of = lambda s: F.aggregate(F.filter(items, lambda x: x["type"] == s), F.lit(0).cast("long"), lambda a, x: a + x["minutes"] * 60)
    return F.struct(*[F.when(reason.isNull(), of(s)).alias(s.lower()) for s in wanted], reason.alias("reason"))


def bounds_match(parts: DataFrame, sessions: DataFrame, keys: list[str]) -> DataFrame:
    """Whether the stages of each session begin and end with it."""
    edges = parts.groupBy(*keys).agg(F.min("start_ts").alias("first"), F.max("end_ts").alias("last"))
    met = sessions.join(edges, keys, "left")
    return met.select(*keys, ladder((F.col("first").isNull(), "no_stages"), (F.col("first") != F.col("start_ts"), "start_differs"), (F.col("last") != F.col("end_ts"), "end_differs"), otherwise=F.lit("match")).alias("bounds"))


def time_in_bed(kind: Column, stage_seconds: Column, stages_complete: Column, summary_minutes: Column, explicit: Column, bound_seconds: Column) -> Column:
    """struct(seconds, reason): one kind of provider gives the sum of complete stages, the other a whole number of summary minutes within the session."""
    stages = (kind == "stages") & stages_complete & (stage_seconds > 0)
    whole = F.coalesce((summary_minutes % 1 == 0) & (summary_minutes >= 0), F.lit(False))
    reason = ladder(
        ((kind == "stages") & ~F.coalesce(stages, F.lit(False)), "incomplete_stages"), (kind == "stages", None), (summary_minutes.isNull(), "missing_summary"), (~whole, "fractional_minutes"),
        (~explicit & ~stages_complete, "unproven_boundary"), (summary_minutes * 60 > bound_seconds, "exceeds_session"),
    )
    return F.struct(F.when(reason.isNull(), F.when(kind == "stages", stage_seconds).otherwise(summary_minutes * 60)).cast("double").alias("seconds"), reason.alias("reason"))


def scalar_outcome(state: Column, value: Column, unit: Column, units: dict[str, float]) -> Column:
    """struct(value, reason) of a metric in its target unit: each accepted unit has a factor, another unit refuses it."""
    factor = F.element_at(F.create_map(*[F.lit(x) for kv in units.items() for x in kv]), F.coalesce(unit, F.lit("")))
    reason = ladder((state.isNull() | (state == "missing"), "missing"), (state != "value", state), (~F.coalesce(finite(value), F.lit(False)), "not_finite"), (factor.isNull(), "unit_mismatch"))
    return F.struct(F.when(reason.isNull(), value * factor).alias("value"), reason.alias("reason"))


def overlay(nights: DataFrame, others: DataFrame, keys: list[str], unit: str) -> DataFrame:
    """nights with the value of the only record of the same day in others (value, unit): none is missing, several are ambiguous."""
    one = others.groupBy(*keys, "day").agg(F.count("*").alias("n"), F.first("value").alias("value"), F.first("unit").alias("unit"))
    met = nights.join(one, [*keys, "day"], "left")
    reason = ladder((F.col("n").isNull(), "missing"), (F.col("n") > 1, "ambiguous"), (F.col("unit") != unit, "unit_mismatch"), (~F.coalesce(finite(F.col("value")), F.lit(False)), "not_finite"))
    return met.select(*keys, "day", F.when(reason.isNull(), F.col("value")).alias("value"), reason.alias("reason"))


def paired_metrics(pairs: DataFrame, values: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Each pair of nights by each metric: comparable with the difference right - left, unavailable with whose value is absent, or excluded with the pair's own reason."""
    every = pairs.select(*keys, "excluded", F.explode(F.array(*[F.lit(m) for m in metrics])).alias("metric"))
    side = lambda s: values.where(F.col("side") == s).select(*keys, "metric", F.col("value").alias(s))
    met = every.join(side("left"), [*keys, "metric"], "left").join(side("right"), [*keys, "metric"], "left")
    status = ladder((F.col("excluded").isNotNull(), "excluded"), (F.col("left").isNull() | F.col("right").isNull(), "unavailable"), otherwise=F.lit("comparable"))
    reason = F.coalesce("excluded", ladder((F.col("left").isNull() & F.col("right").isNull(), "both_missing"), (F.col("left").isNull(), "left_missing"), (F.col("right").isNull(), "right_missing")))
    return met.select(*keys, "metric", status.alias("status"), reason.alias("reason"), F.when(status == "comparable", F.col("right") - F.col("left")).alias("difference"))


def duration_quality(seconds: Column, least: float = 1.0, most: float = 86400.0) -> Column:
    """Why a duration is refused: not finite, below least or above most; bounds are inclusive."""
    return ladder((~F.coalesce(finite(seconds), F.lit(False)), "not_finite"), (seconds < least, "too_short"), (seconds > most, "too_long"))


def two_night_jetlag(nights: DataFrame, keys: list[str]) -> DataFrame:
    """Signed clock shift of each night (minute, zone, seq) against the one before, left out where the zone changed that night or just before."""
    w = Window.partitionBy(*keys).orderBy("seq")
    changed = F.coalesce(F.col("zone") != F.lag("zone").over(w), F.lit(False))
    marked = nights.withColumn("changed", changed).withColumns({"after": F.coalesce(F.lag("changed").over(w), F.lit(False)), "before": F.lag("minute").over(w)})
    reason = ladder((F.col("before").isNull(), "first_night"), (F.col("changed") | F.col("after"), "travel"))
    return marked.select(*keys, "seq", F.when(reason.isNull(), signed_circular(F.col("minute"), F.col("before"))).alias("shift"), reason.alias("reason"))


def local_clock(instant: Column, zone: Column, offset_minutes: Column) -> Column:
    """struct(minute, reason): the local clock minute of an instant; zone and stored offset must agree where both are there."""
    local = F.from_utc_timestamp(instant, F.coalesce(zone, F.lit("UTC")))
    by_zone = (F.unix_micros(local) - F.unix_micros(instant)) / 60_000_000
    offset = F.when(zone.isNotNull(), by_zone).otherwise(offset_minutes)
    reason = ladder((instant.isNull(), "missing_instant"), (zone.isNull() & offset_minutes.isNull(), "missing_zone"), (zone.isNotNull() & (by_zone != offset_minutes), "zone_offset_mismatch"))
    minute = F.pmod(F.unix_micros(instant) / 60_000_000 + offset, F.lit(1440.0))
    return F.struct(F.when(reason.isNull(), F.round(minute, 6)).alias("minute"), reason.alias("reason"))


def source_points(days: DataFrame, sources: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """Every day by every source of a key: its value, or a gap; and how many sources have one that day."""
    every = days.join(sources, keys)
    met = every.join(points, [*keys, "source", "day"], "left")
    present = F.count("value").over(Window.partitionBy(*keys, "day"))
    return met.select(*keys, "source", "day", "value", F.col("value").isNull().alias("gap"), present.alias("present"))
