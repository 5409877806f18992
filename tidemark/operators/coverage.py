"""Calendars, cadence bins, gaps, islands and interval unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import ladder


def calendar(spans: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """A row for each day of each span, both ends included."""
    return spans.withColumn("day", F.explode(F.sequence(F.col(start), F.col(end), F.expr("interval 1 day"))))


def bins(spans: DataFrame, cadence: int) -> DataFrame:
    """Bins of cadence days from each span's start; the last one is clipped at its end."""
    begun = spans.withColumn("bin_start", F.explode(F.sequence(F.col("start"), F.col("end"), F.expr(f"interval {int(cadence)} day"))))
    return begun.withColumn("bin_end", F.least(F.date_add("bin_start", cadence - 1), F.col("end")))


def bin_number(day: Column, start: Column, cadence: int) -> Column:
    """The bin of a day, as an equi-join key in place of a range join."""
    return F.floor(F.datediff(day, start) / F.lit(cadence)).cast("int")


def bin_status(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """The status of each key: present, else unavailable, else the latest of confirmed_empty and failed, else unknown.

    The latest is by (computed_at, interval_end), confirmed_empty before failed at a tie.
    """
    proof = F.col("status").isin("confirmed_empty", "failed")
    order = F.struct("computed_at", "interval_end", (F.col("status") == "confirmed_empty"))
    latest = F.max_by(F.when(proof, F.col("status")), F.when(proof, order))
    chosen = ladder((F.bool_or(F.col("status") == "present"), "present"), (F.bool_or(F.col("status") == "unavailable"), "unavailable"), otherwise=F.coalesce(latest, F.lit("unknown")))
    return intervals.groupBy(*keys).agg(chosen.alias("status"), F.count("*").alias("facts"))


def window_status(statuses: DataFrame, keys: list[str]) -> DataFrame:
    """complete if every bin is present or proven empty, partial if some are, else missing."""
    good = F.count_if(F.col("status").isin("present", "confirmed_empty"))
    return statuses.groupBy(*keys).agg(F.count("*").alias("bins"), good.alias("good"), ladder((good == F.count("*"), "complete"), (good > 0, "partial"), otherwise=F.lit("missing")).alias("window_status"))


def freshness(days: DataFrame, keys: list[str], as_of: str) -> DataFrame:
    """oldest, latest, days since, and the longest difference between consecutive days."""
    order = Window.partitionBy(*keys).orderBy("day")
    steps = days.select(*keys, "day").distinct().withColumn("step", F.datediff("day", F.lag("day").over(order)))
    return steps.groupBy(*keys).agg(F.min("day").alias("oldest"), F.max("day").alias("latest"), F.datediff(F.lit(as_of).cast("date"), F.max("day")).alias("age_days"), F.max("step").alias("longest_step"))


def gaps(days: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of days without an observation in each span: leading, internal or trailing."""
    edges = spans.select(*keys, F.date_sub("start", 1).alias("day")).unionByName(spans.select(*keys, F.date_add("end", 1).alias("day")))
    inside = days.join(spans, keys).where(F.col("day").between(F.col("start"), F.col("end"))).select(*keys, "day").distinct()
    order = Window.partitionBy(*keys).orderBy("day")
    steps = inside.unionByName(edges).withColumns({"next": F.lead("day").over(order), "n": F.row_number().over(order), "all": F.count("*").over(Window.partitionBy(*keys))})
    length = F.datediff("next", "day") - 1
    kind = ladder((F.col("n") == 1, "leading"), (F.col("n") == F.col("all") - 1, "trailing"), otherwise=F.lit("internal"))
    return steps.where(length > 0).select(*keys, F.date_add("day", 1).alias("gap_start"), F.date_sub("next", 1).alias("gap_end"), length.alias("days"), kind.alias("kind"))


def islands(days: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of consecutive days."""
    order = Window.partitionBy(*keys).orderBy("day")
    run = F.date_sub("day", F.row_number().over(order)).alias("run")
    return days.select(*keys, "day").distinct().select(*keys, "day", run).groupBy(*keys, "run").agg(F.min("day").alias("start"), F.max("day").alias("end"), F.count("*").alias("days")).drop("run")


def longest_islands(days: DataFrame, keys: list[str], value: str | None = None, least: float = 10000) -> DataFrame:
    """All runs of consecutive days that are as long as the longest; with value, of the days whose value is at least least."""
    found = islands(days if value is None else days.where(F.col(value) >= least), keys)
    return found.withColumn("most", F.max("days").over(Window.partitionBy(*keys))).where(F.col("days") == F.col("most")).drop("most")


def union_complete(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Whether clipped half-open intervals cover [start, end) of their key without a hole."""
    clipped = intervals.withColumns({"s": F.greatest("interval_start", "start"), "e": F.least("interval_end", "end")}).where("s < e")
    order = Window.partitionBy(*keys).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    swept = clipped.withColumn("reach", F.max("e").over(order))
    hole = F.bool_or(F.col("s") > F.col("reach"))
    return swept.groupBy(*keys).agg(F.count("*").alias("parts"), (~F.coalesce(hole, F.lit(False)) & (F.min("s") <= F.max("start")) & (F.max("e") >= F.max("end"))).alias("complete"))


def missing_days(days: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Calendar days without an observation."""
    return calendar(spans.select(*keys, "start", "end")).select(*keys, "day").join(days.select(*keys, "day").distinct(), [*keys, "day"], "left_anti")
