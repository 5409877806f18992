"""Evidence bookkeeping: sample conflicts, quality bounds, coverage contradictions, zones, run roll-ups, incremental windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import ladder


def sample_conflicts(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Samples of one coordinate: equal values collapse to one, different ones reject the coordinate."""
    n = F.count_distinct(value)
    return samples.groupBy(*keys).agg(F.count("*").alias("samples"), F.when(n == 1, F.min(value)).alias("value"), F.when(n > 1, F.lit("conflict")).alias("reason"))


def bounded_quality(value: Column, low: float | None, high: float | None) -> Column:
    """The reason why a measured value is out of bounds; null where it is in them or absent."""
    rules = [(F.isnan(value), "not_finite")]
    if low is not None:
        rules.append((value < low, "below_bound"))
    if high is not None:
        rules.append((value > high, "above_bound"))
    return ladder(*rules)


def cross_field_quality(rows: DataFrame, average: str, most: str) -> DataFrame:
    """Marks rows whose average exceeds their maximum."""
    return rows.withColumn("quality", ladder((F.col(average) > F.col(most), "average_above_maximum")))


def contradictions(days: DataFrame, statuses: DataFrame, keys: list[str]) -> DataFrame:
    """Status days, contradictory where something was observed on a day proven empty."""
    seen = days.select(*keys, "day").distinct().withColumn("observed", F.lit(True))
    state = F.when((F.col("status") == "confirmed_empty") & F.col("observed"), F.lit("contradictory")).otherwise(F.col("status"))
    return statuses.join(seen, [*keys, "day"], "left").select(*keys, "day", state.alias("status"))


def zone_changes(rows: DataFrame, keys: list[str], zone: str) -> DataFrame:
    """Rows in order with whether the zone changed, and whether it had changed just before (the night after travel)."""
    order = Window.partitionBy(*keys).orderBy("at", "id")
    changed = F.coalesce(F.col(zone) != F.lag(zone).over(order), F.lit(False))
    marked = rows.withColumn("changed", changed)
    return marked.withColumn("after", F.coalesce(F.lag("changed").over(order), F.lit(False)))


def zones_per_day(rows: DataFrame, keys: list[str], zone: str) -> DataFrame:
    """The sorted set of zones of each day."""
    return rows.groupBy(*keys, "day").agg(F.array_join(F.sort_array(F.collect_set(zone)), ",").alias("zones"), F.count_distinct(zone).alias("n"))


def run_status(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """succeeded if all attempts did, failed if all failed, else partial."""
    ok = F.col("status") == "ok"
    return attempts.groupBy(*keys).agg(F.count("*").alias("attempts"), ladder((F.bool_and(ok), "succeeded"), (~F.bool_or(ok), "failed"), otherwise=F.lit("partial")).alias("run_status"))


def incremental_window(state: DataFrame, as_of: str) -> DataFrame:
    """[watermark day, as_of + 1) where the watermark lies before its end, else a first run of one day."""
    end = F.date_add(F.lit(as_of).cast("date"), 1)
    start = F.when(F.col("watermark") < end, F.col("watermark")).otherwise(F.date_sub(end, 1))
    return state.select("*", start.alias("start"), end.alias("end"))


def unambiguous_match(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that are the only one of their logical key."""
    return rows.withColumn("n", F.count("*").over(Window.partitionBy(*keys))).where("n = 1").drop("n")


def history(rows: DataFrame, keys: list[str]) -> DataFrame:
    """First and latest dated value of each series by (day, id), their change, the numbers of dated and undated ones."""
    by_day = F.when(F.col("day").isNotNull(), F.struct("day", "id"))
    out = rows.groupBy(*keys).agg(F.count("day").alias("dated"), F.count_if(F.col("day").isNull()).alias("undated"), F.min_by("value", by_day).alias("first"), F.max_by("value", by_day).alias("latest"))
    return out.withColumn("change", F.col("latest") - F.col("first"))


def signed_delta(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """right - left of two cells, or the first reason why it is refused."""
    met = left.select(*keys, F.col("mean").alias("l"), F.col("eligible").alias("l_n")).join(right.select(*keys, F.col("mean").alias("r"), F.col("eligible").alias("r_n")), keys, "full_outer")
    reason = ladder((F.coalesce("l_n", F.lit(0)) == 0, "left_unavailable"), (F.coalesce("r_n", F.lit(0)) == 0, "right_unavailable"))
    return met.select(*keys, F.when(reason.isNull(), F.col("r") - F.col("l")).alias("delta"), reason.alias("reason"))


def context_recovery(points: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """Means of paired and reference rows of each key and their difference; each role needs least rows."""
    of = lambda role, f: f(F.when(F.col("role") == role, F.col("value")))
    met = points.groupBy(*keys).agg(of("paired", F.count).alias("paired_n"), of("reference", F.count).alias("reference_n"), of("paired", F.avg).alias("paired"), of("reference", F.avg).alias("reference"))
    ok = (F.col("paired_n") >= least) & (F.col("reference_n") >= least)
    return met.select(*keys, "paired_n", "reference_n", F.when(ok, F.col("paired") - F.col("reference")).alias("difference"))
