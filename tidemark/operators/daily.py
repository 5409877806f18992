"""Daily-grain readers: one record a day, weeks, steps, latest eligible values, exact means."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions import ladder


def single_record_days(rows: DataFrame, keys: list[str], amount: str) -> DataFrame:
    """Mean over days with exactly one record, as exact decimal sum and count first."""
    days = rows.groupBy(*keys, "day").agg(F.count("*").alias("rows"), F.first(F.col(amount).cast("decimal(18,2)")).alias("v"))
    one = F.when(F.col("rows") == 1, F.col("v"))
    return days.groupBy(*keys).agg(F.count(one).alias("days"), F.count_if(F.col("rows") > 1).alias("ambiguous"), F.sum(one).cast("double").alias("total"), (F.sum(one).cast("double") / F.count(one)).alias("mean"))


def intensity_weeks(days: DataFrame, keys: list[str]) -> DataFrame:
    """Weeks from Monday: moderate + 2 * vigorous over days that have both, and the goal of the last day that has one."""
    both = F.col("moderate") + 2 * F.col("vigorous")
    return days.groupBy(*keys, F.to_date(F.date_trunc("week", "day")).alias("week")).agg(
        F.count(both).alias("paired_days"), F.sum(both).alias("minutes"), F.max_by("goal", F.when(F.col("goal").isNotNull(), F.col("day"))).alias("goal"), (F.count(both) == 7).alias("complete")
    )


def day_state(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A day's value if all values agree; ambiguous if they differ; else the first state present, or unavailable."""
    distinct = F.count_distinct("value")
    state = ladder((distinct > 1, "ambiguous"), (distinct == 1, "value"), (F.bool_or(F.col("state") == "null"), "null"), (F.bool_or(F.col("state") == "invalid"), "invalid"), otherwise=F.lit("unavailable"))
    return rows.groupBy(*keys, "day").agg(state.alias("state"), F.when(distinct == 1, F.max("value")).alias("value"), F.count("*").alias("rows"))


def latest_receipt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The state of the newest receipt of each key; several newest ones that differ are ambiguous."""
    order = Window.partitionBy(*keys).orderBy(F.desc("received"))
    top = rows.withColumn("r", F.rank().over(order)).where("r = 1")
    return top.groupBy(*keys).agg(F.count("*").alias("receipts"), F.count_distinct(F.struct("state", "value")).alias("different"), F.max("value").alias("v"), F.max("state").alias("s")).select(
        *keys, "receipts", F.when(F.col("different") > 1, F.lit("ambiguous")).otherwise(F.col("s")).alias("state"), F.when(F.col("different") == 1, F.col("v")).alias("value")
    )


def steps_statistics(days: DataFrame, keys: list[str], low: int = 10000, high: int = 20000) -> DataFrame:
    """Total, mean, days above the two marks (strictly), and the record with all days that hold it."""
    facts = days.groupBy(*keys).agg(F.sum("value").alias("total"), F.avg("value").alias("mean"), F.count_if(F.col("value") > low).alias("above_low"), F.count_if(F.col("value") > high).alias("above_high"), F.max("value").alias("record"))
    held = days.join(facts.select(*keys, "record"), keys).where(F.col("value") == F.col("record")).groupBy(*keys).agg(F.count("*").alias("record_days"), F.min("day").alias("first_record_day"))
    return facts.join(held, keys)


def latest_eligible(rows: DataFrame, keys: list[str], eligible) -> DataFrame:
    """The newest eligible day of each key and the newer days that were passed over."""
    marked = rows.withColumn("ok", F.coalesce(eligible, F.lit(False)))
    chosen = marked.groupBy(*keys).agg(F.max(F.when(F.col("ok"), F.col("day"))).alias("chosen"), F.max_by("value", F.when(F.col("ok"), F.col("day"))).alias("value"))
    skipped = marked.join(chosen.select(*keys, "chosen"), keys).groupBy(*keys).agg(F.count_if(F.col("chosen").isNull() | (F.col("day") > F.col("chosen"))).alias("passed_over"))
    return chosen.join(skipped, keys)
