"""Scalar baselines: series with explicit states, quantiles, mid-rank position, robust z, trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions import ladder, mid_rank_share
from tidemark.operators.order_statistics import LIMIT, larger, quantiles
from tidemark.operators.slopes import median_slopes

QUANTILES = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
Z_SCALE = 0.67448975  # fixed value
Z_FLAG = 3.5  # fixed value


def series(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """One point for each (keys, day): its state, or 'ambiguous' with no value where several rows claim the day."""
    n = F.count("*").alias("rows")
    one = candidates.groupBy(*keys, "day").agg(n, F.first("state").alias("s"), F.first("value").alias("v"))
    status = F.when(F.col("rows") > 1, F.lit("ambiguous")).otherwise(F.col("s"))
    usable = status.isin("value", "zero", "partial")
    return one.select(*keys, "day", "rows", status.alias("status"), F.when(usable, F.col("v")).alias("value"))


def ordered_means(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """mean and n of the values of each key, added up one by one in the given order.

    A sum of doubles depends on its order, and this one holds however the rows are dealt to tasks. order is unique among the
    rows of a key; the running sum passes sorted rows and holds none of them.
    """
    sofar = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = rows.where(F.col(value).isNotNull()).select(*keys, F.sum(value).over(sofar).alias("total"), F.count("*").over(sofar).alias("n"))
    return steps.groupBy(*keys).agg(F.max_by("total", "n").alias("total"), F.max("n").alias("n")).select(*keys, (F.col("total") / F.col("n")).alias("mean"), "n")


def availability(points: DataFrame, keys: list[str]) -> DataFrame:
    """Points of each status; usable holds values, zeros and partial values."""
    codes = ["value", "zero", "partial", "null", "invalid", "ambiguous"]
    counts = [F.count_if(F.col("status") == c).alias(f"n_{c}") for c in codes]
    return points.groupBy(*keys).agg(*counts, F.count_if(F.col("value").isNotNull()).alias("n_usable"))


def summary(points: DataFrame, keys: list[str], limit: int = LIMIT) -> DataFrame:
    """count, mean, median, extremes and linear-interpolation quantiles of the usable values; no_usable_values where none."""
    others = [F.count("value").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.when(F.count("value") == 0, F.lit("no_usable_values")).alias("reason")]
    return quantiles(points, keys, "value", QUANTILES, *others, limit=limit).select(*keys, "n", "mean", "least", "most", *QUANTILES, "reason")


def latest_position(points: DataFrame, keys: list[str], least: int = 5) -> DataFrame:
    """Mid-rank percentile of the latest usable value among all of them; null with fewer than least."""
    usable = points.where("value IS NOT NULL")
    last = usable.groupBy(*keys).agg(F.max_by("value", "day").alias("latest"), F.count("*").alias("n"))
    met = usable.join(last, keys).groupBy(*keys, "latest", "n").agg(F.count_if(F.col("value") < F.col("latest")).alias("less"), F.count_if(F.col("value") == F.col("latest")).alias("equal"))
    share = mid_rank_share(F.col("less"), F.col("equal"), F.col("n"))
    return met.select(*keys, "latest", "n", F.when(F.col("n") >= least, share).alias("percentile"))


def robust_z(points: DataFrame, keys: list[str], least: int = 5, limit: int | None = LIMIT) -> DataFrame:
    """Modified z of the latest value; unavailable where values are few or the median deviation is 0, which is still reported."""
    usable = points.where("value IS NOT NULL")
    if larger(usable, keys, "value", limit).isEmpty():  # asked once for both medians
        limit = None
    middle = quantiles(usable, keys, "value", {"median": 0.5}, F.count("*").alias("n"), F.max_by("value", "day").alias("latest"), limit=limit)
    apart = usable.join(middle, keys).withColumn("apart", F.abs(F.col("value") - F.col("median")))
    out = quantiles(apart, [*keys, "n", "latest", "median"], "apart", {"mad": 0.5}, limit=limit)
    z = F.when((F.col("n") >= least) & (F.col("mad") > 0), F.lit(Z_SCALE) * (F.col("latest") - F.col("median")) / F.col("mad"))
    reason = ladder((F.col("n") < least, "too_few_values"), (F.col("mad") == 0, "zero_deviation"))
    return out.select("*", z.alias("z"), F.coalesce(F.abs(z) >= Z_FLAG, F.lit(False)).alias("flagged"), reason.alias("reason"))


def theil_sen(points: DataFrame, keys: list[str], least: int = 3, cap: int = 2000) -> DataFrame:
    """Median slope per day over all pairs of different days, and the pairs.

    Groups with fewer than least days have none. A group of more than cap points is refused
    (reason too_many_points) rather than cut.
    """
    usable = points.where("value IS NOT NULL").select(*keys, "day", "value")
    sizes = usable.groupBy(*keys).agg(F.count_distinct("day").alias("days"), F.count("*").alias("n"))
    small = usable.join(sizes.where((F.col("days") >= least) & (F.col("n") <= cap)).select(*keys), keys)
    found = median_slopes(small, keys)
    reason = ladder((F.col("days") < least, "too_few_dates"), (F.col("n") > cap, "too_many_points"))
    return sizes.join(found, keys, "left").select(*keys, "days", "slope", F.coalesce("pairs", F.lit(0).cast("long")).alias("pairs"), reason.alias("reason"))


def trailing_baseline(points: DataFrame, keys: list[str], days: int = 28, least: int = 21) -> DataFrame:
    """Each day against the median of the preceding days (itself left out); needs least observed ones."""
    order = Window.partitionBy(*keys).orderBy(F.datediff("day", F.lit("1970-01-01"))).rangeBetween(-days, -1)
    seen = points.where("value IS NOT NULL").withColumns({"observed": F.count("value").over(order), "before": F.collect_list("value").over(order)})
    sorted_ = F.array_sort("before")
    n = F.size(sorted_)
    median = (F.get(sorted_, F.floor((n - 1) / 2).cast("int")) + F.get(sorted_, F.floor(n / 2).cast("int"))) / 2
    delta = F.col("value") - F.col("base")
    return (
        seen.withColumn("base", F.when(F.col("observed") >= least, median))
        .select(*keys, "day", "value", "observed", "base", delta.alias("delta"), ladder((delta > 0, "above"), (delta < 0, "below"), (delta == 0, "equal"), otherwise=F.lit("unavailable")).alias("direction"))
    )
