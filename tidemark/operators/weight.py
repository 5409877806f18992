"""Weight analytics: candidates, daily medians, time-aware smoothing, rates and similar-weight pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions import finite, ladder
from tidemark.operators.slopes import median_slopes

HALF_LIFE = 21.0  # days, fixed value


def candidates(rows: DataFrame) -> DataFrame:
    """rows with the first exclusion reason that holds; null where the row is a usable observation."""
    reason = ladder(
        (~F.col("confirmed"), "not_confirmed"),
        (F.col("superseded"), "superseded"),
        (F.col("day").isNull(), "missing_observed_date"),
        (F.col("value").isNull(), "missing_value"),
        (F.col("value") <= 0, "non_positive_weight"),
        (F.col("unit") != "kg", "invalid_unit"),
    )
    return rows.withColumn("reason", reason)


def daily_median(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One median for each day, with the number of observations and their ids in order."""
    return rows.groupBy(*keys, "day").agg(F.median("value").alias("value"), F.count("*").alias("n"), F.sort_array(F.collect_list("id")).alias("ids"))


def smoothed(points: DataFrame, keys: list[str], half_life: float = HALF_LIFE) -> DataFrame:
    """trend: exponential smoothing whose factor is 1 - 2 ** (-gap / half_life), started at the first point.

    The recursion telescopes into a running sum of terms that grow by 2 ** (age / half_life), so
    it is a plain window. Ages are counted from blocks of 400 half-lives to keep the powers in
    range; what lies before the previous block weighs less than 2 ** -400 and is left out.
    """
    order = Window.partitionBy(*keys).orderBy("day")
    start = F.first("day").over(order.rowsBetween(Window.unboundedPreceding, 0))
    age = F.datediff("day", start).cast("double")
    gap = F.datediff("day", F.lag("day").over(order)).cast("double")
    factor = F.when(gap.isNull(), F.lit(1.0)).otherwise(F.lit(1.0) - F.pow(F.lit(2.0), -gap / half_life))
    width = 400 * half_life
    aged = points.withColumns({"age": age, "factor": factor}).withColumn("block", F.floor(F.col("age") / width))
    grown = aged.withColumn("rel", (F.col("age") - F.col("block") * width) / half_life)
    grown = grown.withColumn("term", F.col("factor") * F.col("value") * F.pow(F.lit(2.0), F.col("rel")))
    own = F.sum("term").over(Window.partitionBy(*keys, "block").orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    before = F.sum("term").over(Window.partitionBy(*keys).orderBy("block").rangeBetween(-1, -1))
    total = own + F.coalesce(before, F.lit(0.0)) * F.pow(F.lit(2.0), F.lit(-400.0))
    return grown.select(*keys, "day", "value", (total * F.pow(F.lit(2.0), -F.col("rel"))).alias("trend"))


def weekly_rate(points: DataFrame, keys: list[str], window: int = 90, least: int = 6, span: int = 42) -> DataFrame:
    """Median slope per week over (latest - window, latest]; needs least points over span days."""
    last = points.groupBy(*keys).agg(F.max("day").alias("latest"))
    inside = points.join(last, keys).where(F.datediff("latest", "day") < window)
    sizes = inside.groupBy(*keys, "latest").agg(F.count("*").alias("n"), F.datediff(F.max("day"), F.min("day")).alias("days"))
    slopes = median_slopes(inside, keys)  # a point a day, window at most
    ok = (F.col("n") >= least) & (F.col("days") >= span)
    return sizes.join(slopes, keys, "left").select(*keys, "latest", "n", F.col("days").alias("span_days"), F.when(ok, F.col("slope") * 7).alias("per_week"), ladder((F.col("n") < least, "too_few_points"), (F.col("days") < span, "too_short_span")).alias("reason"))


def similarity(earlier: str, later: str, gap: int = 28, share: float = 0.01) -> tuple:
    """(reason, days apart, share of the earlier weight) of two composition points, structs of (day, grp, weight, body_fat).

    Similar weights compare only inside one algorithm group, at least gap days apart, at most
    share of the earlier weight apart, and only with a body fat on both sides; bounds are inclusive.
    """
    e, w = lambda c: F.col(f"{earlier}.{c}"), lambda c: F.col(f"{later}.{c}")
    apart = F.datediff(w("day"), e("day"))
    ratio = F.abs(w("weight") - e("weight")) / e("weight")
    reason = ladder(
        (F.col(earlier).isNull() | F.col(later).isNull(), "missing_session"),
        (e("grp").isNull() | w("grp").isNull() | (e("grp") != w("grp")), "incompatible_algorithm_group"),
        (e("weight").isNull() | w("weight").isNull(), "missing_weight"),
        ((e("weight") <= 0) | (w("weight") <= 0), "invalid_weight_value"),
        (~F.coalesce(finite(e("body_fat")), F.lit(False)) | ~F.coalesce(finite(w("body_fat")), F.lit(False)), "missing_composition_evidence"),
        (apart < gap, "insufficient_gap"),
        (ratio > share, "weight_diff_exceeds_threshold"),
    )
    return reason, apart, ratio


def latest_composition(points: DataFrame) -> DataFrame:
    """Of each group the latest point, by day and session, that has both values."""
    both = points.where("grp IS NOT NULL AND weight IS NOT NULL AND body_fat IS NOT NULL")
    return both.groupBy("grp").agg(F.max_by(F.struct("day", "grp", "weight", "body_fat", "session"), F.struct("day", "session")).alias("later"))


def against_latest(points: DataFrame) -> DataFrame:
    """Every earlier point against its group's latest composition: the reason why it is not comparable, days apart and share."""
    met = points.select("session", "grp", F.struct("day", "grp", "weight", "body_fat").alias("earlier")).join(latest_composition(points), "grp")
    reason, apart, ratio = similarity("earlier", "later")
    return met.where(F.col("earlier.day") < F.col("later.day")).select("grp", "session", "earlier", "later", reason.alias("reason"), apart.alias("days_apart"), ratio.alias("ratio"))


def similar_pair(points: DataFrame) -> DataFrame:
    """The latest composition of each group with the comparable earlier one that is the most days away (ties to the earlier session)."""
    best = Window.partitionBy("grp").orderBy(F.desc("days_apart"), "earlier.day", "session")
    return against_latest(points).where("reason IS NULL").withColumn("n", F.row_number().over(best)).where("n = 1").drop("n", "reason")


def composition(pairs: DataFrame, w: str = "w", f: str = "f") -> DataFrame:
    """pairs of structs (metric, session, day, unit, grp, value) with fat and lean mass, or the first reason why there are none."""
    a, b = lambda c: F.col(f"{w}.{c}"), lambda c: F.col(f"{f}.{c}")
    reason = ladder(
        (F.col(w).isNull(), "missing_weight"),
        (F.col(f).isNull(), "missing_body_fat"),
        (a("metric") != "weight", "invalid_weight_metric"),
        (b("metric") == "muscle_mass", "source_muscle_not_lean"),
        (b("metric") != "body_fat", "invalid_body_fat_metric"),
        (a("session").isNull() | b("session").isNull(), "missing_session"),
        (a("session") != b("session"), "cross_session"),
        (a("day") != b("day"), "conflicting_observed_date"),
        ((a("unit") != "kg") | (b("unit") != "percent"), "invalid_unit"),
        (b("grp").isNull(), "missing_compatibility_group"),
        (~F.coalesce(finite(a("value")), F.lit(False)) | (a("value") <= 0), "invalid_weight_value"),
        (~F.coalesce(finite(b("value")), F.lit(False)) | (b("value") <= 0) | (b("value") >= 100), "invalid_body_fat_value"),
    )
    fat = a("value") * b("value") / 100
    ok = reason.isNull()
    return pairs.withColumns({"reason": reason, "fat_mass": F.when(ok, fat), "lean_mass": F.when(ok, a("value") - fat)})


def composition_series(points: DataFrame) -> DataFrame:
    """Points with a session, day and group, with fat and lean mass where weight and body fat are there and within bounds; the source's muscle stays itself."""
    ok = (F.col("weight") > 0) & (F.col("body_fat") > 0) & (F.col("body_fat") < 100)
    fat = F.col("weight") * F.col("body_fat") / 100
    kept = points.where("session IS NOT NULL AND day IS NOT NULL AND grp IS NOT NULL")
    return kept.select("grp", "day", "session", "weight", "body_fat", F.when(ok, fat).alias("fat_mass"), F.when(ok, F.col("weight") - fat).alias("lean_mass"), "muscle")
