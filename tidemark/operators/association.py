"""Lagged rank association and method agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions import ladder, safe_correlation
from tidemark.operators.order_statistics import LIMIT, quantiles


def mid_rank(value: str, keys: list[str]):
    """1-based rank in which ties share their mean."""
    order = Window.partitionBy(*keys).orderBy(value)
    ties = F.count("*").over(Window.partitionBy(*keys, value))
    return F.rank().over(order) + (ties - 1) / F.lit(2.0)


def one_per_day(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, day, value, status): several rows for a day are ambiguous and have no value."""
    n = F.count("*")
    return rows.groupBy(*(keys or []), "day").agg(F.when(n == 1, F.first("value")).alias("value"), F.when(n > 1, F.lit("ambiguous")).otherwise(F.lit("value")).alias("status"))


def lagged_spearman(left: DataFrame, right: DataFrame, lags: list[int], least: int = 5, keys: list[str] | None = None) -> DataFrame:
    """Rank correlation of x(day) with y(day + lag) for each of keys and lag, with the pairs and why days have none."""
    if len(lags) > 15 or len(set(lags)) != len(lags) or not all(0 <= k <= 14 for k in lags):
        raise ValueError("lags must be at most 15 different numbers from 0 to 14")
    keys = keys or []
    x = left.select(*keys, "day", F.col("value").alias("x"), F.col("status").alias("x_status"), F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag"))
    y = right.select(*keys, F.col("day").alias("y_day"), F.col("value").alias("y"), F.col("status").alias("y_status"))
    met = x.withColumn("y_day", F.date_add("day", F.col("lag"))).join(y.withColumn("there", F.lit(True)), [*keys, "y_day"], "left")
    why = ladder((F.col("x_status") == "ambiguous", "x_ambiguous"), (F.col("there").isNull(), "y_absent"), (F.col("y_status") == "ambiguous", "y_ambiguous"))
    seen = met.withColumn("why", why)
    by = [*keys, "lag"]
    ranked = seen.where("why IS NULL").select(*by, mid_rank("x", by).alias("rx"), mid_rank("y", by).alias("ry"))
    rho = ranked.groupBy(*by).agg(F.count("*").alias("pairs"), safe_correlation("rx", "ry").alias("rho"))
    counts = seen.groupBy(*by).agg(*[F.count_if(F.col("why") == w).alias(w) for w in ("x_ambiguous", "y_absent", "y_ambiguous")])
    pairs = F.coalesce("pairs", F.lit(0).cast("long"))
    return counts.join(rho, by, "left").select(*by, pairs.alias("pairs"), "x_ambiguous", "y_absent", "y_ambiguous", F.when(pairs >= least, F.col("rho")).alias("rho"))


def agreement_dedup(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """One difference for each day: equal ones collapse, a day with different ones is left out."""
    return pairs.groupBy(*keys, "day").agg(F.count_distinct("diff").alias("n"), F.min("diff").alias("diff"), F.min("a").alias("a"), F.min("b").alias("b")).where("n = 1").drop("n")


def agreement_summary(pairs: DataFrame, keys: list[str], limit: int = LIMIT) -> DataFrame:
    """Bias, absolute and squared error, limits of agreement, robust quantiles and correlation of the differences."""
    sd = F.stddev_samp("diff")
    others = [
        F.count("*").alias("n"), F.avg("diff").alias("bias"), F.avg(F.abs("diff")).alias("mae"), F.sqrt(F.avg(F.col("diff") * F.col("diff"))).alias("rmse"), sd.alias("sd"),
        (F.avg("diff") - F.lit(1.96) * sd).alias("loa_low"), (F.avg("diff") + F.lit(1.96) * sd).alias("loa_high"), safe_correlation("a", "b").alias("pearson"),
    ]
    return quantiles(pairs, keys, "diff", {"median": 0.5, "q025": 0.025, "q975": 0.975}, *others, limit=limit)


def outlier_sensitivity(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Tukey fences of the differences, and the summary's bias without what lies outside."""
    fences = quantiles(pairs, keys, "diff", {"q1": 0.25, "q3": 0.75})
    fences = fences.select(*keys, (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("low"), (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("high"))
    inside = F.col("diff").between(F.col("low"), F.col("high"))
    return pairs.join(fences, keys).groupBy(*keys, "low", "high").agg(F.count_if(~inside).alias("outliers"), F.avg(F.when(inside, F.col("diff"))).alias("bias_inside"), F.avg("diff").alias("bias"))


def stability(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Halves of the ordered days: whether their robust intervals overlap and both biases lie in the whole's interval."""
    order = Window.partitionBy(*keys).orderBy("day")
    half = F.when(F.row_number().over(order) <= F.floor(F.count("*").over(Window.partitionBy(*keys)) / 2), "first").otherwise("second")
    ends = {"low": 0.025, "high": 0.975}
    halves = quantiles(pairs.withColumn("half", half), [*keys, "half"], "diff", ends, F.avg("diff").alias("bias"))
    whole = quantiles(pairs, keys, "diff", ends)
    one = [halves.where(F.col("half") == h).select(*keys, *[F.col(c).alias(f"{h}_{c}") for c in ("bias", "low", "high")]) for h in ("first", "second")]
    met = one[0].join(one[1], keys).join(whole, keys)
    overlap = (F.col("first_low") <= F.col("second_high")) & (F.col("second_low") <= F.col("first_high"))
    inside = F.col("first_bias").between(F.col("low"), F.col("high")) & F.col("second_bias").between(F.col("low"), F.col("high"))
    return met.select(*keys, "first_bias", "second_bias", overlap.alias("overlap"), (overlap & inside).alias("stable"))


def gate(facts: DataFrame, exploratory: int = 14, provisional: int = 42, span: int = 41) -> DataFrame:
    """facts (n, strong_n, cohort, canonical, span_days, method_break, stable or null) with both gates, eligibility and reasons."""
    few = F.when(F.col("n") < exploratory, F.lit("exploratory_n_below_14"))
    rules = [
        (F.col("cohort") == "account", "exploratory_only_cohort", F.lit("account_observations_never_canonical")),
        (~F.col("canonical"), "non_canonical_metric", F.lit("metric_not_canonical_candidate")),
        (F.col("strong_n") < provisional, "insufficient_n", F.when(F.col("n") < provisional, "provisional_n_below_42").otherwise("strong_gate_n_below_42")),
        (F.col("cohort") != "device_pair", "not_device_pair", F.lit("provisional_requires_device_pair")),
        (F.col("span_days").isNull() | (F.col("span_days") < span), "insufficient_span", F.lit("provisional_span_delta_below_41_days")),
        (F.col("method_break"), "known_method_break", F.lit("known_method_break")),
        (F.col("stable").isNull(), "stability_missing", F.lit("stability_packet_missing")),
        (~F.col("stable"), "stability_failed", F.lit("stability_failed")),
    ]
    state = ladder(*[(c, code) for c, code, _ in rules], otherwise=F.lit("eligible_for_provisional_proposal"))
    why = F.when(rules[0][0], rules[0][2])
    for condition, _, reason in rules[1:]:
        why = why.when(condition, reason)
    return facts.withColumns(
        {
            "exploratory": F.when(few.isNull(), "exploratory").otherwise("insufficient_n"), "provisional": state,
            "eligible": state == "eligible_for_provisional_proposal", "reasons": F.concat_ws(",", few, why),
        }
    )
