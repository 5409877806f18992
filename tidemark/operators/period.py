"""Period cells, comparisons, source selection, freshness ladders and trip days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions import ladder


def cell(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Numerator, eligible and excluded rows, days, bounds and counts by reason of a period's metric."""
    ok = F.col("reason").isNull()
    base = rows.groupBy(*keys).agg(F.count_if(ok).alias("eligible"), F.count_if(~ok).alias("excluded"), F.sum(F.when(ok, F.col("value"))).alias("numerator"), F.avg(F.when(ok, F.col("value"))).alias("mean"), F.count_distinct(F.when(ok, F.col("day"))).alias("observed_days"), F.min(F.when(ok, F.col("day"))).alias("first_day"), F.max(F.when(ok, F.col("day"))).alias("last_day"))
    why = rows.where(~ok).groupBy(*keys, "reason").count().groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "reason", "count"))), ",").alias("reasons"))
    return base.join(why, keys, "left")


def previous_window(rows: DataFrame, keys: list[str], start: str, days: int, share: float = 2 / 3) -> DataFrame:
    """The window from start against the equal one before it; no difference where either covers less than share of its days."""
    begin = F.lit(start).cast("date")
    which = ladder((F.col("day").between(begin, F.date_add(begin, days - 1)), "now"), (F.col("day").between(F.date_sub(begin, days), F.date_sub(begin, 1)), "before"))
    seen = rows.withColumn("w", which).where("w IS NOT NULL")
    agg = [f(F.when(F.col("w") == w, F.col(c))).alias(f"{w}_{n}") for w in ("now", "before") for f, c, n in ((F.avg, "value", "mean"), (F.count_distinct, "day", "days"))]
    wide = seen.groupBy(*keys).agg(*agg)
    ok = (F.col("now_days") >= share * days) & (F.col("before_days") >= share * days)
    return wide.select("*", F.when(ok, F.col("now_mean") - F.col("before_mean")).alias("delta"), F.when(~ok, F.lit("low_coverage")).alias("reason"))


def unique_source(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The only source with eligible rows, if no other has eligible or ambiguous ones; else why there is none."""
    competing = F.count_if((F.col("eligible") > 0) | (F.col("ambiguous") > 0))
    able = F.count_if(F.col("eligible") > 0)
    chosen = F.max_by("source", F.col("eligible"))
    return cells.groupBy(*keys).agg(F.when((competing == 1) & (able == 1), chosen).alias("source"), ladder((competing == 0, "no_source"), (competing > 1, "several_sources"), (able == 0, "only_ambiguous")).alias("reason"))


def most_frequent(rows: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """The most frequent kind, the first by name among equals."""
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), kind)
    return rows.groupBy(*keys, kind).agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def duplicates(rows: DataFrame, keys: list[str], identity: list[str]) -> DataFrame:
    """Rows beyond the first of each identity, the identities, and those that occur more than once."""
    return rows.groupBy(*keys, *identity).agg(F.count("*").alias("n")).groupBy(*keys).agg(F.sum(F.greatest(F.lit(0), F.col("n") - 1)).alias("duplicates"), F.count("*").alias("identities"), F.count_if(F.col("n") > 1).alias("repeated"))


def freshness_state(facts: DataFrame, now: str) -> DataFrame:
    """Scopes with state and reason at an instant.

    facts: requested, disabled, family (daily, activity, weight), role (required, optional),
    attempt, success, terminal (status of the last attempt), evidence_at, evidence_day,
    chronology_issue, attributed, coverage, activities, observed_once, confirmed_weight.
    A terminal failure after the last success is authoritative and evidence cannot demote it;
    daily evidence is fresh to 36 hours or the day before, quiet to 72 hours or two days; 48
    hours without a success are overdue.
    """
    at = F.lit(now).cast("timestamp")
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1_000_000
    attempt, success, evidence, day = F.col("attempt"), F.col("success"), F.col("evidence_at"), F.col("evidence_day")
    since = attempt.isNotNull() & (success.isNull() | (attempt > success))  # tried since the last success
    failed = since & F.col("terminal").isin("reauth_required", "required_stream_unavailable", "failed")
    overdue = seconds(at) - seconds(success) > 48 * 3600
    hours, days = (seconds(at) - seconds(evidence)) / 3600, F.datediff(at, day)
    family, complete = F.col("family"), F.coalesce(F.col("coverage") == "complete", F.lit(False))
    rules = [
        (F.col("disabled"), "not_requested", "disabled"),
        (~F.col("requested"), "not_requested", "not_requested"),
        ((attempt > at) | (success > at), "unknown", "future_chronology"),
        (failed & (F.col("terminal") == "failed"), "unavailable", "refresh_failed"),
        (failed & (F.col("terminal") == "reauth_required"), "unavailable", "reauth_required"),
        (failed, "unavailable", "required_stream_unavailable"),
        ((evidence > at) | (day > F.to_date(at)), "unknown", "future_chronology"),
        (F.col("chronology_issue") == "invalid_chronology", "unknown", "invalid_chronology"),
        (F.col("chronology_issue").isNotNull(), "unknown", "chronology_unresolved"),
        (~F.col("attributed"), "unknown", "scope_unresolved"),
        (since & F.col("terminal").isin("partial", "incomplete", "unknown"), "unknown", "acquisition_incomplete"),
        (since & success.isNotNull() & (F.col("terminal") == "succeeded"), "unknown", "chronology_unresolved"),
        ((family == "weight") & F.col("confirmed_weight"), "quiet", "voluntary_sampling"),
        (family == "weight", "unknown", "never_observed"),
        ((family == "activity") & success.isNull() & ~complete, "unknown", "coverage_unknown"),
        ((family == "activity") & success.isNull(), "unknown", "chronology_unresolved"),
        ((family == "activity") & overdue, "stale", "refresh_overdue"),
        ((family == "activity") & (~complete | F.col("activities").isNull()), "unknown", "coverage_unknown"),
        ((family == "activity") & (F.col("activities") < 0), "unknown", "invalid_chronology"),
        ((family == "activity") & (F.col("activities") > 0), "fresh", "evidence_current"),
        (family == "activity", "quiet", "event_window_confirmed_empty"),
        ((F.col("role") == "optional") & ~F.col("observed_once"), "unknown", "never_observed"),
        (success.isNull() & F.col("observed_once"), "unknown", "chronology_unresolved"),
        (success.isNull(), "unknown", "never_observed"),
        (evidence.isNull() & day.isNull(), "unknown", "never_observed"),
        (evidence.isNotNull() & day.isNotNull(), "unknown", "chronology_unresolved"),
        (overdue, "stale", "refresh_overdue"),
        ((hours <= 36) | (days <= 1), "fresh", "evidence_current"),
        ((hours <= 72) | (days == 2), "quiet", "evidence_within_grace"),
    ]
    state = ladder(*[(c, s) for c, s, _ in rules], otherwise=F.lit("stale"))
    reason = ladder(*[(c, r) for c, _, r in rules], otherwise=F.lit("expected_evidence_absent"))
    acts = (F.col("role") == "required") & F.col("state").isin("stale", "unavailable", "unknown")
    return facts.withColumns({"state": state, "reason": reason}).withColumn("actionable", acts)


def roll_up(states: DataFrame, keys: list[str]) -> DataFrame:
    """The worst state of the required scopes that were asked for; unknown without required ones, not_requested if none was asked for."""
    order = F.array(*[F.lit(x) for x in ("unavailable", "stale", "unknown", "quiet", "fresh")])
    required = F.col("role") == "required"
    rank = F.when(required, F.array_position(order, F.col("state")))
    worst = F.min(F.when(rank > 0, rank))
    state = ladder((F.count_if(required) == 0, "unknown"), (worst.isNull(), "not_requested"), otherwise=F.element_at(order, worst.cast("int")))
    return states.groupBy(*keys).agg(state.alias("state"), F.count("*").alias("scopes"), F.count_if(F.col("actionable")).alias("actionable"))


def trip_day(days: DataFrame, today: str) -> DataFrame:
    """The state of a day from its completed and observed counts."""
    c, o = F.col("completed"), F.col("observed")
    state = ladder((F.col("day") > F.lit(today).cast("date"), "future"), (c.isNotNull() & o.isNotNull() & (c < o), "conflict"), (c == 0, "zero"), (c.isNotNull(), "completed"), (o.isNotNull(), "incomplete"), otherwise=F.lit("missing"))
    return days.withColumn("state", state).withColumn("counted", F.when(F.col("state").isin("completed", "zero"), c))


def thinned(points: DataFrame, keys: list[str], k: int, order: str) -> DataFrame:
    """k evenly spaced rows of each group, both ends kept; groups of at most k rows stay whole. For display only."""
    w = Window.partitionBy(*keys)
    i = F.row_number().over(w.orderBy(order)) - 1
    n = F.count("*").over(w)
    numbered = points.withColumns({"i": i, "n": n})
    step = (F.col("n") - 1) / F.lit(k - 1)
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.bround(j * step, 0).cast("int"))
    return numbered.where((F.col("n") <= k) | F.array_contains(wanted, F.col("i"))).drop("i", "n")


def bounded(rows: DataFrame, cap: int, keys: list[str]) -> DataFrame:
    """A group's rows and total, or search_incomplete with nothing where it has more than cap rows: never a prefix."""
    n = F.count("*")
    return rows.groupBy(*keys).agg(F.when(n <= cap, n).alias("rows"), F.when(n <= cap, F.sum("value")).alias("total"), F.when(n > cap, F.lit("search_incomplete")).otherwise(F.lit("complete")).alias("status"))
