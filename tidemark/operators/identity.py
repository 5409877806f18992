"""Identity, revision heads, in-batch conflicts, latest snapshots and snapshot diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions import ladder


def heads(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Rows that no link (supersedes) names; null links supersede nothing."""
    gone = links.where("supersedes IS NOT NULL").select(F.col("supersedes").alias("id")).distinct()
    return rows.join(gone, "id", "left_anti")


def in_batch_conflicts(rows: DataFrame, keys: list[str], content: list[str]) -> DataFrame:
    """Each key with its rows and distinct contents: one content collapses, several are a conflict. Null is a content."""
    different = F.count_distinct(F.struct(*content))
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), different.alias("contents"), F.when(different > 1, F.lit("conflict")).otherwise(F.lit("one")).alias("outcome"))


def newest_wins(rows: DataFrame, keys: list[str], received: str, tie: str) -> DataFrame:
    """The row of the newest receipt of each key, the greatest tie key among equals; null receipts come last."""
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(received), F.desc(tie))
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def latest_snapshot(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the newest day of each key; of its newest instant only if all its rows have one."""
    last = rows.withColumn("newest", F.max("day").over(Window.partitionBy(*keys))).where(F.col("day") == F.col("newest"))
    all_ = Window.partitionBy(*keys)
    timed = last.withColumns({"timed": F.min(F.col("ts").isNotNull()).over(all_), "at": F.max("ts").over(all_)})
    return timed.where(~F.col("timed") | (F.col("ts") == F.col("at"))).drop("newest", "timed", "at")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, content: list[str]) -> DataFrame:
    """Each key as retained, changed, removed or added; null contents equal each other."""
    b = before.select(key, F.struct(*content).alias("b"))
    a = after.select(key, F.struct(*content).alias("a"))
    met = b.join(a, key, "full_outer")
    return met.select(key, ladder((F.col("b").isNull(), "added"), (F.col("a").isNull(), "removed"), (F.col("a").eqNullSafe(F.col("b")), "retained"), otherwise=F.lit("changed")).alias("change"))


def canonical(candidates: DataFrame, composition: list[str], group: str, version: str) -> DataFrame:
    """candidates with the outcome of each: the reason why it is excluded, selected, or competing_evidence.

    One candidate of each (metric, semantic_key) is selected: of the highest revision, then the
    latest instant, the latest local day, sources before derived values, the greatest evidence_id.
    Composition metrics count only in the asked compatibility group; derived ones only with
    input evidence and of the asked version.
    """
    reason = ladder(
        (~F.col("confirmed"), "not_confirmed"),
        (~F.col("current"), "superseded"),
        (F.col("metric").isin(*composition) & ~F.coalesce(F.col("grp") == group, F.lit(False)), "incompatible_algorithm_group"),
        (F.col("derived") & (F.col("inputs") == 0), "missing_input_evidence"),
        (F.col("derived") & ~F.coalesce(F.col("version") == version, F.lit(False)), "derivation_version_mismatch"),
    )
    order = [F.desc("revision"), F.desc_nulls_last("ts"), F.desc_nulls_last("day"), F.asc("derived"), F.desc("evidence_id")]
    n = F.row_number().over(Window.partitionBy("metric", "semantic_key", F.col("reason").isNull()).orderBy(*order))
    outcome = F.when(F.col("reason").isNotNull(), F.col("reason")).when(n == 1, F.lit("selected")).otherwise(F.lit("competing_evidence"))
    return candidates.withColumn("reason", reason).withColumn("outcome", outcome).drop("reason")


def retire_absent(current: DataFrame, incoming: DataFrame, key: str, complete: bool) -> DataFrame:
    """Current members that a complete snapshot no longer names; an incomplete one retires nothing."""
    absent = current.join(incoming.select(key).distinct(), key, "left_anti")
    return absent if complete else absent.limit(0)


def upsert(current: DataFrame, incoming: DataFrame, key: str, content: list[str], received: str) -> DataFrame:
    """Merged rows and what happened: inserted, changed, same, kept (nothing newer came). An older receipt never rolls back."""
    c = current.select(F.col(key), F.struct(received, *content).alias("old"))
    n = newest_wins(incoming, [key], received, key).select(F.col(key), F.struct(received, *content).alias("new"))
    met = c.join(n, key, "full_outer")
    newer = F.col("new").isNotNull() & (F.col("old").isNull() | (F.col(f"new.{received}") >= F.col(f"old.{received}")))
    same = F.lit(True)
    for x in content:
        same = same & F.col(f"new.{x}").eqNullSafe(F.col(f"old.{x}"))
    action = ladder((~newer, "kept"), (F.col("old").isNull(), "inserted"), (same, "same"), otherwise=F.lit("changed"))
    return met.select(key, F.when(newer, F.col("new")).otherwise(F.col("old")).alias("row"), action.alias("action")).select(key, "row.*", "action")
