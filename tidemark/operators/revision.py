"""Merges of what is stored with what comes in: members, stages, snapshots, revisions by provider time, tombstones, migrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import idempotency_key, ladder


def same(a: str, b: str, columns: list[str]) -> Column:
    """Whether two structs agree in the named fields; nulls equal each other."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def upsert_members(current: DataFrame, incoming: DataFrame, owner: str, member: str, content: list[str]) -> DataFrame:
    """Members (metric codes, stage ordinals) of owners after a merge: inserted, changed, same, deleted (the owner came without it) or kept (the owner did not come)."""
    old = current.select(owner, member, F.struct(*content).alias("old"))
    new = incoming.select(owner, member, F.struct(*content).alias("new"))
    came = incoming.select(owner).distinct().withColumn("came", F.lit(True))
    met = old.join(new, [owner, member], "full_outer").join(came, owner, "left")
    action = ladder((F.col("came").isNull(), "kept"), (F.col("new").isNull(), "deleted"), (F.col("old").isNull(), "inserted"), (same("new", "old", content), "same"), otherwise=F.lit("changed"))
    row = F.when(F.col("came").isNull(), F.col("old")).otherwise(F.col("new"))
    return met.select(owner, member, row.alias("row"), action.alias("action")).select(owner, member, *[F.col(f"row.{c}").alias(c) for c in content], "action")


def retire_vanished(current: DataFrame, snapshots: DataFrame, members: DataFrame, scope: str, key: str) -> DataFrame:
    """current with retired: members that a complete snapshot of their scope no longer names; incomplete snapshots retire nothing."""
    whole = snapshots.where("complete").select(scope).distinct().withColumn("whole", F.lit(True))
    named = members.select(scope, key).distinct().withColumn("named", F.lit(True))
    met = current.join(whole, scope, "left").join(named, [scope, key], "left")
    return met.select(*current.columns, (F.col("whole").isNotNull() & F.col("named").isNull()).alias("retired"))


def observed_once(rows: DataFrame, parts: list[str], order: list[str]) -> DataFrame:
    """Rows with their observation key and whether they are the first of it (new) or a replay."""
    keyed = rows.withColumn("observation_key", idempotency_key(*[F.col(p) for p in parts]))
    n = F.row_number().over(Window.partitionBy("observation_key").orderBy(*order))
    return keyed.withColumn("outcome", F.when(n == 1, "new").otherwise("replay"))


def stream_state(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Monotone state of a stream: its last attempt, last success and watermark never go back, whatever the order of arrival."""
    ok = F.col("status") == "ok"
    return attempts.groupBy(*keys).agg(F.max("at").alias("last_attempt"), F.max(F.when(ok, F.col("at"))).alias("last_success"), F.max(F.when(ok, F.col("day"))).alias("watermark"))


def stale_collections(batches: DataFrame, stored: DataFrame, scope: list[str]) -> DataFrame:
    """Batches with stale: received before something of their scope that is already stored."""
    newest = stored.groupBy(*scope).agg(F.max("observed").alias("newest"))
    return batches.join(newest, scope, "left").withColumn("stale", F.coalesce(F.col("received") < F.col("newest"), F.lit(False)))


def by_provider_time(current: DataFrame, incoming: DataFrame, key: str, content: list[str], equal_time: str) -> DataFrame:
    """The outcome of a revision for each key: the provider's update time decides, never the receipt.

    equal_time says what an equal time with other content does: 'unless_moved' takes it where
    the field `interval` is unchanged, 'invalid' invalidates the record. Without an update time
    an incoming row never replaces one that has it.
    """
    old = current.select(key, F.struct("updated", "interval", *content).alias("old"))
    new = incoming.select(key, F.struct("updated", "interval", *content).alias("new"))
    met = old.join(new, key, "full_outer")
    o, n = F.col("old.updated"), F.col("new.updated")
    equal = o.eqNullSafe(n)
    clash = ladder((F.col("old.interval").eqNullSafe(F.col("new.interval")), "revised"), otherwise=F.lit("kept")) if equal_time == "unless_moved" else F.lit("invalid")
    outcome = (
        F.when(F.col("new").isNull(), "kept")
        .when(F.col("old").isNull(), "inserted")
        .when(equal & same("new", "old", content) & F.col("old.interval").eqNullSafe(F.col("new.interval")), "same")
        .when(equal, clash)
        .when(n.isNotNull() & (o.isNull() | (n > o)), "revised")
        .otherwise("kept")
    )
    taken = F.col("outcome").isin("inserted", "revised")
    return met.withColumn("outcome", outcome).select(key, F.when(taken, F.col("new")).otherwise(F.col("old")).alias("row"), "outcome").select(key, "row.updated", *[F.col(f"row.{c}").alias(c) for c in content], "outcome")


def winner(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("n = 1").drop("n")


def migrated(rows: DataFrame, new_key: str, epoch: str, signature: str) -> DataFrame:
    """Rows regrouped by a new key: kept where all signatures agree, else those of the single latest epoch if that one is agreed, else identity_conflict."""
    w = Window.partitionBy(new_key)
    many = F.size(F.collect_set(signature).over(w)) > 1
    last = F.max(epoch).over(w)
    of_last = F.size(F.collect_set(F.when(F.col(epoch) == F.col("last"), F.col(signature))).over(w))
    marked = rows.withColumns({"many": many, "last": last}).withColumn("of_last", of_last)
    out = ladder((~F.col("many"), "kept"), (F.col("of_last") != 1, "identity_conflict"), (F.col(epoch) == F.col("last"), "kept"), otherwise=F.lit("older_epoch"))
    return marked.withColumn("outcome", out).drop("many", "last", "of_last")


def ledger(events: DataFrame, user: str, order: list[str]) -> DataFrame:
    """Records after change events in order of arrival: upsert and delete name a record, clear names a user's all, ledger_only does nothing.

    The state of a record follows from its last upsert or delete and its user's last clear.
    """
    position = F.struct(*order)
    clears = events.where("action = 'clear'").groupBy(user).agg(F.max(position).alias("cleared"))
    own = events.where("action IN ('upsert', 'delete') AND record IS NOT NULL").groupBy(user, "record").agg(F.max_by(F.struct("action", "value"), position).alias("last"), F.max(position).alias("at"))
    met = own.join(clears, user, "left")
    state = ladder((F.col("cleared") > F.col("at"), "cleared"), (F.col("last.action") == "delete", "deleted"), otherwise=F.lit("active"))
    return met.select(user, "record", state.alias("state"), F.when(state == "active", F.col("last.value")).alias("value"))


def merged_fields(old: DataFrame, new: DataFrame, keys: list[str], field: str) -> DataFrame:
    """Evidence fields after a merge: an incoming missing field keeps what was there, fields that only the old evidence has stay."""
    o = old.select(*keys, field, F.struct("state", "value").alias("o"))
    n = new.select(*keys, field, F.struct("state", "value").alias("n"))
    met = o.join(n, [*keys, field], "full_outer")
    keeps = F.col("n").isNull() | ((F.col("n.state") == "missing") & F.col("o").isNotNull())
    return met.select(*keys, field, F.when(keeps, F.col("o")).otherwise(F.col("n")).alias("x"), F.when(keeps, "kept").otherwise("incoming").alias("origin")).select(*keys, field, "x.*", "origin")


def snapshot_hash(rows: DataFrame, keys: list[str], identifier: str, content: str) -> DataFrame:
    """SHA-256 of each group's sorted (id, content hash) pairs; an id with two contents is a conflict and has no hash."""
    one = rows.select(*keys, F.col(identifier).cast("string").alias("id"), F.sha2(F.coalesce(content, F.lit("")), 256).alias("h")).distinct()
    pairs = F.sort_array(F.collect_list(F.struct("id", "h")))
    text = F.concat(F.lit("["), F.array_join(F.transform(pairs, lambda p: F.concat(F.lit('["'), p["id"], F.lit('","'), p["h"], F.lit('"]'))), ","), F.lit("]"))
    clash = F.count("*") != F.count_distinct("id")
    return one.groupBy(*keys).agg(F.count("*").alias("inputs"), F.when(~clash, F.sha2(text, 256)).alias("hash"), F.when(clash, F.lit("conflicting_content")).alias("reason"))


def clipped(rows: DataFrame, first: str, last: str, was_clipped: bool) -> DataFrame:
    """Rows whose local day, else UTC day, lies in [first, last]; undated rows go only where the window was clipped."""
    day = F.coalesce("local_day", F.to_date("ts"))
    inside = day.between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return rows.where(inside if was_clipped else (inside | day.isNull()))


def latest_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Of each lineage the latest successful run that no other of the lineage supersedes and that is no replay, and the latest of any status."""
    gone = runs.where("supersedes IS NOT NULL").select(*keys, F.col("supersedes").alias("run")).distinct().withColumn("gone", F.lit(True))
    live = runs.join(gone, [*keys, "run"], "left")
    good = (F.col("status") == "succeeded") & F.col("gone").isNull() & ~F.col("replay")
    place = F.struct("at", "run")
    return live.groupBy(*keys).agg(F.max_by("run", F.when(good, place)).alias("successful"), F.max_by("run", place).alias("any"), F.max_by("status", place).alias("any_status"))


def session_state(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Sessions after create, revise and remove, in order: a revision needs a live session, a tombstone ends it, a create after it begins anew.

    state: active with the number of its revision and the newest value, or removed.
    """
    place = F.struct(*order)
    born = changes.where("action = 'create'").groupBy(key).agg(F.max(place).alias("born"))
    gone = changes.where("action = 'remove'").groupBy(key).agg(F.max(place).alias("gone"))
    met = changes.join(born, key).join(gone, key, "left").withColumn("place", place)
    floor = F.when(F.col("gone") < F.col("born"), F.col("gone"))  # what lies before the last tombstone belongs to an earlier life
    live = met.where((F.col("action") != "remove") & (floor.isNull() | (F.col("place") > floor)))
    told = live.where(F.col("gone").isNull() | (F.col("gone") < F.col("born")) | (F.col("place") < F.col("gone")))
    out = told.groupBy(key).agg(F.count_if(F.col("action") == "revise").alias("revision"), F.max_by("value", "place").alias("value"), F.max("born").alias("born"), F.max("gone").alias("gone"))
    removed = F.coalesce(F.col("gone") > F.col("born"), F.lit(False))
    return out.select(key, F.when(removed, "removed").otherwise("active").alias("state"), F.when(~removed, F.col("revision")).alias("revision"), F.when(~removed, F.col("value")).alias("value"))
