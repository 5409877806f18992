"""What comes in from outside, taken whole or refused with a reason: photo fields, stage lists, payloads with their observations and records."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import idempotency_key, ladder
from tidemark.operators.payload import temporal

#: Spellings of units, metrics by the units they may have, stage names of activity levels (fixed values).
UNIT_SPELLINGS = {"kg": ("kg", "kilogram", "kilograms"), "lb": ("lb", "lbs", "pound", "pounds"), "%": ("%", "percent", "pct", "pp")}
MASS_METRICS = ("weight", "muscle_mass", "bone_mass")
SHARE_METRICS = ("body_fat_pct", "water_pct", "bone_pct")
STAGES = ("DEEP", "LIGHT", "REM", "AWAKE")


def canonical_unit(unit: Column) -> Column:
    """kg, lb or % of any spelling of it; null where none is known."""
    text = F.lower(F.trim(unit))
    return ladder(*[(text.isin(*spellings), name) for name, spellings in UNIT_SPELLINGS.items()])


def _usable(zone: Column) -> Column:
    return F.try_to_timestamp(F.concat(F.lit("2000-01-01 00:00:00 "), zone)).isNotNull()


def date_contradiction(date: Column, instant: Column, zone: Column, offset_minutes: Column) -> Column:
    """Why a local date and an instant cannot both be true: by the zone, else by the offset, else by more than a day; null if they can or one is missing."""
    usable = _usable(zone)
    in_zone = F.to_date(F.from_utc_timestamp(instant, F.when(usable, zone).otherwise("UTC")))
    at_offset = F.to_date(instant + F.make_dt_interval(mins=offset_minutes))
    both = date.isNotNull() & instant.isNotNull()
    return ladder(
        (both & zone.isNotNull() & F.coalesce(~usable, F.lit(True)), "zone_not_usable"),
        (both & zone.isNotNull() & (in_zone != date), "date_contradicts_zone"),
        (both & zone.isNull() & (at_offset != date), "date_contradicts_offset"),
        (both & zone.isNull() & offset_minutes.isNull() & (F.abs(F.datediff(date, F.to_date(instant))) > 1), "date_contradicts_instant"),
    )


def photo_fields(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Fields read off a photo, with their unit, date, instant, precision, ordered warnings and error; values are never repaired.

    rows: metric, unit, confidence, field_date, field_ts, field_precision, group_date, group_ts,
    group_precision (what the field lacks comes from its group), zone, offset_minutes. An unknown
    unit stays as it is, an empty one counts as none. Evidence that is precise to the date drops
    its instant. A field whose date its instant contradicts has an error; it must not be taken.
    """
    known = canonical_unit(F.col("unit"))
    given = F.nullif("unit", F.lit(""))
    unit = F.coalesce(known, given)
    ts, precision_of = F.coalesce("field_ts", "group_ts"), F.coalesce(F.nullif("field_precision", F.lit("")), F.nullif("group_precision", F.lit("")))
    date = F.coalesce("field_date", "group_date", F.to_date(ts))
    whole_minute = F.unix_micros(ts) % 60_000_000 == 0
    inferred = ladder((ts.isNull() & date.isNotNull(), "date"), (ts.isNotNull() & whole_minute, "minute"), (ts.isNotNull(), "instant"))
    precision = F.coalesce(precision_of, inferred)
    clocked, dated = F.coalesce(precision.isin("instant", "minute"), F.lit(False)), F.coalesce(precision == "date", F.lit(False))
    kept = F.when(~dated, ts)
    metric = F.col("metric")
    off_unit = (metric.isin(*MASS_METRICS) & ~unit.isin("kg", "lb")) | (metric.isin(*SHARE_METRICS) & (unit != "%"))
    warnings = (
        (given.isNotNull() & known.isNull(), "unrecognized_unit"),
        (off_unit, "impossible_unit"),
        (~F.col("confidence").between(0, 1), "confidence_out_of_range"),
        (dated & ts.isNotNull(), "date_precision_drops_timestamp"),
        (clocked & ts.isNull(), "missing_timestamp"),
        (date.isNull(), "missing_source_date"),
    )
    found = F.array_compact(F.array(*[F.when(holds, F.lit(code)) for holds, code in warnings]))
    error = F.when(clocked, date_contradiction(date, kept, F.col("zone"), F.col("offset_minutes")))
    return rows.select(*keys, "metric", unit.alias("unit"), date.alias("date"), kept.alias("ts"), precision.alias("precision"), found.alias("warnings"), error.alias("error"))


def _utc(text: Column) -> Column:
    t = temporal(text)
    return F.coalesce(t["instant"], F.when(t["precision"] == "local", F.try_to_timestamp(text)))


def stage_rows(nights: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """A row for each element of sleepLevels: start, end, stage and, where it cannot be taken, reason; a taken one may have the diagnostic sleep_stage_discontinuity.

    keys name a night. Times without an offset are UTC; level numbers other than 0 to 3, booleans
    and numeric texts are no levels. A stage is continuous if it starts where the taken one before ends.
    """
    items = F.try_variant_get(F.col(payload), "$.sleepLevels", "array<variant>")
    rows = nights.select(*keys, F.posexplode(items).alias("ordinal", "item"))
    at = lambda path, kind: F.try_variant_get("item", f"$.{path}", kind)
    is_text = lambda path: F.schema_of_variant(at(path, "variant")) == "STRING"
    start, end = (F.when(is_text(p), _utc(at(p, "string"))) for p in ("startGMT", "endGMT"))
    number = F.when(F.schema_of_variant(at("activityLevel", "variant")).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), at("activityLevel", "double"))
    stage = ladder(*[(number == i, name) for i, name in enumerate(STAGES)])
    is_object = F.coalesce(F.startswith(F.schema_of_variant("item"), F.lit("OBJECT")), F.lit(False))
    taken = F.coalesce(is_object & (end > start) & stage.isNotNull(), F.lit(False))
    reason = ladder((~is_object, "sleep_stage_shape_drift"), (~taken, "sleep_stage_invalid"))
    rows = rows.select(*keys, "ordinal", start.alias("start"), end.alias("end"), stage.alias("stage"), reason.alias("reason"))
    before = Window.partitionBy(*keys).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    good = F.col("reason").isNull()
    last = F.last(F.when(good, F.col("end")), ignorenulls=True).over(before)
    return rows.withColumn("diagnostic", F.when(good & (F.col("start") != last), "sleep_stage_discontinuity"))


def stage_lists(nights: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """The state of each night's stage list: missing, null, invalid (shape_drift) or value (partial_collection after any diagnostic), stages taken, diagnostics.

    The first and last stage must start and end with the night (sleepStartTimestampGMT and
    sleepEndTimestampGMT, epoch milliseconds); a second list named levels is a conflict. An empty
    list is a value without stages.
    """
    v = F.col(payload)
    levels = F.try_variant_get(v, "$.sleepLevels", "variant")
    is_list = F.startswith(F.schema_of_variant(levels), F.lit("ARRAY"))
    whole = lambda p: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{p}", "variant")) == "BIGINT", F.timestamp_millis(F.try_variant_get(v, f"$.{p}", "bigint")))
    facts = nights.select(
        *keys, levels.isNull().alias("absent"), F.is_variant_null(levels).alias("none"), F.coalesce(is_list, F.lit(False)).alias("list"),
        whole("sleepStartTimestampGMT").alias("from"), whole("sleepEndTimestampGMT").alias("to"), F.try_variant_get(v, "$.levels", "variant").isNotNull().alias("twice"),
    )
    good = F.col("reason").isNull()
    found = stage_rows(nights, keys, payload).groupBy(*keys).agg(
        F.count_if(good).alias("stages"), F.count_if(~good).alias("refused"), F.count("diagnostic").alias("breaks"),
        F.min_by("start", F.when(good, F.col("ordinal"))).alias("first"), F.max_by("end", F.when(good, F.col("ordinal"))).alias("last"),
    )
    met = facts.join(found, keys, "left").fillna(0, ["stages", "refused", "breaks"])
    fits = (F.col("first") == F.col("from")) & (F.col("last") == F.col("to"))
    outside = (F.col("stages") > 0) & ~F.coalesce(fits, F.lit(False))
    some = F.array_compact(
        F.array(
            F.when(F.col("refused") > 0, "sleep_stage_refused"), F.when(F.col("breaks") > 0, "sleep_stage_discontinuity"),
            F.when(outside, "sleep_stage_boundary_mismatch"), F.when(~F.col("absent") & F.col("twice"), "sleep_stage_alias_conflict"),
        )
    )
    noted = F.when(F.col("list"), F.size(some) > 0).otherwise(F.lit(False))
    state = ladder((F.col("absent"), "missing"), (F.col("none"), "null"), (~F.col("list"), "invalid"), (noted & (F.col("stages") == 0), "invalid"), otherwise=F.lit("value"))
    reason = ladder((state == "invalid", "shape_drift"), ((state == "value") & noted, "partial_collection"))
    return met.select(*keys, state.alias("state"), reason.alias("reason"), "stages", "refused", "breaks", some.alias("diagnostics"))


class Stored(NamedTuple):
    """raw: scope, content_hash, text. observations: scope, observation_key, received, complete, outcome. records: scope, record, content, observed, retired, outcome."""

    raw: DataFrame
    observations: DataFrame
    records: DataFrame


def persisted(stored: Stored, results: DataFrame, members: DataFrame) -> Stored:
    """What is stored after a batch of results, in one step: payload texts, observations and records together.

    results: scope, received, complete, text; members: scope, received, record, content. Payload
    texts are kept once. A result that is stored already is a replay; one received before the
    newest of its scope that is stored is stale; both change no record. Of the others the latest
    that names a record gives its content (of several at one time, the greatest content), and a
    complete one retires the records of its scope that neither it nor a later one names. A result
    without scope or time is unplaced and changes nothing. Persisting a batch again changes nothing.
    Write what is returned before the next batch: each call adds to the plan.
    """
    placed = F.col("scope").isNotNull() & F.col("received").isNotNull()
    told = results.withColumn("content_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    told = told.withColumn("observation_key", idempotency_key(F.col("scope"), F.col("received"), F.col("content_hash")))
    once = told.groupBy("scope", "received", "content_hash", "observation_key").agg(F.bool_or("complete").alias("complete"), F.min(F.coalesce("text", F.lit(""))).alias("text"))
    newest = stored.observations.where(placed).groupBy("scope").agg(F.max("received").alias("newest"))
    known = stored.observations.select("observation_key").distinct().withColumn("known", F.lit(True))
    outcome = ladder((~placed, "unplaced"), (F.col("known").isNotNull(), "replay"), (F.col("received") < F.col("newest"), "stale"), otherwise=F.lit("new"))
    met = once.join(newest, "scope", "left").join(known, "observation_key", "left").withColumn("outcome", outcome)

    held = stored.raw.select(F.col("scope").alias("held_scope"), F.col("content_hash").alias("held_hash"))
    is_held = F.col("scope").eqNullSafe(F.col("held_scope")) & (F.col("content_hash") == F.col("held_hash"))
    texts = met.groupBy("scope", "content_hash").agg(F.min("text").alias("text")).join(held, is_held, "left_anti")
    seen = met.where(F.col("known").isNull()).select("scope", "observation_key", "received", "complete", "outcome")

    fresh = met.where("outcome = 'new'")
    names = members.join(fresh.select("scope", "received").distinct(), ["scope", "received"], "left_semi")
    named = names.groupBy("scope", "record").agg(F.struct(F.max_by("content", F.struct("received", "content")).alias("content"), F.max("received").alias("observed")).alias("n"))
    closed = fresh.where("complete").groupBy("scope").agg(F.max("received").alias("closed"))
    old = stored.records.select("scope", "record", F.struct("content", "observed", "retired").alias("o"))
    both = old.join(named, ["scope", "record"], "full_outer").join(closed, "scope", "left")
    observed = F.coalesce("n.observed", "o.observed")
    ends = F.coalesce(F.col("closed") > observed, F.lit(False))
    was = F.coalesce("o.retired", F.lit(False))
    retired = ends | (F.col("n").isNull() & was)
    same = F.col("n.content").eqNullSafe(F.col("o.content"))
    change = ladder(
        (F.col("n").isNull() & retired & ~was, "retired"), (F.col("n").isNull(), "kept"), (retired, "retired"),
        (F.col("o").isNull(), "inserted"), (was, "restored"), (same, "same"), otherwise=F.lit("revised"),
    )
    content = F.when(F.col("n").isNull(), F.col("o.content")).otherwise(F.col("n.content"))
    records = both.select("scope", "record", content.alias("content"), observed.alias("observed"), retired.alias("retired"), change.alias("outcome"))
    return Stored(stored.raw.unionByName(texts), stored.observations.unionByName(seen), records)
