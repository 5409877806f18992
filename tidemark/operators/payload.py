"""Provider payloads to typed rows: value states, alias paths, lists, samples, times, webhooks. JSON is read as variant.

Nothing is coerced: an explicit null is present, a boolean is no number, numeric text is no
number, and whatever does not fit keeps its reason.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import exact_count, finite, ladder


@dataclass(frozen=True)
class Spec:
    """A metric of a payload: the paths it may stand at, in order, and what it must be (number, number_or_text, text, identifier)."""

    metric: str
    paths: tuple[str, ...]
    kind: str = "number"
    unit: str | None = None
    least: float | None = None  # a number below it is invalid
    low_reason: str = "below_bound"


def at_path(payload: Column, paths: tuple[str, ...]) -> tuple[Column, Column]:
    """(variant, path) of the first path that exists; a JSON null is a variant and so counts as present."""
    found = [F.try_variant_get(payload, f"$.{p}", "variant") for p in paths]
    return F.coalesce(*found), ladder(*[(v.isNotNull(), p) for v, p in zip(found, paths, strict=True)])


def scalar(payload: Column, spec: Spec) -> Column:
    """struct(state, number, text, reason, path): missing, null, value, or invalid with its reason."""
    v, path = at_path(payload, spec.paths)
    shape = F.schema_of_variant(v)
    is_number, is_text, is_whole = shape.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), shape == "STRING", shape == "BIGINT"
    number, text = F.try_variant_get(v, "$", "double"), F.trim(F.try_variant_get(v, "$", "string"))
    good_number = is_number & finite(number) & (F.lit(True) if spec.least is None else number >= spec.least)
    too_low = (is_number & (number < spec.least), spec.low_reason) if spec.least is not None else (F.lit(False), "")
    numeric = [(shape == "BOOLEAN", "boolean_not_numeric"), (is_number & ~finite(number), "non_finite_value"), too_low]
    good, reasons = {
        "number": (good_number, [*numeric, (is_text, "numeric_string_not_coerced")]),
        "number_or_text": (good_number | (is_text & (text != "")), [*numeric, (is_text, "numeric_string_not_coerced")]),
        "text": (is_text & (text != ""), [(is_text, "empty_text")]),
        "identifier": ((is_text & (text != "")) | is_whole, []),
    }[spec.kind]
    state = ladder((v.isNull(), "missing"), (F.is_variant_null(v), "null"), (good, "value"), otherwise=F.lit("invalid"))
    why = ladder(*reasons, (F.lit(True), "shape_drift"))
    wants_number = spec.kind in {"number", "number_or_text"}
    return F.struct(
        state.alias("state"),
        F.when((state == "value") & is_number & F.lit(wants_number), number).alias("number"),
        F.when((state == "value") & ~(is_number & F.lit(wants_number)), text).alias("text"),
        F.when(state == "invalid", why).alias("reason"),
        path.alias("path"),
    )


def normalize(rows: DataFrame, keys: list[str], payload: str, specs: list[Spec]) -> DataFrame:
    """The long metric table of JSON texts: a row for each of keys and spec. Text that is no JSON has every metric missing."""
    parsed = rows.select(*keys, F.try_parse_json(payload).alias("v"))
    each = F.array(*[F.struct(F.lit(s.metric).alias("metric"), F.lit(s.unit).alias("unit"), scalar(F.col("v"), s).alias("m")) for s in specs])
    return parsed.select(*keys, F.explode(each).alias("x")).select(*keys, "x.metric", "x.unit", "x.m.*")


def unknown_fields(payload: Column, known: list[str]) -> Column:
    """The top-level names of a JSON text that no spec knows, in order of name."""
    return F.sort_array(F.array_except(F.json_object_keys(payload), F.array(*[F.lit(x) for x in known])))


def selected_specs(rows: DataFrame, registry: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """The registry's specs (stream, metric, field) that apply to each row: those of its stream whose field the payload names."""
    named = rows.select(*keys, "stream", F.explode(F.json_object_keys(payload)).alias("field")).distinct()
    return named.join(F.broadcast(registry), ["stream", "field"]).select(*keys, "metric")


def record_status(states: DataFrame, keys: list[str]) -> DataFrame:
    """A record of metric states: invalid if it has no value and something invalid, partial if some are invalid, empty without values, else ok."""
    bad, good = F.count_if(F.col("state") == "invalid"), F.count_if(F.col("state") == "value")
    return states.groupBy(*keys).agg(good.alias("values"), bad.alias("invalid"), ladder(((good == 0) & (bad > 0), "invalid"), (bad > 0, "partial"), (good == 0, "empty"), otherwise=F.lit("ok")).alias("status"))


def payload_status(records: DataFrame, keys: list[str]) -> DataFrame:
    """The status of payloads from rows of (status of a record or null, severity of a diagnostic or null, blank: the payload is {})."""
    s, severity = F.col("status"), F.col("severity")
    n, error, warning = F.count(s), F.coalesce(F.bool_or(severity == "error"), F.lit(False)), F.coalesce(F.bool_or(severity == "warning"), F.lit(False))
    bad = F.count_if(s == "invalid")
    out = ladder(
        ((n == 0) & error, "invalid"), (n == 0, "empty"), (bad == n, "invalid"), (bad > 0, "partial"), (F.bool_or(s == "partial"), "partial"),
        (error | warning, "partial"), (F.bool_or("blank"), "empty"), otherwise=F.lit("ok"),
    )
    return records.groupBy(*keys).agg(n.alias("records"), out.alias("status"))


def listed(rows: DataFrame, keys: list[str], payload: str, path: str, schema: str) -> DataFrame:
    """The items of a payload's list with their ordinal; a payload without one keeps a row with a null ordinal, items of another shape are null."""
    items = F.try_variant_get(F.try_parse_json(payload), f"$.{path}", "array<variant>")
    return rows.select(*keys, F.posexplode_outer(items).alias("ordinal", "item")).select(*keys, "ordinal", F.try_variant_get("item", "$", schema).alias("item"))


def samples(rows: DataFrame, keys: list[str], payload: str, path: str) -> DataFrame:
    """The [epoch milliseconds, value] samples of a payload; a sample of another shape has the reason malformed_sample."""
    found = listed(rows, keys, payload, path, "array<double>").where("ordinal IS NOT NULL")
    good = (F.size("item") == 2) & F.col("item")[0].isNotNull()
    return found.select(*keys, "ordinal", F.when(good, F.timestamp_millis(F.col("item")[0].cast("long"))).alias("ts"), F.when(good, F.col("item")[1]).alias("value"), ladder((~F.coalesce(good, F.lit(False)), "malformed_sample")).alias("reason"))


def described_samples(rows: DataFrame, keys: list[str], payload: str, descriptors: str, path: str, wanted: list[str]) -> DataFrame:
    """Samples whose columns are named by a descriptor list of (key, index): a column for each wanted name."""
    v = F.try_parse_json(payload)
    named = F.try_variant_get(v, f"$.{descriptors}", "array<struct<key:string,index:int>>")
    place = F.map_from_entries(F.transform(named, lambda d: F.struct(d["key"], d["index"])))
    rows_ = rows.select(*keys, place.alias("place"), F.posexplode(F.try_variant_get(v, f"$.{path}", "array<array<double>>")).alias("ordinal", "item"))
    return rows_.select(*keys, "ordinal", *[F.get("item", F.try_element_at("place", F.lit(w))).alias(w) for w in wanted])


def temporal(text: Column) -> Column:
    """struct(precision, date, instant, offset_minutes, reason) of a provider's time text.

    A date alone, an instant with an offset (whose date is the one of its own clock), or a
    naive local time; anything else is unknown with the reason invalid_time.
    """
    day, clock, zone = r"\d{4}-\d{2}-\d{2}", r"\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?", r"(Z|[+-]\d{2}:\d{2})"
    date = F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")
    is_date, is_local, is_instant = text.rlike(f"^{day}$"), text.rlike(f"^{day}[T ]{clock}$"), text.rlike(f"^{day}[T ]{clock}{zone}$")
    stamp = F.try_to_timestamp(text)
    mark = F.regexp_extract(text, f"{zone}$", 1)
    minutes = F.when(mark == "Z", F.lit(0)).when(mark != "", F.concat(F.substring(mark, 1, 1), F.lit("1")).cast("int") * (F.substring(mark, 2, 2).cast("int") * 60 + F.substring(mark, 5, 2).cast("int")))
    precision = ladder((is_date & date.isNotNull(), "date"), (is_instant & stamp.isNotNull(), "instant"), (is_local & stamp.isNotNull(), "local"), otherwise=F.lit("unknown"))
    return F.struct(
        precision.alias("precision"), F.when(precision != "unknown", date).alias("date"), F.when(precision == "instant", stamp).alias("instant"),
        F.when(precision == "instant", minutes).alias("offset_minutes"), ladder((text.isNotNull() & (precision == "unknown"), "invalid_time")).alias("reason"),
    )


def paired_times(utc: Column, local: Column, calendar: Column) -> Column:
    """struct(instant, date, reason): the UTC instant wins; two unequal instants only raise a diagnostic. Date: calendar, local, UTC."""
    instant = F.coalesce(utc, local)
    return F.struct(instant.alias("instant"), F.coalesce(calendar, F.to_date(local), F.to_date(utc)).alias("date"), ladder((utc != local, "paired_time_mismatch")).alias("reason"))


def epoch_pair_offset(gmt_ms: Column, local_ms: Column) -> Column:
    """struct(offset_minutes, reason) of an instant's two epoch readings: whole minutes under a day."""
    delta = local_ms - gmt_ms
    ok = (delta % 60000 == 0) & (F.abs(delta) < 86_400_000)
    return F.struct(F.when(ok, (delta / 60000).cast("int")).alias("offset_minutes"), ladder((gmt_ms.isNull() | local_ms.isNull(), "missing_time"), (~ok, "implausible_offset")).alias("reason"))


def agreed_date(texts: list[Column]) -> Column:
    """struct(date, reason): all the dates that are present must be valid and equal."""
    given = F.filter(F.array(*texts), lambda x: x.isNotNull())
    dates = F.transform(given, lambda x: F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(x, "yyyy-MM-dd")))
    reason = ladder((F.size(given) == 0, "missing_date"), (F.exists(dates, lambda d: d.isNull()), "invalid_date"), (F.size(F.array_distinct(dates)) > 1, "conflicting_dates"))
    return F.struct(F.when(reason.isNull(), F.get(dates, F.lit(0))).alias("date"), reason.alias("reason"))


def activity_quality(metric: Column, value: Column) -> Column:
    """Why an activity summary is refused: heart rates must be positive, other quantities not negative; training figures have bounds of their own."""
    effect = metric.isin("aerobic_training_effect", "anaerobic_training_effect")
    return ladder(
        (~finite(value), "non_finite_value"),
        (metric.isin("heart_rate_bpm", "max_heart_rate_bpm") & (value <= 0), "nonpositive_heart_rate"),
        (metric.isin("duration_seconds", "distance_meters", "speed_mps", "session_total_calories") & (value < 0), "negative_activity_summary"),
        (effect & ~value.between(0, 5), "training_effect_out_of_range"),
        ((metric == "training_readiness") & ~value.between(1, 100), "readiness_out_of_range"),
        ((metric == "training_load") & (value < 0), "negative_training_quantity"),
    )


#: Pairs of metrics that check each other: (left, right, units, leaf pairs of one parent path, refused when, reason); fixed values.
CROSS_RULES = (
    ("heart_rate_bpm", "max_heart_rate_bpm", ("bpm", "bpm"), (("averageHR", "maxHR"),), lambda a, b: a > b, "average_exceeds_peak_heart_rate"),
    ("distance_meters", "duration_seconds", ("meters", "seconds"), (("distance", "duration"), ("distanceMeters", "durationSeconds")), lambda a, b: (a > 0) & (b == 0), "positive_distance_with_zero_duration"),
)


def cross_checked(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Long activity metrics (metric, state, value, unit, path) with the reason of each, single-field rules first.

    Two fields check each other only if both are good on their own, in their own units, and
    stand side by side under one parent path with a reviewed pair of names; then both are refused.
    """
    own = F.when(F.col("state") == "value", activity_quality(F.col("metric"), F.col("value")))
    seen = metrics.withColumn("reason", own)
    parent, leaf = F.regexp_extract("path", r"^(.*)\.[^.]*$", 1), F.regexp_extract("path", r"([^.]*)$", 1)
    usable = (F.col("state") == "value") & F.col("reason").isNull()
    wide = seen.where(usable).select(*keys, "metric", "value", "unit", parent.alias("parent"), leaf.alias("leaf"))
    hits = []
    for left, right, units, leaves, refused, reason in CROSS_RULES:
        a = wide.where((F.col("metric") == left) & (F.col("unit") == units[0])).select(*keys, "parent", F.col("leaf").alias("la"), F.col("value").alias("a"))
        b = wide.where((F.col("metric") == right) & (F.col("unit") == units[1])).select(*keys, "parent", F.col("leaf").alias("lb"), F.col("value").alias("b"))
        fits = F.lit(False)
        for x, y in leaves:
            fits = fits | ((F.col("la") == x) & (F.col("lb") == y))
        hit = a.join(b, [*keys, "parent"]).where(fits & refused(F.col("a"), F.col("b")))
        hits.append(hit.select(*keys, F.explode(F.array(F.lit(left), F.lit(right))).alias("metric"), F.lit(reason).alias("cross")))
    met = seen.join(hits[0].unionByName(hits[1]).groupBy(*keys, "metric").agg(F.min("cross").alias("cross")), [*keys, "metric"], "left")
    why = F.coalesce("cross", "reason")
    return met.select(*keys, "metric", F.when(why.isNotNull(), "invalid").otherwise(F.col("state")).alias("state"), F.when(why.isNull(), F.col("value")).alias("value"), why.alias("reason"))


def civil_date(year: Column, month: Column, day: Column) -> Column:
    """A date of its three numbers; null where they name none."""
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), F.try_to_date(text, "yyyy-MM-dd"))


def rolled_up_days(rows: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """Daily roll-up points: a civil start at midnight, an end one day later, an exact count; else why the point is refused."""
    point = "struct<civilStartTime:struct<date:struct<year:int,month:int,day:int>,time:struct<hours:int>>,civilEndTime:struct<date:struct<year:int,month:int,day:int>>,steps:struct<countSum:string>>"
    found = listed(rows, keys, payload, "rollupDataPoints", point).where("ordinal IS NOT NULL")
    date = lambda c: civil_date(F.col(f"{c}.date.year"), F.col(f"{c}.date.month"), F.col(f"{c}.date.day"))
    start, end, count = date("item.civilStartTime"), date("item.civilEndTime"), exact_count(F.col("item.steps.countSum"))
    reason = ladder((start.isNull() | end.isNull(), "invalid_civil_date"), (F.coalesce("item.civilStartTime.time.hours", F.lit(0)) != 0, "not_midnight"), (F.datediff(end, start) != 1, "not_one_day"), (count.isNull(), "invalid_count"))
    return found.select(*keys, "ordinal", F.when(reason.isNull(), start).alias("day"), F.when(reason.isNull(), count).alias("steps"), reason.alias("reason"))


def whole_pages(points: DataFrame, page: list[str], bad: Column) -> DataFrame:
    """Points of the pages that hold no bad one: one bad point refuses its page."""
    return points.withColumn("refused", F.bool_or(F.coalesce(bad, F.lit(False))).over(Window.partitionBy(*page))).where("NOT refused").drop("refused")


def interval_states(start: Column, end: Column) -> Column:
    """struct(start_state, end_state, reason) of the two time structs of an interval."""
    state = lambda t: ladder((t["precision"] == "instant", "value"), (t["reason"].isNotNull(), "invalid"), (t["precision"] == "unknown", "missing"), otherwise=F.lit("imprecise"))
    s, e = state(start), state(end)
    return F.struct(s.alias("start_state"), e.alias("end_state"), ladder(((s != "value") | (e != "value"), "endpoint_unavailable"), (end["instant"] <= start["instant"], "end_not_after_start")).alias("reason"))


def session_role(main: Column, nap: Column) -> Column:
    """main, nap or uncertain from the two provider flags; both or neither set is uncertain."""
    return ladder((F.coalesce(main, F.lit(False)) & ~F.coalesce(nap, F.lit(False)), "main"), (F.coalesce(nap, F.lit(False)) & ~F.coalesce(main, F.lit(False)), "nap"), otherwise=F.lit("uncertain"))


def identity_conflicts(points: DataFrame, keys: list[str], signature: list[str]) -> DataFrame:
    """Points with identity_conflict where one identity of a page has different signatures; equal repeats are one point."""
    one = points.select(*keys, *signature).distinct()
    return one.withColumn("reason", ladder((F.count("*").over(Window.partitionBy(*keys)) > 1, "identity_conflict")))


#: Kinds of webhook events and what they do to the ledger (fixed values).
WEBHOOK_ACTIONS = {"insert": "upsert", "update": "upsert", "delete": "delete", "clear": "clear", "test": "ledger_only"}


def envelopes(rows: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """Webhook envelopes as items: a single measurement or each of a batch, its action, and why it is quarantined."""
    item = "struct<id:string,date:string,weight:variant,values:array<variant>>"
    v = F.try_parse_json(payload)
    event = F.try_variant_get(v, "$.event", "string")
    action = F.element_at(F.create_map(*[F.lit(x) for kv in WEBHOOK_ACTIONS.items() for x in kv]), event)
    batch = F.try_variant_get(v, "$.measurements", "array<variant>")
    items = F.when(batch.isNotNull(), F.transform(batch, lambda x: F.try_variant_get(x, "$", item))).otherwise(F.array(F.try_variant_get(v, "$", item)))
    each = rows.select(*keys, event.alias("event"), action.alias("action"), F.posexplode_outer(items).alias("ordinal", "item"))
    reason = ladder(
        (F.col("event").isNull(), "missing_event"), (F.col("action").isNull(), "unknown_event"), ((F.col("action") == "delete") & F.col("item.id").isNull() & F.col("item.date").isNull(), "delete_without_identity"),
        ((F.col("action") == "upsert") & F.col("item.date").isNull(), "missing_date"),
    )
    return each.select(*keys, "ordinal", "event", "action", F.col("item.id").alias("record_id"), F.col("item.date").alias("date"), F.col("item.weight").alias("weight"), F.col("item.values").alias("values"), reason.alias("reason"))


def convenience_weight(values: Column, weight: Column) -> Column:
    """struct(state, value, reason) of an item's plain weight, which counts only where it has no values list; zero means missing."""
    shape, number = F.schema_of_variant(weight), F.try_variant_get(weight, "$", "double")
    is_number = shape.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    state = ladder((values.isNotNull(), "superseded"), (weight.isNull() | F.is_variant_null(weight) | (is_number & (number == 0)), "missing"), (is_number & finite(number) & (number > 0), "value"), otherwise=F.lit("invalid"))
    reason = ladder((state != "invalid", None), (is_number, "negative_weight"), (shape == "STRING", "numeric_string_not_coerced"), otherwise=F.lit("shape_drift"))
    return F.struct(state.alias("state"), F.when(state == "value", number).alias("value"), reason.alias("reason"))


def mapped_units(values: DataFrame, mapping: DataFrame) -> DataFrame:
    """values (key, unit, …) with the canonical metric of their exact (key, unit); others are kept as unknown."""
    return values.join(F.broadcast(mapping), ["key", "unit"], "left").withColumn("state", F.when(F.col("metric").isNull(), "unknown").otherwise("mapped"))


def date_matches_instant(day: Column, instant: Column, zone: Column) -> Column:
    """Why a local date contradicts an instant seen in a zone; null where it does not, or one is missing."""
    return ladder((instant.isNotNull() & zone.isNull(), "missing_zone"), (day != F.to_date(F.from_utc_timestamp(instant, zone)), "date_contradicts_instant"))


def lab_row_reason(kind: Column, decimal: Column, qualitative: Column) -> Column:
    """Why a lab row is no typed value: numeric asks for a decimal and no words, qualitative for words and no decimal, unparsed for neither."""
    return ladder(
        ((kind == "numeric") & (decimal.isNull() | qualitative.isNotNull()), "numeric_needs_a_decimal_alone"),
        ((kind == "qualitative") & (qualitative.isNull() | decimal.isNotNull()), "qualitative_needs_words_alone"),
        ((kind == "unparsed") & (decimal.isNotNull() | qualitative.isNotNull()), "unparsed_has_a_value"),
        (~kind.isin("numeric", "qualitative", "unparsed"), "unknown_kind"),
    )


def fanned_state(payload: Column, path: str) -> Column:
    """The state of a path below a list: any present item makes it present, equal states keep theirs, mixed ones are unknown."""
    head, _, tail = path.partition("[].")
    items = F.try_variant_get(payload, f"$.{head}", "array<variant>")
    one = lambda x: ladder((F.try_variant_get(x, f"$.{tail}", "variant").isNull(), "missing"), (F.is_variant_null(F.try_variant_get(x, f"$.{tail}", "variant")), "null"), (F.try_variant_get(x, f"$.{tail}", "string") == "", "empty"), otherwise=F.lit("present"))
    states = F.array_distinct(F.transform(items, one))
    return ladder((items.isNull(), "missing"), (F.size(states) == 0, "empty"), (F.array_contains(states, "present"), "present"), (F.size(states) > 1, "unknown"), otherwise=F.get(states, F.lit(0)))


def nanos(text: Column) -> Column:
    """struct(instant, nanos) of a UTC time text with up to nine decimals: an ordering key finer than a timestamp."""
    fraction = F.rpad(F.regexp_extract(text, r"\.(\d{1,9})Z$", 1), 9, "0").cast("int")
    whole = F.try_to_timestamp(F.concat(F.regexp_extract(text, r"^([^.Z]*)", 1), F.lit("Z")))
    return F.struct(whole.alias("instant"), F.when(whole.isNotNull(), F.coalesce(fraction, F.lit(0))).alias("nanos"))


def typed(payload: Column, path: str, kind: str) -> Column:
    """struct(state, text, flag, number, reason) of a provider value that is a text, a boolean, a number, or a whole number told as text (count)."""
    v = F.try_variant_get(payload, f"$.{path}", "variant")
    shape, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    is_number, count = shape.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), exact_count(text)
    good = {"text": (shape == "STRING") & (F.trim(text) != ""), "boolean": shape == "BOOLEAN", "number": is_number, "count": (shape == "STRING") & count.isNotNull()}[kind]
    state = ladder((v.isNull(), "missing"), (F.is_variant_null(v), "null"), (good, "value"), otherwise=F.lit("invalid"))
    ok = state == "value"
    number = count.cast("double") if kind == "count" else F.try_variant_get(v, "$", "double")
    return F.struct(
        state.alias("state"), F.when(ok & F.lit(kind == "text"), F.trim(text)).alias("text"), F.when(ok & F.lit(kind == "boolean"), F.try_variant_get(v, "$", "boolean")).alias("flag"),
        F.when(ok & F.lit(kind in {"number", "count"}), number).alias("number"), F.when(state == "invalid", F.concat(F.lit("not_a_"), F.lit(kind))).alias("reason"),
    )


def offset_minutes(text: Column) -> Column:
    """Whole minutes of a provider's UTC offset ('3600s'), within a day; null where it is none."""
    seconds = F.when(text.rlike(r"^-?\d{1,5}s$"), F.regexp_extract(text, r"^(-?\d+)s$", 1)).cast("int")
    return F.when((seconds % 60 == 0) & (F.abs(seconds) < 86400), (seconds / 60).cast("int"))


def clock_time(hours: Column, minutes: Column, seconds: Column) -> Column:
    """Seconds of a day from its parts, absent ones counting as zero; null where one is out of range or all are absent."""
    h, m, s = (F.coalesce(x, F.lit(0)) for x in (hours, minutes, seconds))
    ok = h.between(0, 23) & m.between(0, 59) & s.between(0, 59) & F.coalesce(hours, minutes, seconds).isNotNull()
    return F.when(ok, h * 3600 + m * 60 + s)
