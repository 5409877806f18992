"""Data points of a health provider's streams to typed metrics: a table of fields for each stream, read in one pass.

A point holds its values below one key of its stream. Every field of the stream gives a row for each point, with its state
(missing, null, value, invalid) and the reason of what is not a value; nothing is dropped or guessed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import finite, ladder


@dataclass(frozen=True)
class Field:
    """A metric below the component of a stream, in the component itself or in one of its objects (parent)."""

    metric: str
    name: str
    kind: str = "number"  # number, integer, text, flag or timestamp
    unit: str | None = None
    parent: str | None = None
    required: bool = False
    least: float | None = None
    most: float | None = None
    allowed: tuple[str, ...] = ()


def _respiratory(prefix: str, parent: str, required: bool) -> list[Field]:
    names = {"breaths_per_minute": "breathsPerMinute", "standard_deviation": "standardDeviation", "signal_to_noise": "signalToNoise"}
    return [Field(f"respiratory_{prefix}_{metric}", name, parent=parent, required=required and metric == "breaths_per_minute", least=0) for metric, name in names.items()]


def _percent(metric: str, name: str) -> Field:
    return Field(f"daily_oxygen_saturation_{metric}_percentage", name, unit="%", required=True, least=0, most=100)


#: The component key of each stream (fixed values).
COMPONENTS = {
    "heart_rate": "heartRate", "hrv": "heartRateVariability", "daily_hrv": "dailyHeartRateVariability", "daily_resting_hr": "dailyRestingHeartRate", "spo2": "oxygenSaturation", "daily_spo2": "dailyOxygenSaturation",
    "respiratory_rate_sleep": "respiratoryRateSleepSummary", "daily_respiratory_rate": "dailyRespiratoryRate", "sleep": "sleep", "heart_rate_rollup": "heartRate",
}

#: The metrics of each stream (fixed values).
FIELDS: dict[str, list[Field]] = {
    "heart_rate": [
        Field("heart_rate_bpm", "beatsPerMinute", "integer", "bpm", required=True),
        Field("heart_rate_motion_context", "motionContext", "text", parent="metadata"),
        Field("heart_rate_sensor_location", "sensorLocation", "text", parent="metadata"),
    ],
    "hrv": [Field("hrv_rmssd_ms", "rootMeanSquareOfSuccessiveDifferencesMilliseconds", unit="ms"), Field("hrv_sdnn_ms", "standardDeviationMilliseconds", unit="ms")],
    "daily_hrv": [
        Field("daily_hrv_average_ms", "averageHeartRateVariabilityMilliseconds", unit="ms"),
        Field("daily_hrv_non_rem_bpm", "nonRemHeartRateBeatsPerMinute", "integer", "bpm"),
        Field("daily_hrv_entropy", "entropy"),
        Field("daily_hrv_deep_sleep_rmssd_ms", "deepSleepRootMeanSquareOfSuccessiveDifferencesMilliseconds", unit="ms"),
    ],
    "daily_resting_hr": [
        Field("daily_resting_heart_rate_bpm", "beatsPerMinute", "integer", "bpm", required=True),
        Field("daily_resting_heart_rate_calculation_method", "calculationMethod", "text", parent="dailyRestingHeartRateMetadata", required=True),
    ],
    "spo2": [Field("oxygen_saturation_percentage", "percentage", unit="%", required=True, least=0, most=100)],
    "daily_spo2": [
        _percent("average", "averagePercentage"), _percent("lower", "lowerBoundPercentage"), _percent("upper", "upperBoundPercentage"),
        Field("daily_oxygen_saturation_standard_deviation_percentage", "standardDeviationPercentage", unit="%", least=0),
    ],
    "respiratory_rate_sleep": [
        *_respiratory("deep_sleep", "deepSleepStats", False), *_respiratory("light_sleep", "lightSleepStats", False), *_respiratory("rem_sleep", "remSleepStats", False), *_respiratory("full_sleep", "fullSleepStats", True),
    ],
    "daily_respiratory_rate": [Field("daily_respiratory_rate_breaths_per_minute", "breathsPerMinute", unit="breaths_per_minute", required=True, least=0)],
    "sleep": [
        Field("sleep_type", "type", "text", allowed=("SLEEP_TYPE_UNSPECIFIED", "CLASSIC", "STAGES")),
        *[Field(f"sleep_metadata_{m}", n, "flag", parent="metadata") for m, n in (("processed", "processed"), ("main", "main"), ("nap", "nap"), ("manually_edited", "manuallyEdited"))],
        Field("sleep_metadata_external_id", "externalId", "text", parent="metadata"),
        *[Field(f"sleep_summary_minutes_{m}", f"minutes{n}", "integer", "min", parent="summary") for m, n in (("in_sleep_period", "InSleepPeriod"), ("after_wake_up", "AfterWakeUp"), ("to_fall_asleep", "ToFallAsleep"), ("asleep", "Asleep"), ("awake", "Awake"))],
        Field("sleep_create_time", "createTime", "timestamp"),
        Field("sleep_update_time", "updateTime", "timestamp"),
    ],
    "heart_rate_rollup": [Field(f"heart_rate_bpm_{x.lower()}", f"beatsPerMinute{x}", unit="bpm") for x in ("Avg", "Max", "Min")],
}

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_WHOLE = r"^[+-]?(0|[1-9]\d*)$"


def _raw(component: Column, spec: Field) -> Column:
    """A field as it stands in a component variant: its rules, why its parent bars it, and its variant."""
    holder = component if spec.parent is None else F.try_variant_get(component, f"$.{spec.parent}", "variant")
    shape = F.schema_of_variant(holder)
    barred = F.lit(None).cast("string") if spec.parent is None else ladder((holder.isNull(), "parent_field_missing"), (shape == "VOID", "parent_field_null"), (~F.startswith(shape, F.lit("OBJECT")), "parent_shape_invalid"))
    rules = {"metric": spec.metric, "unit": spec.unit, "kind": spec.kind}
    return F.struct(
        *[F.lit(value).cast("string").alias(name) for name, value in rules.items()], F.lit(spec.required).alias("required"), *[F.lit(value).cast("double").alias(name) for name, value in (("least", spec.least), ("most", spec.most))],
        (F.array(*[F.lit(x) for x in spec.allowed]) if spec.allowed else F.lit(None).cast("array<string>")).alias("allowed"), barred.alias("barred"), F.try_variant_get(component, f"$.{spec.parent + '.' if spec.parent else ''}{spec.name}", "variant").alias("v"),
    )


def _judged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of _raw fields with state, reason and value; the rules are columns, so that one expression serves all fields."""
    kind, told, number = F.col("kind"), F.col("told"), F.col("number")
    typed = rows.withColumn("shape", F.schema_of_variant("v")).withColumn("told", F.trim(F.when(F.col("shape") == "STRING", F.try_variant_get("v", "$", "string"))))
    is_number = F.col("shape").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    read = F.when(is_number, F.try_variant_get("v", "$", "double")).when(F.when(kind == "integer", told.rlike(_WHOLE)).otherwise(told.rlike(_NUMBER)), told.try_cast("double"))
    typed = typed.withColumn("number", F.when(kind.isin("number", "integer"), read))
    numeric = kind.isin("number", "integer")
    stamp = told.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,9})?(Z|[+-]\d\d:\d\d)$") & F.try_to_timestamp(told).isNotNull()
    word = F.when(F.col("required"), "required_field").otherwise("field")
    reason = (
        F.when(F.col("fault").isNotNull(), F.col("fault"))
        .when(F.col("barred").isNotNull(), F.col("barred"))
        .when(F.col("v").isNull(), F.concat(word, F.lit("_missing")))
        .when(F.col("shape") == "VOID", F.concat(word, F.lit("_null")))
        .when((kind == "text") & (told.isNull() | (told == "")), "string_shape_invalid")
        .when((kind == "text") & ~F.array_contains("allowed", told), "enum_unknown")
        .when((kind == "flag") & (F.col("shape") != "BOOLEAN"), "boolean_shape_invalid")
        .when((kind == "timestamp") & ~F.coalesce(stamp, F.lit(False)), "timestamp_invalid")
        .when(numeric & (~finite(number) | number.isNull() | ((kind == "integer") & (number != F.floor(number)))), "numeric_invalid_or_non_finite")
        .when(numeric & ((number < F.col("least")) | (number > F.col("most"))), "numeric_out_of_range")
    )
    known = typed.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    state = ladder((ok, "value"), (F.col("fault").isNotNull(), "invalid"), (F.endswith("reason", F.lit("_missing")), "missing"), (F.endswith("reason", F.lit("_null")), "null"), otherwise=F.lit("invalid"))
    return known.select(*keys, "stream", "metric", "unit", state.alias("state"), F.when(ok, number).alias("number"), F.when(ok, told).alias("text"), F.when(ok & (kind == "flag"), F.try_variant_get("v", "$", "boolean")).alias("flag"), "reason", "required")


def normalized_points(points: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each field of each point's stream; points are (keys, stream, point variant).

    A point without its component's object has one row without a metric: data_type_union_missing or data_type_component_shape, and so
    has one of a stream that is not known (unsupported_stream). The stream chooses the fields inside one pass.
    """
    component = F.lit(None).cast("variant")
    for stream, name in COMPONENTS.items():
        component = F.when(F.col("stream") == stream, F.try_variant_get("point", f"$.{name}", "variant")).otherwise(component)
    read = points.withColumn("component", component)
    fault = ladder((~F.coalesce(F.col("stream").isin(*FIELDS), F.lit(False)), "unsupported_stream"), (F.col("component").isNull(), "data_type_union_missing"), (~F.startswith(F.schema_of_variant("component"), F.lit("OBJECT")), "data_type_component_shape"))
    parts = {stream: F.array(*[_raw(F.col("component"), f) for f in fields]) for stream, fields in FIELDS.items()}
    none = F.array(_raw(F.lit(None).cast("variant"), Field("", "none", required=True)).withField("metric", F.lit(None).cast("string")))
    made = F.when(F.col("fault").isNotNull(), none)
    for stream, fields in parts.items():
        made = made.when(F.col("stream") == stream, fields)
    return _judged(read.withColumn("fault", fault).select(*keys, "stream", "fault", F.inline(made)), keys)


def point_status(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """keys, stream, status and counts: invalid where a required field has no value, partial where an optional one is invalid, else ok.

    A daily variability without any value is invalid, too.
    """
    no_value = F.count_if(F.col("state") == "value") == 0
    bad = F.bool_or(F.col("required") & (F.col("state") != "value")) | ((F.col("stream") == "daily_hrv") & no_value)
    status = F.when(bad, "invalid").when(F.bool_or(F.col("state") == "invalid"), "partial").otherwise("ok")
    return metrics.groupBy(*keys, "stream").agg(status.alias("status"), F.count_if(F.col("state") == "value").alias("n_values"))
