"""Which device a payload speaks of: a walk through variants of unknown depth, one level of all payloads at a time."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import ladder
from tidemark.session import shared_dir

# Keys of device fields, of models inside them and of identifiers, and markers of models.
DEVICE_KEYS = ("device", "deviceinfo", "deviceattributed", "isdeviceattributed", "devicemodel", "devicemodelname", "devicetype", "devicemanufacturer", "sourcedevice")
MODEL_KEYS = ("model", "modelname", "devicemodel", "devicemodelname", "devicetype", "devicemanufacturer", "manufacturer")
IDENTIFIER_KEYS = ("deviceid", "deviceuuid", "deviceidentifier", "sourcedeviceid")
TARGET_MARKERS = ("vivoactive5",)
OTHER_MARKERS = ("forerunner", "venu", "fenix", "edge", "instinct", "lily", "descent", "epix", "marq", "tactix")
MOST_FIELDS, MOST_ITEMS, MOST_NODES = 64, 64, 512  # fixed values

FLAGS = ("has_device", "opaque", "unattributed", "target", "other", "too_wide")


def _any(text: Column, markers: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in markers], F.lit(False))


def _level(frontier: DataFrame, target: Sequence[str], other: Sequence[str]) -> DataFrame:
    """The entries of the frontier's objects and arrays, with what each says and whether it is looked into."""
    entries = frontier.select("id", "v", "context").lateralJoin(frontier.sparkSession.tvf.variant_explode(F.col("v").outer()))
    kind = F.schema_of_variant("value")
    key = F.regexp_replace(F.lower("key"), "[^a-z0-9]", "")
    in_list = F.col("key").isNull()
    named = entries.select("id", "context", "value", key.alias("name"), in_list.alias("in_list"), kind.alias("kind"))
    holds = F.startswith("kind", F.lit("OBJECT")) | F.startswith("kind", F.lit("ARRAY"))
    empty = F.col("kind").isin("OBJECT<>", "ARRAY<VOID>") & (F.trim(F.to_json("value")).isin("{}", "[]"))
    null = F.col("value").isNull() | F.is_variant_null("value")
    flag = F.col("kind") == "BOOLEAN"
    scalar = ~null & ~holds & ~flag
    device = ~F.col("in_list") & ~F.col("name").isin(*IDENTIFIER_KEYS) & (F.col("name").isin(*DEVICE_KEYS) | F.contains("name", F.lit("device")))
    attributed = device & F.col("name").isin("deviceattributed", "isdeviceattributed")
    model = ~F.col("in_list") & ~device & F.col("context") & (F.col("name").isin(*MODEL_KEYS) | F.contains("name", F.lit("model")))
    read = (device & ~attributed & scalar) | (model & scalar)
    text = F.regexp_replace(F.lower(F.try_variant_get("value", "$", "string")), r"[-_\s]", "")
    is_target, is_other = read & _any(text, target), read & _any(text, other)
    opaque = (read & ~is_target & ~is_other) | (device & ~attributed & (null | empty)) | (model & ~scalar) | (attributed & flag & F.try_variant_get("value", "$", "boolean"))
    inside = (device & ~attributed) | F.col("in_list") | (~device & ~model & holds)
    marks = {"has_device": device, "opaque": opaque, "unattributed": attributed & flag & ~F.try_variant_get("value", "$", "boolean"), "target": is_target, "other": is_other}
    size = F.when(F.startswith("kind", F.lit("OBJECT")), F.size(F.json_object_keys(F.to_json("value"))) > MOST_FIELDS).otherwise(F.json_array_length(F.to_json("value")) > MOST_ITEMS)
    wide = inside & holds & size
    return named.select("id", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in marks.items()], F.coalesce(wide, F.lit(False)).alias("too_wide"), inside.cast("long").alias("nodes"), F.when(inside & holds, F.col("value")).alias("v"), (F.col("context") | device).alias("context"))


def attribution(payloads: DataFrame, target: Sequence[str] = TARGET_MARKERS, other: Sequence[str] = OTHER_MARKERS) -> DataFrame:
    """payloads (id, payload variant) with attribution (target_device, other_device, mixed, unattributed, unknown) and reason.

    Fields below a device key are read for models; what is wider or larger than the bounds is unknown, never a
    part of it. Each level of all payloads is one pass that writes what it found and what lies below; the passes end
    when nothing does, so their number is the depth of the deepest payload. ids are unique; a null payload says nothing.
    """
    spark = payloads.sparkSession
    path = f"{shared_dir(spark)}/devices_{uuid.uuid4().hex}"
    whole = payloads.select("id", F.col("payload").alias("v"))
    kind = F.coalesce(F.schema_of_variant("v"), F.lit(""))
    size = F.when(F.startswith(kind, F.lit("OBJECT")), F.size(F.json_object_keys(F.to_json("v"))) > MOST_FIELDS).when(F.startswith(kind, F.lit("ARRAY")), F.json_array_length(F.to_json("v")) > MOST_ITEMS)
    root = whole.select("id", *[F.lit(False).alias(n) for n in FLAGS[:-1]], F.coalesce(size, F.lit(False)).alias("too_wide"), F.lit(1).cast("long").alias("nodes"), F.when(F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY")), F.col("v")).alias("v"), F.lit(False).alias("context"))
    depth, level = 0, root
    while True:
        level.write.parquet(f"{path}/depth={depth}")
        frontier = spark.read.schema(root.schema).parquet(f"{path}/depth={depth}").where("v IS NOT NULL")
        if frontier.isEmpty():
            break
        depth, level = depth + 1, _level(frontier, target, other)
    found = spark.read.schema(root.drop("v", "context").schema).parquet(path).groupBy("id").agg(*[F.bool_or(n).alias(n) for n in FLAGS], F.sum("nodes").alias("nodes"))
    c = {n: F.col(n) for n in FLAGS}
    reason = ladder(
        (c["too_wide"] | (F.col("nodes") > MOST_NODES), "attribution_traversal_bounded"),
        (c["target"] & c["other"], "mixed_device_models"),
        ((c["target"] | c["other"]) & (c["unattributed"] | c["opaque"]), "device_attribution_unresolved"),
        (c["target"], "explicit_target_model"),
        (c["other"], "explicit_other_model"),
        (c["unattributed"], "explicit_unattributed"),
        (c["opaque"], "device_field_without_safe_model"),
        (c["has_device"], "device_field_unresolved"),
        otherwise=F.lit("no_device_attribution_field"),
    )
    told = found.select("id", reason.alias("reason"))
    kinds = {"mixed_device_models": "mixed", "explicit_target_model": "target_device", "explicit_other_model": "other_device", "explicit_unattributed": "unattributed", "no_device_attribution_field": "unattributed"}
    named = F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.col("reason"))
    return told.select("id", F.coalesce(named, F.lit("unknown")).alias("attribution"), "reason")
