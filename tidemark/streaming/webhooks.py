"""Webhook bodies to a ledger of records: state that carries tombstones from one delivery to later ones.

Every record keeps its last upsert or delete and every user the last clear, each by order of arrival. Both are maxima, so they
can be taken in any split of the bodies into batches, and a body that comes again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions import ladder
from tidemark.streaming.pipelines import changes, drain, landings, newest

BODY = "event string, userId bigint, id bigint, weight double"
#: Events of the sender and what they do to the ledger (fixed values).
ACTIONS = {"insert": "upsert", "update": "upsert", "delete": "delete", "clear": "clear", "test": "ledger_only"}
_STATE = "user_id long, record long, arrived long, action string, value double"


def parsed(bodies: DataFrame) -> DataFrame:
    """bodies (arrived, body) with user_id, record, value, action and fault: why a body is refused as a whole, or null.

    A measurement that names no record is kept out of the ledger (no_record); controls need none.
    """
    action: Column = F.element_at(F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair]), F.col("b.event"))
    read = bodies.withColumn("b", F.from_json("body", BODY, {"mode": "PERMISSIVE"})).withColumn("action", action)
    whole = F.try_parse_json("body")
    fault = ladder(
        (whole.isNull() | ~F.coalesce(F.startswith(F.schema_of_variant(whole), F.lit("OBJECT")), F.lit(False)), "invalid_body"),
        (F.col("action").isNull(), "unknown_event"),
        (F.col("b.userId").isNull(), "no_user"),
        (F.col("action").isin("upsert", "delete") & F.col("b.id").isNull(), "no_record"),
        ((F.col("action") == "upsert") & F.col("b.weight").isNull(), "no_value"),
    )
    return read.select("arrived", F.col("b.userId").alias("user_id"), F.col("b.id").alias("record"), F.col("b.weight").alias("value"), "action", fault.alias("fault"))


def ingest(bodies: DataFrame, path: str) -> None:
    """Takes up the bodies (arrived, body) that have newly landed below path/landed.

    The state store holds a row for each record and one for each user that was cleared, so no user's records meet in one task.
    """
    good = parsed(landings(bodies, f"{path}/landed")).where("fault IS NULL AND action <> 'ledger_only'")
    of = good.withColumn("record", F.when(F.col("action") != "clear", F.col("record")))
    last = of.groupBy("user_id", "record").agg(F.max(F.struct("arrived", "action", "value")).alias("m")).select("user_id", "record", "m.*")
    drain(last.writeStream.outputMode("update").foreachBatch(changes(path)), path)


def records(spark: SparkSession, path: str) -> DataFrame:
    """user_id, record, state (active, deleted, cleared) and the value of active ones, as the deliveries so far have left them."""
    state = newest(spark, path, _STATE, ["user_id", "record"])
    clears = state.where("record IS NULL").select("user_id", F.col("arrived").alias("cleared"))
    met = state.where("record IS NOT NULL").join(clears, "user_id", "left")
    shown = ladder((F.col("cleared") > F.col("arrived"), "cleared"), (F.col("action") == "delete", "deleted"), otherwise=F.lit("active"))
    return met.select("user_id", "record", shown.alias("state"), F.when(shown == "active", F.col("value")).alias("value"))
