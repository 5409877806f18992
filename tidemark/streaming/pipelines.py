"""Structured Streaming: landed rows, watermarked windows, idempotent replay, latest-by-key upserts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.session import shared_dir

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def landed(spark: SparkSession, sf_dir: str, table: str = "events", schema: str = EVENTS) -> DataFrame:
    """A stream over a table of a data folder: its one file or its folder of files."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{table}.parquet")


def drain(stream, path: str) -> None:
    """Runs a stream over what has landed and ends it; a later call with the same path goes on from there."""
    query = stream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def land(rows: DataFrame, folder: str) -> None:
    """Adds rows to a landing folder, as one delivery."""
    rows.write.mode("append").parquet(folder)


def landings(rows: DataFrame, folder: str) -> DataFrame:
    """The stream over a landing folder of rows like these."""
    return rows.sparkSession.readStream.schema(rows.schema).parquet(folder)


def changes(path: str):
    """A foreachBatch sink that keeps each batch's rows under its own number, so that a repeated batch replaces itself."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    return keep


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def kept(spark: SparkSession, path: str, schema: str, folder: str = "out", parts: str = "batch long") -> DataFrame:
    """The rows below path/folder; none where no batch has written any yet."""
    full = f"{schema}, {parts}"
    return spark.read.schema(full).parquet(f"{path}/{folder}") if exists(spark, f"{path}/{folder}") else spark.createDataFrame([], full)


def newest(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """Of the rows that changes() kept, the one of each key that came with the latest batch."""
    rows = kept(spark, path, schema)
    values = [c for c in rows.columns if c not in {*keys, "batch"}]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_")).select(*keys, "_.*")


def deduplicated(rows: DataFrame, key: str = "event_id", time: str = "ts", late: str = "14 days") -> DataFrame:
    """Idempotent replay: a key is taken once within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def tumbling(spark: SparkSession, sf_dir: str, width: str = "1 day", late: str = "14 days") -> DataFrame:
    """Counts and sums of each type and window.

    A batch gives out only the windows that it changed, and windows that the watermark has passed leave the state.
    """
    path = f"{shared_dir(spark)}/tumbling_{uuid.uuid4().hex}"
    rows = landed(spark, sf_dir).withWatermark("ts", late)
    sums = rows.groupBy("event_type", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    out = sums.select("event_type", F.col("w.start").alias("start"), "n", "total")
    drain(out.writeStream.outputMode("update").foreachBatch(changes(path)), path)
    return newest(spark, path, "event_type string, start timestamp, n long, total double", ["event_type", "start"])


def replayed(spark: SparkSession, rows: DataFrame, again: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """rows, then again, as two deliveries of one stream that takes each key once within the watermark."""
    path = f"{shared_dir(spark)}/replays_{uuid.uuid4().hex}"
    for delivery in (rows, again):
        land(delivery, f"{path}/landed")
        once = deduplicated(landings(rows, f"{path}/landed"), key, time, late)
        drain(once.writeStream.outputMode("append").foreachBatch(changes(path)), path)
    return kept(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)).drop("batch")


def latest_by_key(spark: SparkSession, sf_dir: str, key: str = "user_id", path: str | None = None) -> DataFrame:
    """The newest row of each key; older receipts never roll back.

    The state store holds one row a key. A batch writes only the keys that it changed, under its
    own number, so a repeated batch replaces itself and nothing is rewritten; a run with the
    same path goes on where the last one ended.
    """
    path = path or f"{shared_dir(spark)}/latest_{uuid.uuid4().hex}"
    top = landed(spark, sf_dir).groupBy(key).agg(F.max(F.struct("ts", "event_id")).alias("m")).select(key, "m.event_id", "m.ts")
    drain(top.writeStream.outputMode("update").foreachBatch(changes(path)), path)
    return newest(spark, path, f"{key} long, event_id long, ts timestamp", [key])


def closed_days(spark: SparkSession, sf_dir: str, path: str | None = None, late: str = "14 days") -> DataFrame:
    """(user_id, day, pages) of the days that a stream of pages has closed; a day that is still open shows nothing.

    The page of a day's last hour is its terminal one. Counts live in the state store until the watermark has passed
    their day, so late pages of a day add to it; a batch gives out the days that it changed.
    """
    path = path or f"{shared_dir(spark)}/days_{uuid.uuid4().hex}"
    pages = landed(spark, sf_dir).select("user_id", "ts", (F.hour("ts") == 23).alias("terminal")).withWatermark("ts", late)
    days = pages.groupBy("user_id", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("pages"), F.bool_or("terminal").alias("closed"))
    out = days.select("user_id", F.to_date("w.start").alias("day"), "pages", "closed")
    drain(out.writeStream.outputMode("update").foreachBatch(changes(path)), path)
    return newest(spark, path, "user_id long, day date, pages long, closed boolean", ["user_id", "day"]).where("closed").drop("closed")
