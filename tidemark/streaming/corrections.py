"""Late corrections: a stream that re-opens the last days and leaves the settled ones alone.

The state is a table of day partitions, each in the version of the batch that wrote it last. A batch reads only the days
inside the trailing window that it has rows for, merges them, and writes them under its own number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.streaming.pipelines import drain, kept, landings

MOST_DAYS = 14  # fixed value


def _versions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return kept(spark, path, schema, "days", "day date, batch long")


def _newest(versions: DataFrame) -> DataFrame:
    last = versions.groupBy("day").agg(F.max("batch").alias("batch"))  # partition columns only, a row a day
    return versions.join(F.broadcast(last), ["day", "batch"])


def merge_days(batch: DataFrame, number: int, path: str, schema: str, keys: list[str], order: list[str], days: int) -> None:
    """Merges a batch (schema and day) into the table below path: of each day and keys the row that is last by order stays.

    Only the days from the newest known one back to days - 1 before it are open; a row of an earlier day changes nothing. A batch
    that comes again reads what lay there before it and replaces what it wrote, so it gives the same table.
    """
    spark = batch.sparkSession
    columns = [f.name for f in spark.createDataFrame([], schema).schema]
    batch = batch.select(*columns, "day").persist()
    try:
        before = _versions(spark, path, schema).where(F.col("batch") < number)
        newest = batch.agg(F.max("day").alias("d")).union(before.agg(F.max("day").alias("d"))).agg(F.max("d")).first()[0]
        if newest is None:
            return
        accepted = batch.where(F.col("day") >= F.date_sub(F.lit(newest), days - 1))
        touched = [r["day"] for r in accepted.select("day").distinct().collect()]  # no more than days of them
        if not touched:
            return
        old = _newest(before.where(F.col("day").isin(touched))).select(*columns, "day")
        row = F.struct(*columns)
        merged = old.union(accepted.select(*columns, "day")).groupBy(*keys, "day").agg(F.max_by(row, F.struct(*order)).alias("_"))
        out = merged.select("_.*", "day", F.lit(number).cast("long").alias("batch"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{path}/days")
    finally:
        batch.unpersist()


def correct(rows: DataFrame, path: str, keys: list[str], order: list[str], days: int = 7, key: str = "event_id", time: str = "ts") -> None:
    """Takes up what has newly landed below path/landed (rows like these, with day): replays of a key are left out, then days are merged.

    The watermark is the window itself: what it drops lies in settled days.
    """
    if not 1 <= days <= MOST_DAYS:
        raise ValueError(f"days must be between 1 and {MOST_DAYS}")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "day")
    stream = landings(rows, f"{path}/landed").withWatermark(time, f"{days} days").dropDuplicatesWithinWatermark([key])
    drain(stream.writeStream.foreachBatch(lambda batch, number: merge_days(batch, number, path, schema, keys, order, days)), path)


def corrected(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table as the batches so far have left it."""
    return _newest(_versions(spark, path, schema)).drop("batch")
