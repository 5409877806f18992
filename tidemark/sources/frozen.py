"""Frozen inputs: write-once bodies addressed by the hash of their canonical form.

The store lies below one folder, in partitions named by the first digits of the hashes they hold. What is in it is
never rewritten: a scope that comes again with the same body writes nothing, with another body it is refused unless it
names the hash that it supersedes.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions import ladder
from tidemark.functions.canonical import canonical_json
from tidemark.streaming.pipelines import kept


def sealed(rows: DataFrame, scope: Sequence[str], body: Column, supersedes: Column | None = None) -> DataFrame:
    """scope, body (canonical JSON of a struct, nulls kept), hash and supersedes of each row."""
    text = canonical_json(F.to_json(body, {"ignoreNullFields": "false"}))
    named = rows.select(*scope, text.alias("body"), (supersedes if supersedes is not None else F.lit(None)).cast("string").alias("supersedes"))
    return named.select(*scope, "body", F.sha2("body", 256).alias("hash"), "supersedes")


def list_digest(rows: DataFrame, keys: Sequence[str], block: Column, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """keys, n and digest of each group's rows in order: rows are hashed by blocks and the blocks' hashes once more.

    No list is longer than a block or than the number of blocks, so block is chosen to bound both.
    """
    line = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns])
    parts = rows.select(*keys, block.alias("block"), F.struct(*order, line.alias("line")).alias("r")).groupBy(*keys, "block").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("r")).alias("rs"))
    hashed = parts.select(*keys, "block", "n", F.sha2(F.array_join("rs.line", "\x1e"), 256).alias("h"))
    pairs = F.sort_array(F.collect_list(F.struct("block", "h")))
    return hashed.groupBy(*keys).agg(F.sum("n").alias("n"), pairs.alias("hs")).select(*keys, "n", F.sha2(F.array_join("hs.h", "\x1e"), 256).alias("digest"))


def _same(scope: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"i.{c}").eqNullSafe(F.col(f"o.{c}")) for c in scope])


def _schema(rows: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name not in {"address", "batch"})


def frozen(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All bodies of the store; intact tells whether a body still has the hash that it lies under."""
    rows = kept(spark, path, schema, "frozen", "batch long, address string")
    return rows.withColumn("intact", (F.sha2("body", 256) == F.col("hash")) & (F.substring("hash", 1, 2) == F.col("address")))


def freeze(rows: DataFrame, scope: Sequence[str], path: str, batch: int) -> DataFrame:
    """Stores sealed() rows as batch number batch; scope, hash and outcome of each scope, read from what the batch left behind.

    frozen: its body is stored now. replayed: it already was, and nothing is written. refused: another body holds the scope, and
    is not the one that this one supersedes. conflicting_input: one batch has several bodies for the scope, none is
    stored. A batch that is run again under its number finds what lay there before it and leaves the same.
    """
    spark, schema = rows.sparkSession, _schema(rows)
    one = rows.groupBy(*scope).agg(F.count_distinct("hash").alias("bodies"), F.min("hash").alias("hash"), F.min("body").alias("body"), F.max("supersedes").alias("supersedes"))
    before = frozen(spark, path, schema).where(F.col("batch") < batch)
    gone = before.where("supersedes IS NOT NULL").select(*scope, F.col("supersedes").alias("hash"))
    heads = before.select(*scope, "hash").join(gone.select(*[F.col(c).alias(f"_{c}") for c in scope], F.col("hash").alias("_hash")), reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in scope]) & (F.col("hash") == F.col("_hash")), "left_anti")
    met = one.alias("i").join(heads.alias("o"), _same(scope), "left")
    outcome = ladder(
        (F.col("i.bodies") > 1, "conflicting_input"), (F.col("o.hash").isNull() & F.col("i.supersedes").isNull(), "frozen"), (F.col("o.hash") == F.col("i.hash"), "replayed"), (F.col("o.hash").eqNullSafe(F.col("i.supersedes")), "frozen"), otherwise=F.lit("refused"),
    )
    told = met.select("i.*", outcome.alias("outcome")).withColumn("address", F.substring("hash", 1, 2))
    told.write.mode("overwrite").parquet(f"{path}/outcomes/batch={batch}")
    seen = spark.read.schema(told.schema).parquet(f"{path}/outcomes/batch={batch}")
    new = seen.where("outcome = 'frozen'").select(*[c for c in rows.columns], "address")
    new.repartition("address").write.mode("overwrite").partitionBy("address").parquet(f"{path}/frozen/batch={batch}")
    return seen.select(*scope, F.when(F.col("outcome") != "conflicting_input", F.col("hash")).alias("hash"), "outcome")
