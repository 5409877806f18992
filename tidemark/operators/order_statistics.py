"""Exact quantiles of groups of any size.

A group of up to LIMIT rows goes through the built-in percentile, whose buffer holds the group's distinct values. What is larger
is range-partitioned by group and value, so that a hot group lies in many tasks: the counts of a group's
partitions tell which partitions hold the wanted ranks, and only these are looked at again.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.session import shared_dir

LIMIT = 1_000_000


def _same(a: str, b: str, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys], F.lit(True))


def ranged_quantiles(rows: DataFrame, keys: list[str], value: str, probabilities: Mapping[str, float]) -> DataFrame:
    """keys and a column for each named probability: linear interpolation between the ranks around (n - 1) * p.

    Equal values are one row with a count before anything is sorted, so ties weigh nothing. The sorted
    table is written, since its partitions are looked at twice and must be the same both times; the look at wanted
    ranks sorts one partition of a group at a time.
    """
    spark, names = rows.sparkSession, keys
    keys = [f"key{i}" for i in range(len(names))]  # apart from the names used below
    rows = rows.select(*[F.col(c).alias(k) for c, k in zip(names, keys)], F.col(value).alias("value"))
    path = f"{shared_dir(spark)}/ranges_{uuid.uuid4().hex}"
    counted = rows.where("value IS NOT NULL").groupBy(*keys, F.col("value").cast("double").alias("v")).agg(F.count("*").alias("c"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted.repartitionByRange(parts, *keys, "v").withColumn("part", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.schema(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counted.schema) + ", part int").parquet(path)
    sizes = ranged.groupBy(*keys, "part").agg(F.sum("c").alias("size"))
    of_group = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("size").over(of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumns({"before": before, "n": F.sum("size").over(of_group)})
    at = lambda p: (F.col("n") - 1) * F.lit(float(p))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(high).alias("high"), (F.ceil(at(p)) if high else F.floor(at(p))).cast("long").alias("rank")) for name, p in probabilities.items() for high in (False, True)])
    targets = sizes.select(*keys, "part", "before", "size", F.explode(wanted).alias("w")).where((F.col("w.rank") >= F.col("before")) & (F.col("w.rank") < F.col("before") + F.col("size")))
    targets = targets.select(*keys, "part", "w.*", (F.col("w.rank") - F.col("before")).alias("local"))
    looked = targets.select(*keys, "part").distinct()
    again = ranged.alias("r").join(looked.alias("t"), _same("r", "t", keys) & (F.col("r.part") == F.col("t.part")), "left_semi")
    inside = Window.partitionBy(*keys, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    summed = again.withColumn("upto", F.sum("c").over(inside))
    hit = _same("s", "t", keys) & (F.col("s.part") == F.col("t.part")) & (F.col("t.local") >= F.col("s.upto") - F.col("s.c")) & (F.col("t.local") < F.col("s.upto"))
    found = summed.alias("s").join(targets.alias("t"), hit).select(*[F.col(f"t.{k}") for k in keys], "t.name", "t.high", "s.v")
    numbers = sizes.groupBy(*keys).agg(F.max("n").alias("n"))
    ends = found.groupBy(*keys).agg(*[F.max(F.when((F.col("name") == name) & (F.col("high") == high), F.col("v"))).alias(f"{name}_{int(high)}") for name in probabilities for high in (False, True)])
    met = ends.alias("e").join(numbers.alias("m"), _same("e", "m", keys)).select("e.*", "m.n")

    def between(name: str, p: float) -> Column:
        low, high = F.col(f"{name}_0"), F.col(f"{name}_1")
        return F.when(low == high, low).otherwise((F.floor(at(p)) + 1 - at(p)) * low + (at(p) - F.floor(at(p))) * high).alias(name)

    values = [between(name, p) for name, p in probabilities.items()]
    return met.select(*[F.col(k).alias(c) for c, k in zip(names, keys)], *values)


def larger(rows: DataFrame, keys: list[str], value: str, limit: int) -> DataFrame:
    """keys of the groups with more than limit values; one row for each limit rows at most."""
    return rows.groupBy(*keys).agg(F.count(value).alias("_values")).where(F.col("_values") > limit).select(*keys)


def quantiles(rows: DataFrame, keys: list[str], value: str, probabilities: Mapping[str, float], *others: Column, limit: int | None = LIMIT) -> DataFrame:
    """keys, the other aggregates and a column for each named probability (null for groups without values); equal on both ways.

    Which groups are larger than limit is told by a count that is aggregated before it is shuffled; limit None says that none is.
    """
    builtin = [F.percentile(value, p).alias(name) for name, p in probabilities.items()]
    large = None if limit is None else larger(rows, keys, value, limit)
    if large is None or large.isEmpty():
        return rows.groupBy(*keys).agg(*others, *builtin)
    on = _same("r", "g", keys)
    small = rows.alias("r").join(large.alias("g"), on, "left_anti").groupBy(*keys).agg(*others, *builtin)
    hot = rows.alias("r").join(large.alias("g"), on, "left_semi")
    counted = hot.groupBy(*keys).agg(*others, F.lit(1).alias("_"))
    ranks = ranged_quantiles(hot, keys, value, probabilities)
    met = counted.alias("a").join(ranks.alias("b"), _same("a", "b", keys)).select("a.*", *[F.col(f"b.{name}") for name in probabilities])
    return small.unionByName(met.drop("_"))
