"""Sharding: best-fit-decreasing packing of indivisible groups of equal texts, in two levels.

Every group is packed by the same rule. Groups are dealt over tasks by hash; each task sorts
its own by size, largest first, and puts each into the tightest remaining capacity of its bins,
which a balanced tree holds. A bin holds a small part of a shard (a group above that is a bin
of its own), so the bins of all tasks are at most some thousands, and those the driver packs
into the shards, by the same rule. Slots are prefix sums: over the bins of a shard on the
driver, over the groups of a bin in its task, over SLICES hash slices of a group, and a rank
inside a slice, so no task holds a shard, a bin or a large group.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm._common import partitions, text_or_empty, written

PARTS = 4096  # bins of the first level for each whole input, at least; with a capacity, 64 for each shard
MOST_PARTS = 1 << 18  # bins of the first level that the driver packs, unless more shards than that are asked for
SLICES = 64


class CapacityTree:
    """A treap of (remaining capacity, bin): the tightest bin that holds a size in O(log n)."""

    def __init__(self):
        self.root = None
        self._state = 0x2545F491

    def _priority(self) -> int:
        self._state = (self._state * 1103515245 + 12345) % 2**31
        return self._state

    def insert(self, key: tuple[int, int]) -> None:
        low, high = self._split(self.root, key)
        self.root = self._join(self._join(low, [key, self._priority(), None, None]), high)

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the smallest (remaining, bin) with remaining >= size."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        node = high
        while node[2] is not None:
            node = node[2]
        _, rest = self._split(high, (node[0][0], node[0][1] + 1))
        self.root = self._join(low, rest)
        return node[0]

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            return [node[0], node[1], node[2], low], high
        low, high = self._split(node[2], key)
        return low, [node[0], node[1], high, node[3]]

    def _join(self, low, high):
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            return [low[0], low[1], low[2], self._join(low[3], high)]
        return [high[0], high[1], self._join(low, high[2]), high[3]]


def best_fit_decreasing(sizes: dict, capacity: int, bins: int | None = None) -> dict | None:
    """item -> bin, each bin of at most capacity; opens as few bins as the rule needs.

    An item above the capacity gets a bin of its own. With bins, None if more would be opened.
    """
    tree, out, opened = CapacityTree(), {}, 0
    for item, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        found = tree.take(size)
        if found is None:
            if bins is not None and opened == bins:
                return None
            found, opened = (max(capacity, size), opened), opened + 1
        tree.insert((found[0] - size, found[1]))
        out[item] = found[1]
    return out


def pack_into(sizes: dict, bins: int, steps: int = 14) -> dict:
    """item -> bin 0..bins-1 at the least capacity that `steps` bisections find at which best fit needs no more bins.

    The mean plus the largest item always suffices: were an item left over, all bins would hold
    more than the mean.
    """
    if not sizes:
        return {}
    mean, largest = -(-sum(sizes.values()) // bins), max(sizes.values())
    low, high = max(mean, largest), mean + largest
    best = None
    for _ in range(steps):
        if low >= high:
            break
        middle = (low + high) // 2
        found = best_fit_decreasing(sizes, middle, bins)
        if found is None:
            low = middle + 1
        else:
            best, high = found, middle
    return best if best is not None else best_fit_decreasing(sizes, high, bins)


_PACKED = "g1 long, g2 long, item long, start long"


def _pack_groups(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    """First level, over the rows (g1, g2, bytes, n) of one task, largest first: their bin and the rows of the bin before them."""
    tree, opened = CapacityTree(), 0
    first = TaskContext.get().partitionId() << 32
    filled: dict[int, int] = {}  # rows in each bin that is still open
    for batch in batches:
        items, starts = [], []
        for size, n in zip(batch["bytes"].to_pylist(), batch["n"].to_pylist(), strict=True):
            found = tree.take(size)
            if found is None:
                found, opened = (max(capacity, size), opened), opened + 1
            left, at = found[0] - size, found[1]
            items.append(first + at)
            starts.append(filled.get(at, 0))
            if left > 0:
                tree.insert((left, at))
                filled[at] = starts[-1] + n
            else:
                filled.pop(at, None)
        yield pa.RecordBatch.from_arrays([batch["g1"], batch["g2"], pa.array(items, pa.int64()), pa.array(starts, pa.int64())], names=["g1", "g2", "item", "start"])


def shard(docs: DataFrame, shards: int | None = 8, capacity: int | None = None) -> DataFrame:
    """docs with size, shard and slot; rows of equal text never part.

    Give shards for that many of nearly equal size, or capacity for shards of at most that many
    bytes, as few as the packing finds (a group above it has a shard of its own). Size is the
    text's UTF-8 bytes plus one; null text has no bytes and goes with empty texts. Slots run
    from 0 without gaps in each shard. Null and repeated doc_id are rows like any other. Extra
    columns stay, but for those named size, shard or slot, which the results replace.
    """
    spark = docs.sparkSession
    base = docs.drop(*[c for c in docs.columns if c in {"size", "shard", "slot"}])
    own = {f"tidemark_{c}": x for c, x in _keys(spark).items()}
    # rows of each slice of each group
    slices = docs.select(*(x.alias(c) for c, x in _keys(spark).items())).groupBy("g1", "g2", "part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    slices = written(slices, "shard-slices")
    total = slices.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    bin_size = max(1, total // PARTS) if capacity is None else min(capacity, max(capacity // 64, total // MOST_PARTS, 1))
    groups = slices.groupBy("g1", "g2").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    dealt = groups.repartition("g1").sortWithinPartitions(F.desc("bytes"), "g1", "g2")
    packed = written(dealt.mapInArrow(lambda x: _pack_groups(x, bin_size), _PACKED).join(groups, ["g1", "g2"]), "shard-groups")
    bins = packed.groupBy("item").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    found = {r["item"]: (r["bytes"], r["n"]) for r in bins.toLocalIterator()}  # two for each full part, one for each task
    sizes = {item: x[0] for item, x in found.items()}
    where = best_fit_decreasing(sizes, capacity) if capacity is not None else pack_into(sizes, shards)
    before: dict[int, int] = {}
    placed = []
    for item in sorted(where):
        placed.append((item, where[item], before.get(where[item], 0)))
        before[where[item]] = placed[-1][2] + found[item][1]
    bins = spark.createDataFrame(placed, "item long, shard int, first long")
    order = Window.partitionBy("g1", "g2").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.withColumn("inside", F.coalesce(F.sum("n").over(order), F.lit(0))).join(packed.drop("n", "bytes"), ["g1", "g2"]).join(F.broadcast(bins), "item")
    starts = starts.select(*(F.col(c).alias(f"tidemark_{c}") for c in ("g1", "g2", "part")), "shard", (F.col("first") + F.col("start") + F.col("inside")).alias("tidemark_start"))
    cell = ["tidemark_g1", "tidemark_g2", "tidemark_part"]
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy("doc_id")) - 1
    return (
        base.select("*", *(x.alias(c) for c, x in own.items()))
        .withColumn("tidemark_rank", rank)
        .join(starts, cell)
        .select(*(F.col(f"`{c}`") for c in base.columns), F.col("tidemark_size").alias("size"), "shard", (F.col("tidemark_start") + F.col("tidemark_rank")).cast("long").alias("slot"))
    )


def _keys(spark) -> dict:
    """g1 and g2 name a group of equal texts, part is a slice of it by doc_id; size."""
    text = text_or_empty()
    return {
        "g1": F.xxhash64(text),
        "g2": F.xxhash64(F.lit(7), text),
        "part": F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(max(SLICES, partitions(spark)))).cast("int"),
        "size": (F.octet_length(text) + F.lit(1)).cast("long"),
    }
