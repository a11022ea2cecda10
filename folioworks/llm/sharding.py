"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Rows with equal text are one group and stay together. Groups sorted by size,
largest first, go to the shard with the tightest remaining capacity that takes
them, found in a balanced search tree; the smallest capacity that needs no more
than the wanted number of shards is found by bisection, so shards end up near
equal. With a fixed capacity instead, the packing opens as few shards as it can.

The packing itself sees a bounded number of items at any input size: a group of
at least 1 / `parcels` of all bytes is an item of its own (there are at most
`parcels` of those), all other groups are dealt by hash of their text to
`parcels` parcels, which are items. Everything with one row per document or per
group stays distributed. A group larger than an equal share gets a shard alone.

Defined results: a null text has 0 bytes and crc32 0 and is a group of its own;
rows that repeat are rows like any other; with no rows there are no shards.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioworks.llm.common import cut

OVERHEAD = 8


@dataclass
class Bins:
    """Open bins as (room, bin) in a balanced tree: fixed-size leaves under one sorted index."""

    leaf_size: int = 64
    leaves: list[list[tuple[int, int]]] = field(default_factory=list)

    def add(self, room: int, number: int) -> None:
        entry = (room, number)
        if not self.leaves:
            self.leaves.append([entry])
            return
        i = max(0, bisect.bisect_right(self.leaves, entry, key=lambda leaf: leaf[0]) - 1)
        leaf = self.leaves[i]
        bisect.insort(leaf, entry)
        if len(leaf) > self.leaf_size:
            half = len(leaf) // 2
            self.leaves[i : i + 1] = [leaf[:half], leaf[half:]]

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least room that still takes size."""
        entry = (size, -1)
        i = bisect.bisect_left(self.leaves, entry, key=lambda leaf: leaf[-1])
        if i == len(self.leaves):
            return None
        leaf = self.leaves[i]
        found = leaf.pop(bisect.bisect_left(leaf, entry))
        if not leaf:
            self.leaves.pop(i)
        return found


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin number of each size; sizes over the capacity get a bin alone."""
    bins, placed, opened = Bins(), [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = bins.take_tightest(sizes[i])
        room, number = found or (max(capacity, sizes[i]), opened)
        opened += found is None
        placed[i] = number
        if room > sizes[i]:
            bins.add(room - sizes[i], number)
    return placed


def pack_into(sizes: list[int], shards: int) -> list[int]:
    """Bin number of each size with the smallest capacity for which best-fit-decreasing needs `shards` bins at most."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    placed, alone, total = [0] * len(sizes), 0, sum(sizes)
    # what is over an equal share of the rest cannot be evened out: it takes a shard alone
    while alone < min(shards - 1, len(order)) and sizes[order[alone]] * (shards - alone) > total:
        placed[order[alone]] = alone
        total -= sizes[order[alone]]
        alone += 1
    rest = order[alone:]
    if not rest:
        return placed
    left, of = shards - alone, [sizes[i] for i in rest]
    low = max(-(-total // left), of[0])
    high = total
    best = [0] * len(of)
    while low <= high:
        capacity = (low + high) // 2
        found = best_fit_decreasing(of, capacity)
        if max(found) < left:
            best, high = found, capacity - 1
        else:
            low = capacity + 1
    for i, b in zip(rest, best, strict=True):
        placed[i] = alone + b
    return placed


def byte_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def assign(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    shards: int | None = 24,
    capacity: int | None = None,
    parcels: int = 6144,
) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row; slot counts from 0 in each shard without gaps.

    Give `shards` for near-equal shards of that number, or `capacity` in bytes for as few shards of that size as
    the packing finds (a group or parcel over the capacity fills a shard alone).
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        byte_size(text).alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(text.cast("binary"), 256)), F.lit(b"")).alias("group"),
    )
    rows = cut(rows)  # narrow, and read three times
    groups = cut(rows.groupBy("group").agg(F.sum("size").alias("bytes")))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    parcel = F.pmod(F.xxhash64("group"), F.lit(parcels)).cast("int")
    big = F.col("bytes") * parcels >= total
    items = [(r["group"], None, r["bytes"]) for r in groups.where(big).orderBy("group").collect()]
    dealt = groups.where(~big).groupBy(parcel.alias("parcel")).agg(F.sum("bytes").alias("bytes"))
    items += [(None, r["parcel"], r["bytes"]) for r in dealt.orderBy("parcel").collect()]
    sizes = [int(b) for *_, b in items]
    placed = best_fit_decreasing(sizes, capacity) if capacity else pack_into(sizes, shards)
    at = _table(rows.sparkSession, [(g, p, s) for (g, p, _), s in zip(items, placed, strict=True)])
    # 2 * parcels rows at most
    alone = F.broadcast(at.where("group is not null").select("group", F.col("shard").alias("_alone")))
    dealt = F.broadcast(at.where("parcel is not null").select("parcel", F.col("shard").alias("_dealt")))
    found = rows.join(alone, "group", "left").withColumn("parcel", parcel).join(dealt, "parcel", "left")
    found = found.select("id", "size", "text_crc32", F.coalesce("_alone", "_dealt").alias("shard"))
    return _slots(found).select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")


def _table(spark: SparkSession, rows: list) -> DataFrame:
    return spark.createDataFrame(rows, "group binary, parcel int, shard int")


def _slots(rows: DataFrame) -> DataFrame:
    """Number the rows of each shard from 0.

    The rows come from checkpointed partitions by way of broadcast joins only, so the partition number is the same
    however often a task runs; numbering inside (shard, partition) gives no task more than one partition's rows.
    """
    rows = rows.withColumn("chunk", F.spark_partition_id())
    counts = rows.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "chunk").orderBy("id", "text_crc32", "size")
    numbered = rows.withColumn("rn", F.row_number().over(inside))
    return numbered.join(base, ["shard", "chunk"]).withColumn("slot", F.col("base") + F.col("rn") - 1)
