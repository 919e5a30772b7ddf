"""Contiguous shards of whole groups, with the smallest possible largest shard."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable
from itertools import accumulate
from math import isqrt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.session import stored

FETCH_AT_ONCE = 256


class Cuts:
    """Smallest feasible capacity over ordered group sizes of which only blocks are at hand.

    ``totals`` are the bytes of consecutive blocks of groups; ``fetch`` gets the sizes of the groups
    of some blocks. A capacity is tried by filling shard after shard greedily; a cut falls inside one
    block, so a trial needs the sizes of as many blocks as there are shards, at most.
    """

    def __init__(self, totals: list[int], largest: int, shards: int, fetch: Callable[[set[int]], dict[int, list[int]]]):
        self.ends = list(accumulate(totals, initial=0))
        self.total, self.shards, self.fetch = self.ends[-1], shards, fetch
        self.largest = largest
        self.low = max(-(-self.total // shards), largest)
        self.groups: dict[int, list[int]] = {}

    def block_at(self, reach: int) -> int:
        """The block that holds the last group ending at or before ``reach``, or the one cut by it."""
        return min(bisect_right(self.ends, reach), len(self.ends) - 1) - 1

    def need(self, blocks: Iterable[int]) -> None:
        missing = set(blocks) - self.groups.keys()
        if missing:
            for block, sizes in self.fetch(missing).items():
                self.groups[block] = list(accumulate(sizes, initial=self.ends[block]))

    def walk(self, capacity: int, by_block: bool = False, alone: bool = False) -> list[int]:
        """Where greedy filling cuts; the last number is the total if the capacity suffices.

        ``by_block`` cuts before the block instead of inside it, which needs no sizes and never
        reaches further than the real walk. With ``alone`` a group larger than the capacity is a shard.
        """
        cuts, at = [], 0
        if not by_block:
            blocks = self.possible(capacity, capacity)
            if len(blocks) <= FETCH_AT_ONCE:
                self.need(blocks)
        for _ in range(self.shards):
            reach = at + capacity
            if reach >= self.total:
                at = self.total
            elif by_block:
                at = max(at, self.ends[self.block_at(reach)])
            else:
                cut = self.end_before(reach)
                at = cut if cut > at else self.end_after(at) if alone else at
            cuts.append(at)
        return cuts

    def end_before(self, reach: int) -> int:
        """The last end of a group at or before ``reach``."""
        block = self.block_at(reach)
        self.need([block])
        ends = self.groups[block]
        return ends[bisect_right(ends, reach) - 1]

    def end_after(self, at: int) -> int:
        """The first end of a group after ``at``, which is one itself."""
        block = self.block_at(at)
        self.need([block])
        return self.groups[block][bisect_right(self.groups[block], at)]

    def level(self, high: int) -> list[int]:
        """Cuts by the smallest capacity that suffices if a group that exceeds it has a shard of its own."""
        low = 1
        while low < high:
            middle = (low + high) // 2
            if self.walk(middle, alone=True)[-1] < self.total:
                low = middle + 1
            else:
                high = middle
        return self.walk(low, alone=True)

    def possible(self, low: int, high: int) -> set[int]:
        """Blocks in which a cut can fall for some capacity from ``low`` to ``high``."""
        found: set[int] = set()
        for i, at in enumerate(self.walk(low, by_block=True), 1):
            first, last = self.block_at(at), self.block_at(min(i * high, self.total))
            found.update(range(max(first, 0), last + 1))
            if len(found) > FETCH_AT_ONCE:
                break
        return found

    def solve(self) -> list[int]:
        if not self.total:
            return [0] * self.shards
        low, high = self.low, self.low
        while self.walk(high, by_block=True)[-1] < self.total:
            high = min(high * 2, self.total)
        tight = high
        floor = low
        while floor < tight:  # the smallest capacity that suffices even with cuts before blocks
            middle = (floor + tight) // 2
            if self.walk(middle, by_block=True)[-1] < self.total:
                floor = middle + 1
            else:
                tight = middle
        high = tight
        if self.walk(low)[-1] == self.total:
            # Where one group is the largest shard, filling the others as far would leave the last ones empty.
            return self.level(low) if low == self.largest else self.walk(low)
        while low < high:
            blocks = self.possible(low, high)
            if len(blocks) <= FETCH_AT_ONCE:  # all that is left to try needs these sizes at most
                self.need(blocks)
            middle = (low + high) // 2
            if self.walk(middle)[-1] < self.total:
                low = middle + 1
            else:
                high = middle
        return self.walk(low)


def _lookup(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def contiguous_shards(
    docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Put all rows into ``shards`` shards; equal texts stay together and the largest shard is as small as can be.

    One row per input row: the id, ``size`` (UTF-8 bytes of the text plus 1), ``text_crc32``,
    ``shard`` and ``slot``, which counts from 0 without gaps in each shard. Groups of equal texts are
    ordered by their smallest id and cut into contiguous shards; no other way to cut that order
    has a smaller largest shard. Where a single group is that shard, the next smaller capacity that
    suffices for the other shards is taken for them. With few groups the last shards may be empty.

    Texts are compared by their SHA-256. Group sizes are numbered in range partitions; the driver
    holds one total per block of about the square root of all groups, and reads the sizes of those
    blocks only in which a cut can fall. Neither the groups nor the rows of a group meet in one
    task: rows are put in order by a range over group and id.

    A null text counts as empty, with the size 1. Null ids come first. Repeated rows have a slot
    each. An empty table gives an empty result. Other columns are not read and may have any name.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("crc"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
        ),
        "shard-rows",
    )
    ranged = (
        rows.groupBy("digest")
        .agg(F.sum("size").alias("bytes"), F.min("id").alias("first"))
        .repartitionByRange(parts, "first", "digest")
        .withColumn("part", F.spark_partition_id())
    )
    inside = Window.partitionBy("part").orderBy("first", "digest")
    groups = stored(
        ranged.select(
            "*",
            F.row_number().over(inside).alias("place"),
            F.sum("bytes").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        ),
        "shard-groups",
    )
    step = max(1024, isqrt(groups.count()))
    blocked = groups.withColumn("block", F.floor((F.col("place") - 1) / step))
    totals = (
        blocked.groupBy("part", "block")
        .agg(F.sum("bytes").alias("bytes"), F.max("bytes").alias("largest"))
        .orderBy("part", "block")
        .collect()
    )

    def fetch(numbers: set[int]) -> dict[int, list[int]]:
        wanted = _lookup(
            spark, [(n, totals[n].part, totals[n].block) for n in numbers], "number int, part int, block long"
        )
        found: dict[int, list[int]] = {n: [] for n in numbers}
        sizes = blocked.join(F.broadcast(wanted), ["part", "block"]).select("number", "place", "bytes")
        for row in sorted(sizes.collect()):
            found[row.number].append(row.bytes)
        return found

    cuts = Cuts([t.bytes for t in totals], max((t.largest for t in totals), default=0), shards, fetch).solve()

    before: dict[int, int] = {}
    at = 0
    for t in totals:
        before.setdefault(t.part, at)
        at += t.bytes
    offsets = _lookup(spark, list(before.items()), "part int, before long")  # a row per range partition
    end = F.col("before") + F.col("upto")
    shard = sum(((end > F.lit(cut)).cast("int") for cut in cuts[:-1]), F.lit(0))
    placed = groups.join(F.broadcast(offsets), "part").select("digest", "first", shard.alias("shard"))
    sorted_rows = (
        rows.join(placed, "digest")
        .repartitionByRange(parts, "shard", "first", "digest", "id")
        .withColumn("part", F.spark_partition_id())
    )
    local = Window.partitionBy("part", "shard").orderBy("first", "digest", "id")
    numbered = stored(sorted_rows.withColumn("place", F.row_number().over(local)), "shard-places")
    counts = numbered.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))  # shards + parts rows at most
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return numbered.join(F.broadcast(counts), ["shard", "part"]).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        "shard",
        (F.col("before") + F.col("place") - 1).alias("slot"),
    )
