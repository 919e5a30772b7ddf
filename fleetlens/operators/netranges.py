"""Prioritised networks as disjoint ranges of addresses.

An address is a key of fixed width, ``4`` or ``6`` and hexadecimal digits, so texts compare as addresses do.
Networks nest or are apart. Swept in order of their first address, with those open on a stack,
they become ranges that each have one label, the one of the best priority. An address then has one range.

The ranges are cut into parts of a few networks at splitters, first addresses of networks. A row finds its
part by its key, and its range by one join on the part with a range test.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.addresses import bound
from fleetlens.session import stored

PART_NETS = 16  # networks in a part
PARTS = 65_536  # parts in all; beyond PARTS * PART_NETS networks, parts grow
COMPARED = 16  # up to this many splitters are compared one by one, more are searched
RANGE_SCHEMA = "part int, start string, until string, label string"

Range = tuple[str, str, str]


def address_key(bits: Column) -> Column:
    """The key of 32 or 128 binary digits; null for null."""

    def hexed(at: int, digits: int) -> Column:
        return F.lpad(F.conv(F.substring(bits, at, digits * 4), 2, 16), digits, "0")

    return F.when(F.length(bits) == 32, F.concat(F.lit("4"), hexed(1, 8))).when(
        F.length(bits) == 128, F.concat(F.lit("6"), hexed(1, 16), hexed(65, 16))
    )


def with_bounds(nets: DataFrame) -> DataFrame:
    """Add ``low`` and ``high``, the keys of a network's first and last address."""
    width = F.when(F.col("family") == "v4", 32).otherwise(128)
    return nets.select(
        "*", *[bound(F.rpad("bits", width, digit), address_key).alias(name) for name, digit in (("low", "0"), ("high", "1"))]
    )


def key_after(key: str) -> str:
    """The next key; after the last one of a family, a text above all of its keys."""
    value, digits = int(key[1:], 16) + 1, len(key) - 1
    return f"{key[0]}{value:0{digits}X}" if value < 16**digits else chr(ord(key[0]) + 1)


def swept(
    nets: Iterable[tuple[str, str, int, str]], open_: Iterable[tuple[str, int, str]], begin: str, end: str | None
) -> list[Range]:
    """Disjoint ranges (first key, key after the last, label) from ``begin`` up to ``end``.

    ``nets`` are (first key, last key, priority, label) in order of first key, larger networks first; ``open_``
    are those (last key, priority, label) that began before ``begin``, larger first.
    """
    found: list[Range] = []
    stack: list[tuple[str, tuple[int, str]]] = []

    def push(high: str, priority: int, label: str) -> None:
        best = (priority, label)
        stack.append((high, min(best, stack[-1][1]) if stack else best))

    def emit(start: str, until: str) -> None:
        if start >= until:
            return
        label = stack[-1][1][1]
        if found and found[-1][1] == start and found[-1][2] == label:
            found[-1] = (found[-1][0], until, label)
        else:
            found.append((start, until, label))

    for high, priority, label in open_:
        push(high, priority, label)
    at = begin
    for low, high, priority, label in nets:
        while stack and stack[-1][0] < low:
            after = key_after(stack[-1][0])
            emit(at, after)
            at = max(at, after)
            stack.pop()
        if stack:
            emit(at, low)
        at = low
        push(high, priority, label)
    while stack:
        after = key_after(stack[-1][0])
        after = after if end is None else min(after, end)
        emit(at, after)
        at = max(at, after)
        stack.pop()
    return found


def local_ranges(nets: Sequence[tuple[str, str, int, str]]) -> tuple[list[str], list[tuple[int, str, str, str]]]:
    """Splitters, and ranges with their part, of networks held here, in any order."""
    ordered = sorted(nets, key=lambda n: (n[0], -int(n[1][1:], 16)))
    splitters = sorted({n[0] for n in ordered[::PART_NETS]})
    rows = []
    for start, until, label in swept(ordered, [], ordered[0][0] if ordered else "", None):
        part = bisect_right(splitters, start) - 1
        while part + 1 < len(splitters) and splitters[part + 1] < until:  # goes on in the next part
            rows.append((part, start, splitters[part + 1], label))
            part, start = part + 1, splitters[part + 1]
        rows.append((part, start, until, label))
    return splitters, rows


def part_of(df: DataFrame, key: Column, splitters: Sequence[str]) -> Column:
    """The number of the part a key is in; null for null, and -1 before the first."""
    if len(splitters) <= COMPARED:
        total = F.lit(-1)
        for splitter in splitters:
            total = total + (key >= splitter).cast("int")
        return total
    held = df.sparkSession.sparkContext.broadcast(np.array(splitters, dtype="S33"))

    @F.pandas_udf("int")
    def searched(keys: pd.Series) -> pd.Series:
        wanted = keys.fillna("").to_numpy(dtype="S33")
        parts = np.searchsorted(held.value, wanted, side="right") - 1
        return pd.Series(parts, dtype="Int32").mask(keys.isna().to_numpy())

    return searched(key)


def flat_ranges(nets: DataFrame) -> tuple[list[str], DataFrame]:
    """Splitters, and ranges with their part, of a stored table of networks of any size.

    The networks are sorted once. A part is swept by itself: what is open where it begins are the
    networks whose digits begin the splitter, found by one join for all splitters. A part has ``PART_NETS`` networks, or
    one in ``PARTS`` of all, and those that begin at one address stay together, 129 at most.
    """
    total = nets.count()
    step = max(PART_NETS, -(-total // PARTS))
    ordered = with_bounds(nets).orderBy("low", "prefix_len")
    marked = stored(
        ordered.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "network-order"
    )
    inside = F.col("_at").bitwiseAND(F.lit(2**33 - 1))  # places within a task
    first = marked.groupBy("_part", F.floor(inside / step)).agg(F.min("low").alias("low"))
    splitters = sorted(r["low"] for r in first.select("low").distinct().collect())
    own = marked.withColumn("part", part_of(marked, F.col("low"), splitters)).select(
        "part", "low", "high", "priority", "label", "prefix_len"
    )
    spark = nets.sparkSession
    points = spark.createDataFrame(list(enumerate(splitters)), "part int, begin string")
    digits = F.substring("begin", 2, 32)
    bits = F.when(
        F.length(digits) == 8, F.lpad(F.conv(digits, 16, 2), 32, "0")
    ).otherwise(
        F.concat(F.lpad(F.conv(F.substring(digits, 1, 16), 16, 2), 64, "0"), F.lpad(F.conv(F.substring(digits, 17, 16), 16, 2), 64, "0"))
    )
    lengths = nets.groupBy("family").agg(F.collect_set("prefix_len").alias("lengths"))  # two rows
    probes = (
        points.withColumn("digits", bits)
        .withColumn("family", F.when(F.col("begin").startswith("4"), "v4").otherwise("v6"))
        .join(F.broadcast(lengths), "family")
        .withColumn("prefix_len", F.explode("lengths"))
        .select("part", "begin", "family", "prefix_len", F.expr("substring(digits, 1, prefix_len)").alias("bits"))
    )
    opened = marked.join(probes, ["family", "prefix_len", "bits"]).filter("low < begin")
    opened = opened.select("part", F.lit(None).cast("string").alias("low"), "high", "priority", "label", "prefix_len")
    limits = spark.sparkContext.broadcast(splitters)

    def sweep(rows: pd.DataFrame) -> pd.DataFrame:
        part = int(rows["part"].iloc[0])
        rows = rows.sort_values(["low", "prefix_len"], na_position="first")
        before = rows[rows["low"].isna()].sort_values("prefix_len")
        nets_ = rows[rows["low"].notna()]
        end = limits.value[part + 1] if part + 1 < len(limits.value) else None
        found = swept(
            nets_[["low", "high", "priority", "label"]].itertuples(index=False),
            before[["high", "priority", "label"]].itertuples(index=False),
            limits.value[part],
            end,
        )
        return pd.DataFrame([(part, *r) for r in found], columns=["part", "start", "until", "label"])

    ranges = own.unionByName(opened).groupBy("part").applyInPandas(sweep, RANGE_SCHEMA)
    return splitters, stored(ranges, "network-ranges")
