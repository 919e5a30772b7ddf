"""Network feeds: text and JSON lists, and the cached table of them."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators.network import GROUPS

# The cache version and its lifetime.
CACHE_VERSION = "v1"
CACHE_SECONDS = 86400

_TRIMMED = " \t\n\r\0\x0b"  # fixed value: what is cut off around a network
FEED_JSON = "prefixes array<struct<ipv4Prefix: string, ipv6Prefix: string>>"


def read_cidr_text(spark: SparkSession, path: str, label: str) -> DataFrame:
    """``(cidr, pos, label)`` of a list with one network per line."""
    rows = spark.read.text(path).select(F.btrim("value", F.lit(_TRIMMED)).alias("cidr"), F.monotonically_increasing_id().alias("pos"))
    return rows.where(F.col("cidr") != "").withColumn("label", F.lit(label))


def read_cidr_json(spark: SparkSession, path: str, label: str) -> DataFrame:
    """``(cidr, pos, label)`` of ``{"prefixes": [{"ipv4Prefix" | "ipv6Prefix": …}]}``."""
    feed = spark.read.option("multiLine", "true").schema(FEED_JSON).json(path)
    entries = feed.select(F.explode("prefixes").alias("entry"))
    both = entries.select(F.explode(F.array("entry.*")).alias("cidr"))
    placed = both.withColumn("pos", F.monotonically_increasing_id())  # rises through all files
    return placed.where(F.col("cidr").isNotNull()).select("cidr", "pos", F.lit(label).alias("label"))


def write_cidr_table(feeds: Mapping[str, DataFrame], path: str, now: datetime, ttl: int = CACHE_SECONDS) -> None:
    """Store the feeds by group, with the time until which they may be used."""
    groups = [
        feed.select("cidr", "pos", "label", F.lit(group).alias("net_group")) for group, feed in feeds.items()
    ]
    reduce(DataFrame.unionByName, groups).withColumns(
        {
            "version": F.lit(CACHE_VERSION),
            "expire": F.lit(now + timedelta(seconds=ttl)).cast("timestamp"),
        }
    ).write.mode("overwrite").parquet(path)


def cidr_table(spark: SparkSession, path: str, now: datetime) -> DataFrame:
    """``(cidr, pos, label, net_group)`` still in force at ``now``; empty when all have expired."""
    stored = spark.read.schema(
        "cidr string, pos bigint, label string, net_group string, version string, expire timestamp"
    ).parquet(path)
    valid = (F.col("version") == CACHE_VERSION) & (F.col("expire") > F.lit(now).cast("timestamp"))
    return stored.where(valid).drop("version", "expire")


def feeds_of(cached: DataFrame) -> dict[str, DataFrame]:
    """The cached table as one feed per known remote group."""
    return {g: cached.where(F.col("net_group") == g) for g in GROUPS if g != "local"}
