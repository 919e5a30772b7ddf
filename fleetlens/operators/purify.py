"""Repeated and over-long lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.lines import KEY

# The longest line kept, in bytes, and the marks of a line.
MAX_LINE_BYTES = 3000
KEPT, DUPLICATE, TOO_LONG = "---", "DUP", "TLL"


def _short(max_bytes: int) -> Column:
    return F.octet_length("value") <= max_bytes


def drop_long(lines: DataFrame, max_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    return lines.where(_short(max_bytes))


def first_keys(lines: DataFrame, max_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    """The keys of the first occurrence of each distinct line that is not too long.

    Partial aggregation keeps one key per distinct line and task, so a line that makes up much of
    the input is no hot key. Lines are told apart by their SHA-256, so no text is sorted or moved.
    """
    digest = F.unhex(F.sha2("value", 256)).alias("digest")
    first = F.min(F.struct(*KEY)).alias("key")
    return drop_long(lines, max_bytes).groupBy(digest).agg(first).select("key.*")


def purify(lines: DataFrame, max_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    """Add ``status``: the first occurrence is kept, later ones and over-long lines are marked.

    Rows find out whether they are a first occurrence by their unique key, not by the text, so the
    join has no hot key either.
    """
    firsts = first_keys(lines, max_bytes).withColumn("_first", F.lit(True))
    status = (
        F.when(~_short(max_bytes), TOO_LONG).when(F.col("_first"), KEPT).otherwise(DUPLICATE)
    )
    return lines.join(firsts, KEY, "left").select(*lines.columns, status.alias("status"))


def purified(lines: DataFrame, max_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    """Only the lines kept. Needs one shuffle on the text and none of the whole input."""
    first = F.min(F.struct(*KEY)).alias("key")
    return drop_long(lines, max_bytes).groupBy("value").agg(first).select("key.*", "value")


def purify_stats(lines: DataFrame, max_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    """Lines processed, duplicates, over-long, and preserved, as one row.

    Lines are counted per distinct text first, so no task sees all texts.
    """
    per_text = (
        lines.select(F.when(_short(max_bytes), F.col("value")).alias("value"))
        .groupBy("value")
        .agg(F.count("*").alias("n"))
    )
    short = F.col("value").isNotNull()
    return per_text.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("processed"),
        F.coalesce(F.sum(F.when(short, F.col("n") - 1)), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum(F.when(~short, F.col("n"))), F.lit(0)).alias("long"),
        F.count_if(short).alias("preserved"),
    )
