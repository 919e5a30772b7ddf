"""Repeated lines in a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.lines import BLOCK, FILE
from fleetlens.operators.purify import MAX_LINE_BYTES, drop_long


def stream_purify(lines: DataFrame, max_bytes: int = MAX_LINE_BYTES, spread: int = 16) -> DataFrame:
    """Each distinct line once, over the whole stream; over-long lines are dropped.

    Lines are made distinct in ``spread`` parts per text first, parted by the block they come from,
    so a very frequent line does not go through one task. The state holds a 256-bit digest of every
    distinct line, and of a frequent one as many as there are parts and one; see
    :func:`stream_purify_within` for a bounded one. Start the query with
    :func:`~fleetlens.streaming.options.state_on_disk`, so the state is not held on the heap.
    """
    part = F.pmod(F.xxhash64(*FILE, *BLOCK), F.lit(spread))
    short = drop_long(lines, max_bytes).select("value", F.unhex(F.sha2("value", 256)).alias("digest"), part.alias("part"))
    parted = short.dropDuplicates(["digest", "part"])
    return parted.dropDuplicates(["digest"]).select("value")


def stream_purify_within(
    lines: DataFrame, stamp: str, delay: str, max_bytes: int = MAX_LINE_BYTES
) -> DataFrame:
    """Each line once per ``delay`` of event time; older state is dropped."""
    short = drop_long(lines, max_bytes).withWatermark(stamp, delay)
    return short.dropDuplicatesWithinWatermark(["value"])
