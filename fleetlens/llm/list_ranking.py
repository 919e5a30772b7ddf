"""Ranks in a linked list, by contraction over DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.session import stored

FINISH = 1 << 16


def _coin(element: str, round_: int) -> Column:
    return F.xxhash64(F.lit(round_), F.col(element))


def _leaves_list(round_: int) -> Column:
    """Whether an element goes in this round: its hash is below both neighbours'. So no two neighbours go."""
    own = _coin("id", round_)
    # Coins of equal value are told apart by the element.
    lower = [F.struct(own, "id") < F.struct(_coin(other, round_), F.col(other)) for other in ("prev", "next")]
    return F.col("prev").isNotNull() & F.col("next").isNotNull() & lower[0] & lower[1]


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = pd.concat(batches) if (batches := list(batches)) else pd.DataFrame()
    if not len(rows):
        return
    ids = rows["id"].to_numpy()
    order = np.argsort(ids)
    ids = ids[order]
    follower = rows["next"].fillna(-1).to_numpy(dtype=np.int64)[order]
    step = rows["step"].to_numpy()[order]
    place = np.searchsorted(ids, follower)
    at = int(np.flatnonzero(rows["prev"].isna().to_numpy()[order])[0])
    rank, position = np.empty(len(ids), dtype=np.int64), 0
    for _ in range(len(ids)):
        rank[at] = position
        position += int(step[at])
        at = int(place[at]) if follower[at] >= 0 else -1
    yield pd.DataFrame({"id": ids, "rank": rank})


def list_ranks(links: DataFrame, name: str, finish: int = FINISH) -> DataFrame:
    """``id`` and ``rank`` (from 0) of each element of one linked list of (``id``, ``next``), long ids, null at the end.

    Each round takes out all elements whose hash is below both neighbours', a third of them, so no two neighbours
    go; each leaves its distance to the one before it, all by one grouping of the list and the messages
    to neighbours. A list of ``finish`` elements at most is walked in one task. Then the elements
    that went come back round by round: a rank is that of the next element then, less the distance
    to it. The work is in proportion to the list, in ``log1.5(length / finish)`` rounds, each stored.
    An empty list has no ranks.
    """
    ahead = links.select("id", "next", F.lit(None).cast("bigint").alias("prev"))
    behind = links.filter("next IS NOT NULL").select(F.col("next").alias("id"), F.lit(None).cast("bigint").alias("next"), F.col("id").alias("prev"))
    both = ahead.unionByName(behind).groupBy("id").agg(F.max("next").alias("next"), F.max("prev").alias("prev"))
    current = stored(both.withColumn("step", F.lit(1).cast("bigint")), f"{name}-list")
    removed: list[DataFrame] = []
    while current.count() > finish:
        goes = _leaves_list(len(removed))
        gone = current.filter(goes)
        nothing = F.lit(None).cast("bigint")
        kept = current.filter(~goes).select(
            "id", "next", "prev", "step", nothing.alias("new_next"), nothing.alias("new_prev"), nothing.alias("more")
        )
        to_prev = gone.select(
            F.col("prev").alias("id"), nothing.alias("next"), nothing.alias("prev"), nothing.alias("step"),
            F.col("next").alias("new_next"), nothing.alias("new_prev"), F.col("step").alias("more"),
        )
        to_next = gone.select(
            F.col("next").alias("id"), nothing.alias("next"), nothing.alias("prev"), nothing.alias("step"),
            nothing.alias("new_next"), F.col("prev").alias("new_prev"), nothing.alias("more"),
        )
        told = kept.unionByName(to_prev).unionByName(to_next).groupBy("id").agg(
            *[F.max(c).alias(c) for c in ("next", "prev", "step", "new_next", "new_prev", "more")]
        )
        shorter = told.select(
            "id",
            F.coalesce("new_next", "next").alias("next"),
            F.coalesce("new_prev", "prev").alias("prev"),
            (F.col("step") + F.coalesce("more", F.lit(0))).alias("step"),
        )
        removed.append(gone)
        current = stored(shorter, f"{name}-round")
    ranks = stored(current.repartition(1).mapInPandas(_walk, "id long, rank long"), f"{name}-ranks")
    for gone in reversed(removed):
        known = ranks.select(F.col("id").alias("next"), F.col("rank").alias("after"))
        back = stored(gone.join(known, "next").select("id", (F.col("after") - F.col("step")).alias("rank")), f"{name}-back")
        ranks = ranks.unionByName(back)
    return ranks
