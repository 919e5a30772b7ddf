"""Places of rows in ordered groups, where one group may hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.session import stored


def sorted_rows(rows: DataFrame, group: str, order: Sequence[Column], keep: Sequence[str], name: str) -> DataFrame:
    """The rows with ``_part`` and ``_at``: their task and place in one sort over group and order.

    The sort is by ranges, so the rows of a large group are spread over many tasks. The result is
    stored, so places stay as they are when a task runs again. ``group`` is never null.
    """
    ordered = rows.orderBy(F.col(group), *order)
    marked = ordered.select(group, *keep, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    return stored(marked, name)


def group_spans(marked: DataFrame, group: str) -> DataFrame:
    """Per group and task: the group's rows in earlier tasks (``_before``), the first of this task, and all (``n``).

    A group has a row per task at most here, whatever its number of rows.
    """
    parts = marked.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(
        group,
        "_part",
        "_first",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0).cast("bigint")).alias("_before"),
        F.sum("_rows").over(whole).alias("n"),
    )


def placed(marked: DataFrame, spans: DataFrame, group: str) -> DataFrame:
    """Add ``pos``, the place from 0 in the group, and what ``spans`` knows about the group.

    The join is by group and task, so facts joined to ``spans`` before reach the rows of a large
    group in as many tasks as it was sorted in.
    """
    place = F.col("_at") - F.col("_first") + F.col("_before")
    return marked.join(spans, [group, "_part"]).withColumn("pos", place).drop("_part", "_at", "_first", "_before")


def numbered(rows: DataFrame, group: str, order: Sequence[Column], keep: Sequence[str], name: str) -> DataFrame:
    """``group``, ``keep``, the place ``pos`` from 0 and the number ``n`` of rows of the group."""
    marked = sorted_rows(rows, group, order, keep, name)
    return placed(marked, group_spans(marked, group), group)
