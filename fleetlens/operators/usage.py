"""Bytes per directory. Sums of file lengths, not of disk blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Top-level directories that hold no files of their own.
VIRTUAL_DIRS = ("proc", "dev", "sys")
TOTAL = "."


def dir_usage(files: DataFrame, depth: int = 1) -> DataFrame:
    """``(root, dir, bytes)`` of the directories ``depth`` levels down and of each root, as ``.``.

    Files above that level count for the root only.
    """
    names = F.split("subpath", "/")
    folder = F.when(F.size(names) > depth, F.concat_ws("/", F.slice(names, 1, depth)))
    per_dir = files.groupBy("root", folder.alias("dir")).agg(F.sum("size").alias("bytes"))
    return (
        per_dir.rollup("root", "dir")
        .agg(F.sum("bytes").alias("bytes"), F.grouping_id().alias("_level"))
        .where(((F.col("_level") == 0) & F.col("dir").isNotNull()) | (F.col("_level") == 1))
        .select("root", F.when(F.col("_level") == 1, TOTAL).otherwise(F.col("dir")).alias("dir"), "bytes")
    )


def root_usage(files: DataFrame, exclude: Sequence[str] = VIRTUAL_DIRS) -> DataFrame:
    """``(root, entry, bytes)`` of each top-level directory or file that is not excluded."""
    entry = F.substring_index("subpath", "/", 1)
    return (
        files.where(~entry.isin(*exclude))
        .groupBy("root", entry.alias("entry"))
        .agg(F.sum("size").alias("bytes"))
    )


def ascending(usage: DataFrame) -> DataFrame:
    return usage.orderBy("bytes")
