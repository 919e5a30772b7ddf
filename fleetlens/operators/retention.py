"""Which backup files to drop."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.ordered import first_in_group

# Files kept per directory, and the age limit in whole days.
KEEP_FILES = 12
MAX_AGE_DAYS = 15
DAY_SECONDS = 86400


def retention_plan(
    files: DataFrame,
    now: datetime | str,
    keep_n: int = KEEP_FILES,
    max_age_days: int = MAX_AGE_DAYS,
    group: Sequence[str] = ("host", "dir"),
    name: str = "file",
) -> DataFrame:
    """Add ``rotated`` (not among the newest ``keep_n`` of its directory), ``expired``, ``action``.

    Ties on the time go by name. Only the newest ``keep_n`` rows per directory are ranked; the rest
    are the files not found among them, joined by their unique identity.
    """
    identity = [*group, name]
    newest = first_in_group(
        files.select(*identity, "mtime"),
        group,
        [F.col("mtime").desc(), F.col(name).asc()],
        keep_n,
        F.xxhash64(*identity),
    ).select(*identity, F.lit(True).alias("_newest"))
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("mtime").cast("timestamp"))
    days = F.call_function("div", age, F.lit(DAY_SECONDS).cast("bigint"))
    rotated = F.col("_newest").isNull()
    expired = days > max_age_days
    return files.join(newest, identity, "left").select(
        *files.columns,
        rotated.alias("rotated"),
        expired.alias("expired"),
        F.when(rotated | expired, "delete").otherwise("keep").alias("action"),
    )
