"""Section marks across the micro-batches of a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators.lines import BLOCK, KEY, SEQ
from fleetlens.operators.ordered import previous_value
from fleetlens.session import shared_folder


KEPT_BATCHES = 2


def forget(spark: SparkSession, folder: str, batch_id: int) -> None:
    """Delete the state of a batch that can no longer be repeated."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/after={batch_id}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _state_of(spark: SparkSession, folder: str, batch_id: int) -> DataFrame | None:
    """The state that the batches before ``batch_id`` left; a repeated batch starts from the same."""
    path = f"{folder}/after={batch_id - 1}"
    if batch_id == 0:
        return None
    return spark.read.schema("log string, day bigint, seen timestamp").parquet(path)


def section_marker(
    sink: Callable[[DataFrame, int], None],
    name: str,
    log: str = "file_path",
    date: str = "date",
    folder: str | None = None,
    forget_after: str = "30 days",
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that adds ``new_section`` and hands each batch to ``sink``.

    ``log`` is the column that names a log; it may span several files, whose names give their order.
    The last date of each log is one small row, written per batch below the shared folder, so a
    repeated batch reads the same state again. The state of the last two batches is kept, and a log
    without rows for ``forget_after`` is left out of it. A third argument of the function gives rows of the same
    places and dates that are cached, and the batch, which then is read by ``sink`` alone, is not.
    """

    def run(batch: DataFrame, batch_id: int, summary: DataFrame | None = None) -> None:
        spark = batch.sparkSession
        state_folder = folder or f"{shared_folder(spark)}/sections/{name}"
        rows = batch.withColumn("_log", F.col(log))
        # Read three times below; losing an executor only computes its part of the batch again.
        facts = rows.persist() if summary is None else summary.withColumn("_log", F.col(log))
        block = [c for c in (*KEY[:1], *BLOCK) if c != log]
        before = _state_of(spark, state_folder, batch_id)
        initial = None if before is None else before.select(F.col("log").alias("_log"), F.col("day").alias("v"))
        day = F.xxhash64(date)  # only whether it changes counts
        marked = previous_value(rows, ["_log"], block, SEQ, day, "_previous", initial, facts)
        changed = F.col("_previous").isNull() | (F.col("_previous") != day)
        sink(marked.select(*batch.columns, changed.alias("new_section")), batch_id)
        order = F.struct(*block, SEQ)
        last = facts.groupBy(F.col("_log").alias("log")).agg(F.max_by(day, order).alias("day"))
        last = last.withColumn("seen", F.current_timestamp())
        if before is not None:
            fresh = before.where(F.col("seen") >= F.current_timestamp() - F.expr(f"INTERVAL {forget_after}"))
            last = last.unionByName(fresh.join(last.select("log"), "log", "left_anti"))
        last.write.mode("overwrite").parquet(f"{state_folder}/after={batch_id}")
        forget(spark, state_folder, batch_id - KEPT_BATCHES)
        if summary is None:
            rows.unpersist()

    return run
