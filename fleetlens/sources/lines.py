"""Lines of text files, in batch and as a stream of rolled files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRAILING = "\r\n"


def _as_lines(text: DataFrame) -> DataFrame:
    """Order and size columns come straight from the scan, before any shuffle.

    ``seq`` rises within a scan task, and a task reads a block of a file from front to back, so
    ``(file_path, block_start, seq)`` is the order of lines. ``n_bytes`` counts the newline and any
    carriage return, which are then stripped from ``value``.
    """
    return text.select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("_metadata.file_size").alias("file_size"),
        (F.octet_length("value") + 1).cast("bigint").alias("n_bytes"),
        F.rtrim("value", F.lit(TRAILING)).alias("value"),
    )


def read_lines(spark: SparkSession, paths: str | Sequence[str], **options: str) -> DataFrame:
    """``(file_path, block_start, seq, file_size, n_bytes, value)`` of newline-delimited files."""
    reader = spark.read.option("lineSep", "\n").options(**options)
    return _as_lines(reader.text(paths if isinstance(paths, str) else list(paths)))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Append the number of each row within its task."""
    count = 0
    for batch in batches:
        numbers = pa.array(range(count, count + batch.num_rows), pa.int64())
        count += batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, numbers], names=[*batch.schema.names, "seq"])


def stream_lines(
    spark: SparkSession,
    path: str,
    max_bytes_per_trigger: int | None = 2**30,
    ordered: bool = False,
    **options: str,
) -> DataFrame:
    """Lines of files as they appear in a folder. Each file must be complete when it appears.

    ``max_bytes_per_trigger`` bounds a micro-batch, and with it the rows of one key that a stateful
    operator holds at once; streams that work row by row can take far larger ones. A file is never
    split over two batches.

    With ``ordered`` rows carry ``seq``, as operators on the order of lines need it. Streams have no
    row numbers of their own, so the rows pass through an Arrow function right after the scan.
    """
    reader = spark.readStream.format("text").option("lineSep", "\n").options(**options)
    if max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", str(max_bytes_per_trigger))
    lines = reader.load(path).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        (F.octet_length("value") + 1).cast("bigint").alias("n_bytes"),
        F.rtrim("value", F.lit(TRAILING)).alias("value"),
    )
    if not ordered:
        return lines
    return lines.mapInArrow(_numbered, "file_path string, block_start bigint, n_bytes bigint, value string, seq bigint")
