"""The ends of many files, read without their beginnings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.arguments import parse_size_arg
from fleetlens.session import task_count
from fleetlens.sources.lines import TRAILING
from fleetlens.sources.ranges import last_lines_start, lines_between

# A tail is read in pieces of this many bytes, one row each, so no task reads more than a piece.
PIECE = 64 * 1024 * 1024
_BATCH_LINES = 4096
_BATCH_BYTES = 16 * 1024 * 1024
# Names or patterns, which the driver lists, or the ``path`` and ``size`` of a manifest, which can hold very many files.
Paths = str | Sequence[str] | DataFrame
_SCHEMA = "file_path string, block_start bigint, seq bigint, file_size bigint, n_bytes bigint, value string"


def _read_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file_path", "block_start", "seq", "file_size", "n_bytes", "value"]
    rows: list[tuple] = []  # of many small files at once
    held = 0
    for batch in batches:
        for piece in batch.to_pylist():
            for offset, line in lines_between(piece["path"], piece["start"], piece["end"]):
                text = line.decode("utf-8", "replace")
                rows.append((piece["path"], piece["start"], offset, piece["length"], len(line) + 1, text))
                held += len(line)
                if len(rows) == _BATCH_LINES or held > _BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
                    rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)


def _files(spark: SparkSession, paths: Paths) -> DataFrame:
    if isinstance(paths, DataFrame):
        return paths.select("path", F.col("size").alias("length"))
    files = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths))
    return files.select("path", "length")


def _read(spark: SparkSession, starts: DataFrame) -> DataFrame:
    """The lines of files (``path``, ``length``) from ``start`` on, in pieces."""
    pieces = (
        starts.select("path", "length", F.explode(F.sequence("start", F.greatest(F.col("length") - 1, "start"),
                                                             F.lit(PIECE).cast("bigint"))).alias("start"))
        .withColumn("end", F.least(F.col("start") + PIECE, F.col("length")))
        .repartition(task_count(spark), "path", "start")
    )
    return pieces.mapInArrow(_read_pieces, _SCHEMA).withColumn("value", F.rtrim("value", F.lit(TRAILING)))


def read_tail(spark: SparkSession, paths: Paths, amount: int | str) -> DataFrame:
    """The lines that start in the last ``amount`` bytes of each file, as ``read_lines`` rows.

    Same rows as ``tail_bytes(read_lines(...), amount)``, but tasks seek to the tail instead of
    reading the whole file. ``seq`` is the byte offset of the line.
    """
    n = parse_size_arg(amount) if isinstance(amount, str) else amount
    start = F.greatest(F.col("length") - n, F.lit(0).cast("bigint"))
    return _read(spark, _files(spark, paths).where(F.lit(n) > 0).withColumn("start", start))


def read_last_lines(spark: SparkSession, paths: Paths, n: int) -> DataFrame:
    """The last ``n`` lines of each file, as ``read_lines`` rows.

    Same rows as ``tail_lines(read_lines(...), n)``, but tasks look for the line ends from the end of
    each file and read nothing before them.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = [last_lines_start(path, n) for path in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts, pa.int64())], names=["path", "length", "start"])

    files = _files(spark, paths).where((F.lit(n) > 0) & (F.col("length") > 0)).repartition(task_count(spark), "path")
    return _read(spark, files.mapInArrow(find, "path string, length bigint, start bigint"))
