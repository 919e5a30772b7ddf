"""Lines: order, byte offsets, tails, routing and section marks.

A line row has ``file_path``, ``block_start`` (first byte of the scan split it was read from),
``seq`` (rising inside a block), ``n_bytes`` (with its newline) and ``value``. ``(file_path,
block_start, seq)`` is the order of lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.arguments import parse_size_arg
from fleetlens.operators.ordered import previous_value, running_total

FILE = ["file_path"]
BLOCK = ["block_start"]
SEQ = "seq"
KEY = [*FILE, *BLOCK, SEQ]

# Assumed bytes per line when a number of lines is only estimated, and the defaults.
ACCESS_LINE_BYTES = 305
ERROR_LINE_BYTES = 195
DEFAULT_TAIL_LINES = 5
DEFAULT_MAIL_TAIL_BYTES = 32768


def with_offsets(lines: DataFrame, out: str = "offset") -> DataFrame:
    """Byte offset of the start of each line in its file."""
    return running_total(lines, FILE, BLOCK, SEQ, F.col("n_bytes"), out)


def tail_start(lines: DataFrame) -> DataFrame:
    """The whole file."""
    return lines


def tail_bytes(lines: DataFrame, amount: int | str) -> DataFrame:
    """Lines that start in the last ``amount`` bytes of their file.

    Only blocks that reach into the tail take part in the window.
    """
    n = parse_size_arg(amount) if isinstance(amount, str) else amount
    size = F.col("file_size") if "file_size" in lines.columns else F.col("_grand_bytes")
    in_reach = F.col("before") + F.col("total") > F.col("grand") - n - 1
    placed = running_total(
        lines, FILE, BLOCK, SEQ, F.col("n_bytes"), "_offset", keep_blocks=in_reach, grand="_grand_bytes"
    )
    return placed.where(F.col("_offset") >= size - n).select(*lines.columns)


def tail_lines(lines: DataFrame, n: int = DEFAULT_TAIL_LINES, estimate_bytes: int | None = None) -> DataFrame:
    """The last ``n`` lines of each file, or the last ``n * estimate_bytes`` bytes."""
    if estimate_bytes is not None:
        return tail_bytes(lines, n * estimate_bytes)
    placed = running_total(
        lines, FILE, BLOCK, SEQ, F.lit(1), "_later", keep_blocks=F.col("before") < n, reverse=True
    )
    return placed.where(F.col("_later") < n).select(*lines.columns)


def _is_passthrough() -> Column:
    return F.col("value").startswith("#") | (F.col("value") == "")


def route_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(records, passthrough)``: comments and empty lines pass, lines starting ``=`` are dropped."""
    records = lines.where(~_is_passthrough() & ~F.col("value").startswith("="))
    return records, lines.where(_is_passthrough())


def split_rejects(rows: DataFrame, line_columns: Sequence[str], replaced: str = "") -> tuple[DataFrame, DataFrame]:
    """``(records, rejects)`` of one parsed frame, so that a stored frame gives both from one parse.

    The frame has the columns of the lines, ``stage`` (null for a record) and the fields of records. A
    line column of the name ``replaced`` is held as ``line_`` and that name, as records have their own.
    """
    held_as = {c: f"line_{c}" if c == replaced else c for c in line_columns}
    dropped = {"value", "stage", *(held_as[c] for c in line_columns if c == replaced)}
    records = rows.where(F.col("stage").isNull()).select(*[c for c in rows.columns if c not in dropped])
    rejects = rows.where(F.col("stage").isNotNull())
    return records, rejects.select(*[F.col(held_as[c]).alias(c) for c in line_columns], "stage")


def mark_sections(rows: DataFrame, date: str = "date", out: str = "new_section") -> DataFrame:
    """True where the date differs from that of the preceding row of the file, and on the first."""
    day = F.xxhash64(date)  # only whether it changes counts
    marked = previous_value(rows, FILE, BLOCK, SEQ, day, "_previous")
    changed = F.col("_previous").isNull() | (F.col("_previous") != day)
    return marked.select(*rows.columns, changed.alias(out))
