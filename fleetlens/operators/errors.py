"""Web error log: parsing and noise rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.labels import section_date
from fleetlens.functions.matching import blank_to_null, digits_to_long, held, match_groups
from fleetlens.operators.lines import split_rejects

# The line grammar
#   [Day Mon DD HH:MM:SS.us YYYY] [channel:level] [pid n[:tid n]] [[client ip:port]] message
_LINE = (
    r"(?d)^\[([A-Za-z0-9:\. ]+)\] "
    r"\[(\w*):(\w+)\] "
    r"\[pid (\d+)(?::tid (\d+))?\] "
    r"(?:\[client ([0-9a-f:\.]+)\] )?"
    r"(.*)$"
)
_LINE_GROUPS = 7
_DATETIME = r"(?d)^\w{3} (\w{3}) 0?(\d+) (\d{2}:\d{2}:\d{2}\.\d+) (\d{4})$"
_STAMP = "MMM d HH:mm:ss yyyy"
_CLIENT = r"(?d)^([0-9a-f:.]+):(\d+)$"
_TRIMMED = " \t\n\r\0\x0b"

# Fixed values: (channel, level, message pattern) of routine messages; None matches anything.
NOISE_RULES = (
    ("ssl", "info", "AH01964: "),
    ("ssl", "info", "AH01998: "),
    ("ssl", "info", "AH01991: "),
    ("ssl", "info", "AH01993: "),
    ("reqtimeout", "info", "^AH01382:"),
    ("php7", "error", "^script '(.*)' not found or unable to stat"),
    ("core", "info", "^AH00128:"),
)

Rule = tuple[str | None, str | None, str | None]


def parse_error(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(records, rejects)``; a reject names the stage that failed: line, datetime or client."""
    return split_rejects(parse_error_lines(lines), lines.columns)


def parse_error_lines(lines: DataFrame) -> DataFrame:
    """The frame that holds records and rejects; see :func:`~fleetlens.operators.lines.split_rejects`."""
    groups = held(lines, g=match_groups(F.col("value"), _LINE, _LINE_GROUPS))
    names = "datetime channel level pid tid client message".split()
    fields = {name: F.get("g", F.lit(i)) for i, name in enumerate(names)}
    found = F.size("g") == _LINE_GROUPS
    day = match_groups(fields["datetime"], _DATETIME, 4)
    client = match_groups(fields["client"], _CLIENT, 2)
    staged = held(groups, d=F.when(found, day), c=F.when(found & (fields["client"] != ""), client))
    clock = F.get("d", F.lit(2))
    stamp = F.try_to_timestamp(
        F.concat_ws(" ", F.get("d", F.lit(0)), F.get("d", F.lit(1)), clock.substr(1, 8), F.get("d", F.lit(3))),
        F.lit(_STAMP),
    )
    staged = held(staged, stamp=F.when(F.size("d") == 4, stamp))
    stage = (
        F.when(~found, "line")
        .when(F.col("stamp").isNull(), "datetime")
        .when(F.col("c").isNotNull() & (F.size("c") != 2), "client")
    )
    return staged.select(
        *lines.columns,
        stage.alias("stage"),
        "stamp",
        section_date(F.col("stamp")).alias("date"),
        clock.substr(1, 8).alias("time"),
        fields["channel"].alias("channel"),
        fields["level"].alias("level"),
        digits_to_long(fields["pid"]).alias("pid"),
        digits_to_long(fields["tid"]).alias("tid"),
        blank_to_null(F.get("c", F.lit(0))).alias("ip"),
        digits_to_long(F.get("c", F.lit(1))).alias("port"),
        F.btrim(fields["message"], F.lit(_TRIMMED)).alias("message"),
    )


def _matches(rule: Rule) -> Column:
    channel, level, pattern = rule
    parts = [F.col("channel") == channel] if channel is not None else []
    parts += [F.col("level") == level] if level is not None else []
    parts += [F.col("message").rlike("(?d)" + pattern)] if pattern is not None else []
    return reduce(Column.__and__, parts, F.lit(True))


def flag_noise(records: DataFrame, rules: Sequence[Rule] = NOISE_RULES, drop: bool = False) -> DataFrame:
    """Flag routine messages in ``noise``; with ``drop`` they are removed instead."""
    noise = reduce(Column.__or__, [_matches(rule) for rule in rules], F.lit(False))
    return records.where(~noise) if drop else records.withColumn("noise", noise)
