"""Web access log: parsing and filters."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.arguments import parse_clause
from fleetlens.functions.labels import (
    client_display,
    dash_to_empty,
    duration_band,
    duration_label,
    duration_ms,
    effective_peer,
    origin_flag,
    proto_or_plain,
    size_label,
    status_class,
    unquote_field,
)
from fleetlens.functions.matching import blank_to_null, digits_to_long, held, match_groups
from fleetlens.operators.lines import split_rejects

# The line grammar
#   [peer>]ip user proto [date:time zone] "req" status size[ ["referer"] "agent"[ duration_us]]
# Quoted fields are matched possessively, so a long request cannot exhaust the stack.
_QUOTED = r'"(?:[^"\\]++|\\.)*+"'
_LINE = (
    r"(?d)^(?:([0-9.a-f:]+)>)?"
    r"([0-9.a-f:]+) "
    r"([^ ]+) "
    r"([^ ]+) "
    r"\[(\d+/\w+/\d{4}):([0-9:]+) (%s\d+)\] "
    rf"({_QUOTED}) "
    r"(\d+) "
    r"(\d+|-)"
    rf"(?: ({_QUOTED})? ({_QUOTED})(?: (\d+))?)?$"
)
_LINE_GROUPS = 13
_REQUEST = r'(?d)^"([A-Z]{1,7}) (.+) HTTP/(1\.[01])"$'
_TARGET = r"(?d)^([^?]+)(\?.*)$"
_STAMP = "d/MMM/yyyy H:mm:ss xx"


def parse_access(lines: DataFrame, strict_zone: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(records, rejects)`` of the common, combined and house formats.

    A line is rejected when it does not match the grammar or has no valid time. With
    ``strict_zone`` only zones east of Greenwich match, as written with a plus sign.
    """
    return split_rejects(parse_access_lines(lines, strict_zone), lines.columns)


def parse_access_lines(lines: DataFrame, strict_zone: bool = True) -> DataFrame:
    """The frame that holds records and rejects; see :func:`~fleetlens.operators.lines.split_rejects`."""
    pattern = _LINE % (r"\+" if strict_zone else "[+-]")
    groups = held(lines, g=match_groups(F.col("value"), pattern, _LINE_GROUPS))
    names = "peer ip user proto date time zone req status size referer agent duration".split()
    fields = {name: F.get("g", F.lit(i)) for i, name in enumerate(names)}
    stamp = F.try_to_timestamp(
        F.concat_ws(" ", fields["date"], fields["time"], fields["zone"]), F.lit(_STAMP)
    )
    found = F.size("g") == _LINE_GROUPS
    staged = held(groups, stamp=F.when(found, stamp))
    rejected = F.when(F.col("stamp").isNull(), F.when(found, "time").otherwise("line"))
    return staged.select(
        *lines.columns,
        rejected.alias("stage"),
        "stamp",
        effective_peer(blank_to_null(fields["peer"]), fields["ip"]).alias("peer"),
        fields["ip"].alias("ip"),
        dash_to_empty(fields["user"]).alias("user"),
        dash_to_empty(fields["proto"]).alias("proto"),
        fields["date"].alias("date"),
        fields["time"].alias("time"),
        fields["req"].alias("req"),
        digits_to_long(fields["status"]).alias("status"),
        F.when(fields["size"] == "-", F.lit(0).cast("bigint"))
        .otherwise(digits_to_long(fields["size"]))
        .alias("size"),
        unquote_field(blank_to_null(fields["referer"])).alias("referer"),
        unquote_field(blank_to_null(fields["agent"])).alias("agent"),
        duration_ms(digits_to_long(fields["duration"])).alias("duration_ms"),
    )


def parse_request(req: Column) -> Column:
    """``struct<method, path, query, http_version, malformed>`` of a quoted request."""
    parts = match_groups(req, _REQUEST, 3)
    target = F.get(parts, F.lit(1))
    split = match_groups(target, _TARGET, 2)
    good = F.size(parts) == 3
    return F.struct(
        F.when(good, F.get(parts, F.lit(0))).alias("method"),
        F.when(good, F.get(split, F.lit(0))).alias("path"),
        F.when(good, F.coalesce(F.get(split, F.lit(1)), F.lit(""))).alias("query"),
        F.when(good, F.get(parts, F.lit(2))).alias("http_version"),
        (~good).alias("malformed"),
    )


def _whole_number(value: str) -> int:
    """The leading whole number of a filter value; zero without one."""
    found = re.match(r"\s*([+-]?[0-9]+)", value)
    return int(found[1]) if found else 0


# One predicate per filter key.
_PREDICATES = {
    "url": lambda v: F.col("req").contains(v),
    "req": lambda v: F.col("req").contains(v),
    "status": lambda v: F.col("status") == _whole_number(v),
    "ip": lambda v: F.col("ip").contains(v),
    "time": lambda v: F.col("time").startswith(v),
    "minsize": lambda v: F.col("size") >= _whole_number(v),
    "maxsize": lambda v: F.col("size") <= _whole_number(v),
    "peer": lambda v: F.col("peer").contains(v),
}
# Values of these keys are verbatim parts of the line, so lines without them cannot pass.
_IN_LINE = {"url", "req", "ip", "peer"}

Clause = tuple[str, Sequence[str]]


def clauses_of(filters: Iterable[str | Clause]) -> list[Clause]:
    """Accept ``"status=404,500"`` texts and ``("status", ["404"])`` pairs."""
    return [parse_clause(f) if isinstance(f, str) else f for f in filters]


def apply_filters(records: DataFrame, filters: Iterable[str | Clause]) -> DataFrame:
    """All clauses must hold; within a clause any value may. An unknown key holds for no row."""
    for clause in clauses_of(filters):
        records = records.where(clause_condition(clause))
    return records


def clause_condition(clause: Clause) -> Column:
    key, values = clause
    known = _PREDICATES.get(key)
    return reduce(Column.__or__, [known(v) for v in values] if known else [], F.lit(False))


def prefilter_lines(lines: DataFrame, filters: Iterable[str | Clause]) -> DataFrame:
    """Drop lines that cannot pass ``filters`` before the costly parse.

    Lines that would be rejected may go too, so use it only when rejects are not wanted.
    """
    for key, values in clauses_of(filters):
        if key in _IN_LINE and values:
            lines = lines.where(reduce(Column.__or__, [F.col("value").contains(v) for v in values]))
    return lines


def label_access(records: DataFrame, net: str | None = None) -> DataFrame:
    """Add the display classes of a record; ``net`` names the network label column, if any."""
    label = F.col(net) if net else F.lit(None).cast("string")
    return records.select(
        "*",
        status_class(F.col("status")).alias("status_class"),
        size_label(F.col("size")).alias("size_label"),
        duration_label(F.col("duration_ms")).alias("duration_label"),
        duration_band(F.col("duration_ms")).alias("duration_band"),
        origin_flag(label, F.col("peer")).alias("origin_flag"),
        client_display(label, F.col("ip")).alias("client"),
        proto_or_plain(F.col("proto")).alias("protocol"),
    )
