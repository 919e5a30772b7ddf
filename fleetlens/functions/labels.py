"""Classes and fixed-width labels of log fields.

Every rounding is done on whole numbers, so results do not depend on how a formatter treats ties.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A label class per range, and the placeholder texts.
KIB = 1024
MIB = 1024 * 1024
SIZE_NONE = "  - "
SIZE_TINY = "  < "
DURATION_NONE = "  -   "
HIGHLIGHTED_VERDICTS = ("REJECT", "DROP", "ACCEPT", "LOG", "RETURN")


def _div(number: Column, by: int) -> Column:
    """Whole-number division that stays in bigint."""
    return F.call_function("div", number, F.lit(by).cast("bigint"))


def _rounded(number: Column, by: int) -> Column:
    """Whole-number division of a non-negative number, half up, without overflow."""
    return _div(number, by) + F.when(number % by >= (by + 1) // 2, 1).otherwise(0).cast("bigint")


def _right(text: Column, width: int) -> Column:
    """Right-align to ``width``; longer texts stay whole."""
    return F.when(F.length(text) < width, F.lpad(text, width, " ")).otherwise(text)


def status_class(status: Column) -> Column:
    return (
        F.when(status == 200, "ok")
        .when(status.between(200, 299), "success")
        .when(status.between(300, 399), "redirect")
        .otherwise("problem")
    )


def size_label(size: Column) -> Column:
    """Four characters for up to 999 MiB; longer above."""
    size = size.cast("bigint")
    tenths = _rounded(size * 10, MIB)
    tenths_text = F.concat(_div(tenths, 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    return (
        F.when(size.isNull() | (size == 0), SIZE_NONE)
        .when(size < KIB // 2, SIZE_TINY)
        .when(size < 1999 * KIB // 2, F.concat(_right(_rounded(size, KIB).cast("string"), 3), F.lit("k")))
        .when(size <= 995 * MIB // 100, F.concat(tenths_text, F.lit("M")))
        .otherwise(F.concat(_right(_rounded(size, MIB).cast("string"), 3), F.lit("M")))
    )


def duration_label(ms: Column) -> Column:
    ms = ms.cast("bigint")
    # format_number rounds the exact double value, ties to even, as the C formatters do.
    seconds = F.format_number(ms / F.lit(1000.0), 1)
    return (
        F.when(ms.isNull() | (ms == 0), DURATION_NONE)
        .when(ms < 10000, F.concat(_right(ms.cast("string"), 4), F.lit("ms")))
        .when(ms < 99950, F.concat(_right(seconds, 4), F.lit("s ")))
        .otherwise(F.concat(_right(_rounded(ms, 1000).cast("string"), 4), F.lit("s ")))
    )


def duration_band(ms: Column) -> Column:
    return (
        F.when(ms >= 10000, "critical")
        .when(ms > 1499, "slow")
        .when(ms > 299, "warn")
        .otherwise("normal")
    )


def duration_ms(us: Column) -> Column:
    """Microseconds to milliseconds, half away from zero."""
    return _rounded(us, 1000)


def unquote_field(quoted: Column) -> Column:
    """Missing stays null; a quoted dash becomes empty; otherwise the outer quotes go."""
    return F.when(quoted == '"-"', "").otherwise(quoted.substr(F.lit(2), F.length(quoted) - 2))


def dash_to_empty(text: Column) -> Column:
    return F.when(text == "-", "").otherwise(text)


def effective_peer(peer: Column, ip: Column) -> Column:
    """Blank when absent or the same as the client address."""
    return F.when(peer.isNull() | (peer == ip), "").otherwise(peer)


def origin_flag(net: Column, peer: Column) -> Column:
    return F.when(F.coalesce(net, F.lit("")) != "", "@").when(peer != "", ">").otherwise("")


def client_display(net: Column, ip: Column) -> Column:
    return F.when(F.coalesce(net, F.lit("")) != "", net).otherwise(ip)


def proto_or_plain(proto: Column) -> Column:
    return F.when(proto == "", "PLAIN").otherwise(proto)


def thousands(number: Column) -> Column:
    """One separator, before the last three digits only."""
    return F.regexp_replace(number.cast("string"), r"(?d)^(\d+)(\d{3})$", "$1'$2")


def short_id(hex_id: Column) -> Column:
    return hex_id.substr(1, 12)


def container_state(status: Column) -> Column:
    return (
        F.when(status.startswith("Exited"), "exited")
        .when(status.startswith("Up"), "up")
        .when(status.startswith("Creat"), "created")
        .otherwise("other")
    )


def short_status(status: Column) -> Column:
    """``Exited (0) …`` is shortened to ``Ex(0) …``; other texts stay."""
    return F.when(
        status.startswith("Exited"), F.concat(F.lit("Ex"), F.substring(status, 8, 2**31 - 1))
    ).otherwise(status)


def verdict_class(target: Column) -> Column:
    return F.when(target.isin(*HIGHLIGHTED_VERDICTS), F.lower(target)).otherwise("plain")


def preview(line: Column, width: int = 60) -> Column:
    """The first ``width`` characters of a line that is longer than that in bytes."""
    return F.when(
        F.octet_length(line) > width, F.concat(line.substr(1, width), F.lit("...[TRIMMED]"))
    ).otherwise(line)


def line_length(line: Column) -> Column:
    return F.octet_length(line)


def content_md5(content: Column) -> Column:
    return F.md5(content)


def section_date(stamp: Column) -> Column:
    return F.date_format(stamp, "dd/MMM/yyyy")
