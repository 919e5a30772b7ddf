"""Mail log: syslog parsing, message kinds, and the client address of a message id."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.arguments import MONTHS
from fleetlens.functions.matching import SEPARATOR, digits_to_long, held, match_groups
from fleetlens.operators.lines import split_rejects
from fleetlens.operators.ordered import carry_last

# A remote client writes part of these lines, so no pattern may take more than linear time on any text. Each literal
# is looked for once: where the first place of a literal lets the rest fail, later places do so too, and
# a possessive class or an atomic group keeps the match from trying them.

# The syslog grammar; text before the month name is skipped. A month is tried at the
# start of a run of letters only, so a long run is passed once.
_SYSLOG = (
    r"(?d)^(?>.*?(?<![A-Za-z])([A-Za-z]++) +(\d+) (\d{2}:\d{2}:\d{2}) "
    r"([a-z0-9-]++) )"
    r"(?>(.*?)(?:\[(\d++)\])?: )"
    r"(.*)$"
)
_SYSLOG_GROUPS = 7

# Message kinds in dispatch order; the first pattern that matches wins. Each row is
# (kind, pattern, address, message id, content, severity), where the address, id and content are
# replacement texts and "$0" is the whole message.
MAIL_KINDS = (
    ("conn_prewarn", r"warning: hostname (?>(.*?) does not resolve to address )(.*?)(?:: (.*))?",
     "$2", "", "hostname [$1] does not resolve back", "info"),
    ("conn_start", r"connect from ([^\[]*+)\[(.*)\]",
     "$2", "", "connect from $1", "notice"),
    ("conn_auth_fail", r"warning: ([^\[]*+)\[(.*)\]: SASL ([A-Z]++) authentication failed:(.*)",
     "$2", "", "$0", "info"),
    ("conn_lost", r"lost connection after (.*) from (.*?)\[(.*?)\]",
     "$3", "", "lost connection after $1", "info"),
    ("conn_timeout", r"timeout after (.*) from (.*?)\[(.*?)\]",
     "$3", "", "timeout after $1", "info"),
    ("conn_end", r"disconnect from ([^\[]*+)\[([^\]]*+)\](.*)",
     "$2", "", "disconnect from $1$3", "notice"),
    ("conn_spf",
     r"(None|Pass|Fail); identity=(?>(.*?); client-ip=)(?>(.*?); helo=)(?>(.*?); envelope-from=)(?>(.*?); receiver=)(.*)",
     "$3", "", "result=$1; idnt=$2; helo=$4; from=$5; recv=$6", "info"),
    ("conn_reject_rcpt", r"NOQUEUE: reject: RCPT from ([^\[]*+)\[(?>(.*?)\]: )(.*)",
     "$2", "", "NOQUEUE: reject RCPT: $3", "info"),
    ("msg_start", r"([A-Z0-9]{10,11}): client=([^\[]*+)\[([^\]]*+)\](.*)",
     "$3", "$1", "client=$2$4", "info"),
    ("msg_generic", r"([A-Z0-9]{10,11}): (.*)",
     "", "$1", "$2", "info"),
    ("sys_dovecot_1", r"(auth|auth-worker)(?:\(\d+\))?: (passwd-file|sql)\(([^,]*+),(.*)\): (.*)",
     "$4", "", "$1: $2($3): $5", "alert"),
    ("sys_dovecot_2",
     r"auth: login\(([^,]*+),(.*)\): Request timed out waiting for client to continue authentication \((\d++) secs\)",
     "$2", "", "$0", "alert"),
    ("sys_dovecot_3",
     r"auth: login\(\?,(?=.*\)$)(.*)\): Username character disallowed by auth_username_chars: "
     r"0x[0-9a-f]{2} \(username: (.*)\)",
     "$1", "", "$0", "alert"),
    ("anvil_stats_1", r"statistics: max connection rate (?>.*? for \()(?>.*?\) at ).*", "", "", "", "info"),
    ("anvil_stats_2", r"statistics: max connection count \d++ for \((?>.*?\) at ).*", "", "", "", "info"),
    ("anvil_stats_3", r"statistics: max cache size \d++ at .*", "", "", "", "info"),
)
# Kinds whose first field ends at the last " from " that an opening bracket follows. Seen from the end
# of the text that is the first one behind the first bracket, so these are matched backwards:
# address, host without brackets, first field.
_BACKWARDS = ("conn_lost", "conn_timeout")
_FROM_BACKWARDS = (
    r"\]([^\[]*+(?:\[(?:(?! morf )[^\[])*+(?=\[))*+)\[((?:(?! morf )[^\[])*+) morf (.*)"
)
# A text that every message of the kind holds, where the pattern does not begin with one.
_HOLDS = {
    "conn_auth_fail": "]: SASL ",
    "conn_spf": "; identity=",
    "msg_start": ": client=",
    "msg_generic": ": ",
    "sys_dovecot_1": "auth",
}
# Kinds tried in one step. A step is one generated method, and the JVM leaves a method of more than 8,000 bytes
# uncompiled, which all kinds together would be.
_STEP = 6
UNPARSED = "unparsed"
UNKNOWN_ADDRESS = "**UNKNOWN**"


def parse_syslog(lines: DataFrame, year: int) -> tuple[DataFrame, DataFrame]:
    """``(records, rejects)``. Syslog lines carry no year, so the caller gives it."""
    return split_rejects(parse_syslog_lines(lines, year), lines.columns, "host")


def parse_syslog_lines(lines: DataFrame, year: int) -> DataFrame:
    """The frame that holds records and rejects; see :func:`~fleetlens.operators.lines.split_rejects`.

    The host is the one that the line names; a host column of the lines stays with the rejects as
    ``line_host``.
    """
    groups = held(lines, g=match_groups(F.col("value"), _SYSLOG, _SYSLOG_GROUPS))
    names = "month day time host process pid message".split()
    fields = {name: F.get("g", F.lit(i)) for i, name in enumerate(names)}
    month = F.when(F.size("g") == _SYSLOG_GROUPS, F.array_position(F.lit(list(MONTHS)), fields["month"]))
    valid = F.coalesce(month, F.lit(0)) > 0
    day = digits_to_long(fields["day"]).cast("string")
    date = F.concat_ws(
        "-",
        F.lit(f"{year:04d}"),
        F.lpad(month.cast("string"), 2, "0"),
        F.when(F.length(day) < 2, F.lpad(day, 2, "0")).otherwise(day),
    )
    others = [F.col(c).alias("line_host" if c == "host" else c) for c in lines.columns]
    return groups.select(
        *others,
        F.when(~valid, "syslog").alias("stage"),
        date.alias("date"),
        fields["time"].alias("time"),
        fields["host"].alias("host"),
        fields["process"].alias("process"),
        digits_to_long(fields["pid"]).alias("pid"),
        fields["message"].alias("message"),
    )


def _may_match(message: Column, name: str, pattern: str) -> Column:
    """A cheap test that every message of the kind passes."""
    start = re.match(r"[\w :]*", pattern).group()
    tests = [message.startswith(start)] if start else []
    tests += [message.contains(_HOLDS[name])] if name in _HOLDS else []
    return reduce(Column.__and__, tests)


def _packed(message: Column, kinds: Sequence[tuple[str, ...]]) -> Column:
    """The fields of the first kind that a message matches, as one text; null if it matches none."""
    cases = F
    for name, pattern, address, msgid, content, severity in kinds:
        reason = "$3" if name == "conn_prewarn" else ""  # shown in brackets, if there is one
        may = _may_match(message, name, pattern)
        if name in _BACKWARDS:
            before = pattern[: pattern.index("(")]
            whole = f"(?d)^{_FROM_BACKWARDS}{before[::-1]}$"
            fields = ("", severity[::-1], f"$3{before[::-1]}", "", "$1", name[::-1])
            text = F.reverse(message)
            cases = cases.when(
                may & message.endswith("]") & text.rlike(whole),
                F.reverse(F.regexp_replace(text, whole, SEPARATOR.join(fields))),
            )
            continue
        packed = SEPARATOR.join((name, address, msgid, content, severity, reason))
        whole = f"(?d)^{pattern}$"
        cases = cases.when(may & message.rlike(whole), F.regexp_replace(message, whole, packed))
    return cases


def classify_mail(records: DataFrame) -> DataFrame:
    """Add ``kind``, ``ipaddr``, ``msgid``, ``severity`` and ``content``.

    Most messages meet the pattern of their own kind only, as literal texts tell the kinds apart
    first. The address of ``msg_generic`` rows is left null for :func:`enrich_msgid`.
    """
    steps = [_packed(F.col("message"), MAIL_KINDS[i : i + _STEP]) for i in range(0, len(MAIL_KINDS), _STEP)]
    rows = held(records, p=steps[0])
    for step in steps[1:]:
        rows = held(rows, p=F.coalesce("p", step))
    rows = held(rows, p=F.split("p", SEPARATOR, -1))
    found = F.col("p").isNotNull()
    name, address, msgid, content, severity, reason = (F.get("p", F.lit(i)) for i in range(6))
    return rows.select(
        *records.columns,
        F.when(found, name).otherwise(UNPARSED).alias("kind"),
        F.when(found, F.when(name != "msg_generic", address)).otherwise("").alias("ipaddr"),
        F.when(found, msgid).otherwise("").alias("msgid"),
        F.when(found, severity).otherwise("info").alias("severity"),
        F.when(~found, F.col("message"))
        .when(reason != "", F.concat(content, F.lit(" ("), reason, F.lit(")")))
        .otherwise(content)
        .alias("content"),
    )


def enrich_msgid(records: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Give rows of a message id the client address of its latest earlier ``msg_start`` row.

    ``scope`` narrows the state, for instance to ``["host"]``, where several hosts may use the same
    ids. Rows without a message id keep their address; they stay in the same flow, as splitting them
    off would read and parse the lines once more, but carry nothing and are no group of their own.
    """
    client = F.when(F.col("kind") == "msg_start", F.col("ipaddr"))
    carried = carry_last(
        records, [*scope, "msgid"], ["file_path", "block_start"], "seq", client, "_client", F.col("msgid") != ""
    )
    ipaddr = F.coalesce(F.col("ipaddr"), F.col("_client"), F.lit(UNKNOWN_ADDRESS))
    return carried.withColumn("ipaddr", ipaddr).select(*records.columns)


def drop_statistics(records: DataFrame) -> DataFrame:
    """Remove rows without content."""
    return records.where(F.col("content") != "")
