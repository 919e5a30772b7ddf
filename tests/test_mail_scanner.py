"""Mail patterns: what they find is what the plain grammar finds, in time that grows with the text only."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from fleetlens.operators.mail import MAIL_KINDS, UNPARSED, classify_mail, parse_syslog_lines

# The grammar as it is written down, in dispatch order.
PLAIN = {
    "conn_prewarn": r"warning: hostname (.*?) does not resolve to address (.*?)(?:: (.*))?",
    "conn_start": r"connect from (.*?)\[(.*?)\]",
    "conn_auth_fail": r"warning: (.*?)\[(.*)\]: SASL ([A-Z]+) authentication failed:(.*)",
    "conn_lost": r"lost connection after (.*) from (.*?)\[(.*?)\]",
    "conn_timeout": r"timeout after (.*) from (.*?)\[(.*?)\]",
    "conn_end": r"disconnect from (.*?)\[(.*?)\](.*)",
    "conn_spf": r"(None|Pass|Fail); identity=(.*?); client-ip=(.*?); helo=(.*?); envelope-from=(.*?); receiver=(.*?)",
    "conn_reject_rcpt": r"NOQUEUE: reject: RCPT from (.*?)\[(.*?)\]: (.*)",
    "msg_start": r"([A-Z0-9]{10,11}): client=(.*?)\[(.*?)\](.*)",
    "msg_generic": r"([A-Z0-9]{10,11}): (.*)",
    "sys_dovecot_1": r"(auth|auth-worker)(?:\(\d+\))?: (passwd-file|sql)\((.*?),(.*)\): (.*)",
    "sys_dovecot_2":
        r"auth: login\((.*?),(.*)\): Request timed out waiting for client to continue authentication \((\d+) secs\)",
    "sys_dovecot_3":
        r"auth: login\(\?,(.*)\): Username character disallowed by auth_username_chars: 0x[0-9a-f]{2} \(username: (.*?)\)",
    "anvil_stats_1": r"statistics: max connection rate .* for \(.*\) at .*",
    "anvil_stats_2": r"statistics: max connection count \d+ for \(.*\) at .*",
    "anvil_stats_3": r"statistics: max cache size \d+ at .*",
}
SYSLOG = r"^.*?(?<![A-Za-z])([A-Za-z]+)(?![A-Za-z]) +(\d+) (\d{2}:\d{2}:\d{2}) ([a-z0-9-]+) (.*?)(?:\[(\d+)\])?: (.*)$"

STARTS = {
    "conn_prewarn": "warning: hostname ", "conn_start": "connect from ", "conn_auth_fail": "warning: ",
    "conn_lost": "lost connection after ", "conn_timeout": "timeout after ", "conn_end": "disconnect from ",
    "conn_spf": "Pass; identity=", "conn_reject_rcpt": "NOQUEUE: reject: RCPT from ", "msg_start": "ABCDEF1234: client=",
    "msg_generic": "ABCDEF12345: ", "sys_dovecot_1": "auth-worker(12): sql(", "sys_dovecot_2": "auth: login(",
    "sys_dovecot_3": "auth: login(?,", "anvil_stats_1": "statistics: max connection rate ",
    "anvil_stats_2": "statistics: max connection count 7 for (", "anvil_stats_3": "statistics: max cache size 5 at ",
}
PIECES = {
    "conn_prewarn": [" does not resolve to address ", ": ", ":"],
    "conn_auth_fail": ["]: SASL ", "LOGIN", " authentication failed:", "[", "]", "[]: SASL PLAIN authentication failed:"],
    "conn_spf": ["; client-ip=", "; helo=", "; envelope-from=", "; receiver=", "; "],
    "conn_reject_rcpt": ["]: ", "[", "]", ": "],
    "sys_dovecot_1": [",", "): ", ")", "("],
    "sys_dovecot_2": [",", "): Request timed out waiting for client to continue authentication (", "12", " secs)", ")",
                      ",a): Request timed out waiting for client to continue authentication (5 secs)"],
    "sys_dovecot_3": ["): Username character disallowed by auth_username_chars: 0x3f (username: ", ")", ","],
    "anvil_stats_1": [" for (", ") at ", "(", " at "],
    "anvil_stats_2": [") at ", " for (", ")"],
}
BRACKETS = ["[", "]", " from ", "from ", " ", "]["]


def expected(message):
    for name, _, address, msgid, content, severity in MAIL_KINDS:
        found = re.match(PLAIN[name] + r"\Z", message)
        if found:
            groups = [g or "" for g in (message, *found.groups())]
            fill = lambda text: re.sub(r"\$(\d)", lambda m: groups[int(m[1])], text)
            text = fill(content)
            if name == "conn_prewarn" and groups[3]:
                text = f"{text} ({groups[3]})"
            return name, None if name == "msg_generic" else fill(address), fill(msgid), severity, text
    return UNPARSED, "", "", "info", message


def classified(spark, messages):
    frame = spark.createDataFrame([(i, m) for i, m in enumerate(messages)], "i int, message string")
    rows = classify_mail(frame).orderBy("i").collect()
    return [(r.kind, r.ipaddr, r.msgid, r.severity, r.content) for r in rows]


def test_same_as_the_grammar_on_texts_made_of_delimiters(spark):
    rng = random.Random(11)
    messages = []
    for name, start in STARTS.items():
        pieces = [*PIECES.get(name, BRACKETS), "x", "é\u2028", ""]
        for _ in range(400):
            body = "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 9)))
            messages.append(start + body + rng.choice(["", "", "]", ")", "h[1.2.3.4]"]))
    got = classified(spark, messages)
    for message, found in zip(messages, got):
        assert found == expected(message), message
    assert {g[0] for g in got} == {*PLAIN, UNPARSED}


def test_same_syslog_fields_as_the_grammar(spark):
    rng = random.Random(12)
    pieces = ["Jan", " ", "  ", "1", "01", " 10:00:00 ", "10:00:00", "host-1 ", "proc", "[12]", "[", "]", ": ", ":", "é", "Feb 3 11:12:13 h p: "]
    lines = ["Mar 2 01:02:03 box " + "".join(rng.choice(pieces) for _ in range(rng.randrange(8))) for _ in range(800)]
    lines += ["".join(rng.choice(pieces) for _ in range(rng.randrange(3, 14))) for _ in range(3000)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, value string")
    rows = parse_syslog_lines(frame, 2024).orderBy("i").collect()
    months = "Jan Feb Mar".split()
    matched = 0
    for line, row in zip(lines, rows):
        found = re.match(SYSLOG, line)
        if not found or found[1] not in months:
            assert row.stage == "syslog", line
            continue
        matched += 1
        assert row.stage is None, line
        assert (row.time, row.host, row.process, row.message) == (found[3], found[4], found[5], found[7]), line
        assert row.pid == (int(found[6]) if found[6] else None), line
    assert matched > 800


@pytest.mark.parametrize("name", sorted(STARTS))
def test_hostile_messages_take_linear_time(spark, name):
    pieces = PIECES.get(name, BRACKETS)
    bodies = [p * (10**6 // len(p)) for p in pieces]
    bodies += [(p + q) * (10**6 // len(p + q)) for p in pieces for q in pieces if p != q]
    bodies.append("".join(pieces) * (10**6 // len("".join(pieces))))
    frame = spark.createDataFrame([(STARTS[name] + b + end,) for b in bodies for end in ("", "]")], "message string").repartition(8).cache()
    n = frame.count()
    start = time.perf_counter()
    assert classify_mail(frame).select(F.length("content")).toArrow().num_rows == n
    seconds = time.perf_counter() - start
    frame.unpersist()
    assert seconds < 1.0 * n, (name, seconds, n)


def test_hostile_lines_take_linear_time(spark):
    head = "Mar 2 01:02:03 box "
    bodies = [head, "Mar ", "a ", " ", "1 ", "Mar 2 ", "Mar 2 01:02:03 ", "[1", "[1]", ":", "x[12] "]
    frame = spark.createDataFrame([(head + b * (10**6 // len(b)),) for b in bodies], "value string").repartition(8).cache()
    frame.count()
    start = time.perf_counter()
    rows = parse_syslog_lines(frame, 2024).select("stage").collect()
    assert len(rows) == len(bodies) and time.perf_counter() - start < len(bodies)
    frame.unpersist()
