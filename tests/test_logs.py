"""The three log formats, from files of our own."""

from __future__ import annotations

import time
import datetime as dt
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fleetlens.functions.labels import duration_band, duration_label, duration_ms, size_label, status_class
from fleetlens.operators.access import apply_filters, parse_access, parse_request
from fleetlens.operators.errors import flag_noise, parse_error
from fleetlens.operators.lines import route_lines
from fleetlens.operators.mail import classify_mail, parse_syslog
from fleetlens.plans.pipelines import access_log, error_log, mail_log
from fleetlens.sources.lines import read_lines

DATA = Path(__file__).parent / "data"


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("file_path", "block_start", "seq").collect()]


def test_access_records(spark):
    records, rejects = parse_access(route_lines(read_lines(spark, str(DATA / "access.log")))[0])
    got = rows(records, "peer", "ip", "user", "proto", "status", "size", "referer", "agent", "duration_ms")
    assert got == [
        ("", "192.0.2.10", "", "", 200, 0, None, None, None),
        ("", "192.0.2.11", "", "", 204, 1024, None, None, None),
        ("", "192.0.2.12", "", "", 301, 0, "https://www.example.org/", "Browser/5.0 (x)", None),
        ("", "192.0.2.13", "anna", "TLSv1.3", 404, 511, "", "", None),
        ("198.51.100.1", "192.0.2.14", "", "TLSv1.3", 500, 512, 'x \\"y\\" z', "Browser", 1),
        ("", "198.51.100.1", "", "TLSv1.3", 200, 12944670720, "", "", 9999500),
        ("", "2a01:db8::1", "", "TLSv1.3", 200, 7, None, "only agent", 1),
        ("", "127.0.0.1", "", "", 200, 1024, "", "Browser/5.0 (tail test)", 11),
        ("", "192.0.2.11", "", "", 200, 1024, "", "Browser/5.0 (tail tst)", 11),
    ]
    stages = rows(rejects, "stage", "value")
    assert [s for s, _ in stages] == ["line", "time", "line"]
    stamps = [r[0] for r in rows(records.withColumn("s", F.unix_timestamp("stamp")), "s")]
    assert stamps[3] == int(dt.datetime(2023, 3, 1, 5, 8, 1, tzinfo=dt.timezone.utc).timestamp())


def test_access_zone_may_be_negative(spark):
    lines = read_lines(spark, str(DATA / "access.log"))
    records, _ = parse_access(route_lines(lines)[0], strict_zone=False)
    assert records.where("ip = '192.0.2.15'").select(F.unix_timestamp("stamp")).first()[0] == int(
        dt.datetime(2023, 3, 1, 11, 9, 1, tzinfo=dt.timezone.utc).timestamp()
    )


def test_access_report(spark):
    report, _ = access_log(read_lines(spark, str(DATA / "access.log")), filters=["status=200,500"])
    got = rows(report, "date", "new_section", "status_class", "size_label", "duration_label", "origin_flag", "protocol")
    assert got == [
        ("01/Mar/2023", True, "ok", "  - ", "  -   ", "", "PLAIN"),
        ("02/Mar/2023", True, "problem", "  1k", "   1ms", ">", "TLSv1.3"),
        ("02/Mar/2023", False, "ok", "12345M", "10000s ", "", "TLSv1.3"),
        ("01/Mar/2023", True, "ok", "  < ", "   1ms", "", "TLSv1.3"),
        ("02/Mar/2023", True, "ok", "  1k", "  11ms", "", "PLAIN"),
        ("02/Mar/2023", False, "ok", "  1k", "  11ms", "", "PLAIN"),
    ]


@pytest.mark.parametrize(
    "filters, kept",
    [
        ([], 9),
        (["status=200"], 5),
        (["status=200,404", "minsize=511"], 4),
        (["maxsize=511"], 4),
        (["ip=192.0.2.1"], 6),
        (["peer=198.51"], 1),
        (["time=23:5"], 2),
        (["url=/a?,POST"], 2),
        ([("req", ["GET"])], 8),
        (["colour=red"], 0),
        ([("status", [])], 0),
        (["minsize=1", "minsize=1024"], 4),
    ],
)
def test_filters(spark, filters, kept):
    records, _ = parse_access(route_lines(read_lines(spark, str(DATA / "access.log")))[0])
    assert apply_filters(records, filters).count() == kept


def test_request(spark):
    texts = ['"GET /a?b?c HTTP/1.1"', '"GET ?x HTTP/1.0"', '"GET / HTTP/2.0"', '"-"', '"get / HTTP/1.1"']
    got = spark.createDataFrame([(t,) for t in texts], "req string").select(parse_request(F.col("req")).alias("r"))
    assert [tuple(r["r"]) for r in got.collect()] == [
        ("GET", "/a", "?b?c", "1.1", False),
        ("GET", "?x", "", "1.0", False),
        (None, None, None, None, True),
        (None, None, None, None, True),
        (None, None, None, None, True),
    ]


# size in bytes -> label
SIZES = {
    0: "  - ", 1: "  < ", 499: "  < ", 511: "  < ", 512: "  1k", 1024: "  1k", 2048: "  2k", 1023487: "999k",
    1023488: "1.0M", 1310720: "1.3M", 10433331: "9.9M", 10433332: " 10M", 1048051711: "999M", 1048051712: "1000M",
    12944670720: "12345M", 2**63 - 1: "8796093022208M",
}
# microseconds -> (label, band)
DURATIONS = {
    0: ("  -   ", "normal"), 499: ("  -   ", "normal"), 500: ("   1ms", "normal"), 299499: (" 299ms", "normal"),
    299500: (" 300ms", "warn"), 1499499: ("1499ms", "warn"), 1499500: ("1500ms", "slow"),
    9999499: ("9999ms", "slow"), 9999500: ("10.0s ", "critical"), 12250000: ("12.2s ", "critical"),
    12350000: ("12.3s ", "critical"), 12750000: ("12.8s ", "critical"), 99949499: ("99.9s ", "critical"),
    99949500: (" 100s ", "critical"), 999999999: ("1000s ", "critical"), 9999499499: ("9999s ", "critical"),
    9999499500: ("10000s ", "critical"),
}


def test_labels(spark):
    sizes = spark.createDataFrame([(s,) for s in SIZES], "s bigint").select("s", size_label(F.col("s")))
    assert {r[0]: r[1] for r in sizes.collect()} == SIZES
    times = spark.createDataFrame([(d,) for d in DURATIONS], "us bigint").withColumn("ms", duration_ms(F.col("us")))
    labelled = times.select("us", duration_label(F.col("ms")), duration_band(F.col("ms")))
    assert {r[0]: (r[1], r[2]) for r in labelled.collect()} == DURATIONS
    codes = {200: "ok", 204: "success", 301: "redirect", 404: "problem", 100: "problem", 600: "problem"}
    got = spark.createDataFrame([(c,) for c in codes], "c bigint").select("c", status_class(F.col("c")))
    assert {r[0]: r[1] for r in got.collect()} == codes


def test_error_records(spark):
    records, rejects = parse_error(route_lines(read_lines(spark, str(DATA / "error.log")))[0])
    got = rows(flag_noise(records), "date", "time", "channel", "level", "pid", "tid", "ip", "port", "message", "noise")
    assert got == [
        ("06/Mar/2023", "17:09:03", "mpm_event", "notice", 65, None, None, None,
         "AH00169: caught SIGTERM, shutting down", False),
        ("06/Mar/2023", "16:55:43", "", "error", 84, None, "192.0.2.9", 54500, "Notice:  undefined index", False),
        ("07/Mar/2023", "16:55:43", "ssl", "info", 84, None, "2a01:db8::2", 38470,
         "AH01964: Connection to child 1", True),
    ]
    assert [r[0] for r in rows(rejects, "stage")] == ["datetime", "client", "datetime", "datetime", "line"]
    report, _ = error_log(read_lines(spark, str(DATA / "error.log")), drop_noise=True)
    assert [r[0] for r in rows(report, "new_section")] == [True, False]


MAIL = [
    ("conn_prewarn", "192.0.2.2", "", "info", "hostname [a.example.org] does not resolve back"),
    ("conn_prewarn", "192.0.2.3", "", "info",
     "hostname [b.example.org] does not resolve back (Name or service not known)"),
    ("conn_start", "192.0.2.1", "", "notice", "connect from unknown"),
    ("conn_spf", "192.0.2.1", "", "info",
     "result=None; idnt=helo; helo=h.example.org; from=s@example.org; recv=r@example.net"),
    ("conn_spf", "192.0.2.4", "", "info", "result=Fail; idnt=helo; helo=h; from=s@example.org; recv=r@example.net"),
    ("conn_reject_rcpt", "192.0.2.4", "", "info", "NOQUEUE: reject RCPT: 550 5.7.1 <r@example.net>: rejected"),
    ("msg_start", "192.0.2.1", "ABCDEF1234", "info", "client=unknown"),
    ("msg_start", "192.0.2.5", "0123456789A", "info", "client=home.example.org, sasl_method=LOGIN"),
    ("msg_generic", "192.0.2.1", "ABCDEF1234", "info", "message-id=<1@example.org>"),
    ("msg_generic", "192.0.2.1", "ABCDEF1234", "info", "[192.0.2.1] not internal"),
    ("msg_generic", "**UNKNOWN**", "9AE1819E818", "info", "to=<x@example.com>, status=deferred"),
    ("conn_end", "192.0.2.1", "", "notice", "disconnect from unknown helo=1 quit=1"),
    ("conn_auth_fail", "192.0.2.6", "", "info", "warning: unknown[192.0.2.6]: SASL PLAIN authentication failed:"),
    ("sys_dovecot_1", "192.0.2.3", "", "alert", "auth: passwd-file(u@example.org): unknown user"),
    ("sys_dovecot_1", "192.0.2.7", "", "alert", "auth-worker: sql(test): unknown user (given password: x)"),
    ("sys_dovecot_3", "192.0.2.8", "", "alert",
     "auth: login(?,192.0.2.8): Username character disallowed by auth_username_chars: 0x7d (username: }t)"),
    ("sys_dovecot_2", "192.0.2.8", "", "alert",
     "auth: login(u,192.0.2.8): Request timed out waiting for client to continue authentication (150 secs)"),
    ("conn_timeout", "192.0.2.9", "", "info", "timeout after AUTH"),
    ("conn_lost", "192.0.2.9", "", "info", "lost connection after DATA"),
    ("unparsed", "", "", "info", "something else"),
]


def test_mail_report(spark):
    lines = read_lines(spark, str(DATA / "mail.log"))
    report, rejects = mail_log(lines, 2023)
    assert rows(report, "kind", "ipaddr", "msgid", "severity", "content") == MAIL
    assert rejects.count() == 2
    assert rows(report, "date", "new_section", "process", "pid")[:5] == [
        ("2023-02-08", True, "postfix/smtpd", 7979),
        ("2023-02-09", True, "postfix/smtpd", 16298),
        ("2023-02-08", True, "postfix/smtpd", 7979),
        ("2023-02-08", False, "policyd-spf", 7986),
        ("2023-02-09", True, "policyd-spf(29735)", None),
    ]


def test_mail_state_comes_from_the_tail_only(spark):
    lines = read_lines(spark, str(DATA / "mail.log"))
    after_start = lines.where(F.col("seq") >= lines.where(F.col("value").contains("message-id")).first()["seq"])
    report, _ = mail_log(after_start, 2023, tail=lambda df: df)
    assert report.where("msgid = 'ABCDEF1234'").select("ipaddr").distinct().first()[0] == "**UNKNOWN**"


def test_odd_line_separators_stay_in_the_text(spark, lines_of):
    texts = [f"Feb  8 15:51:20 mx1 app[1]: ABCDEF1234: a{sep}b" for sep in (" ", "\u0085", "\r")]
    records, _ = parse_syslog(lines_of(texts), 2023)
    assert [r[0] for r in rows(classify_mail(records), "content")] == ["a b", "a\u0085b", "a\rb"]


def test_long_fields_do_not_exhaust_the_stack():
    """Runs in a process of its own, as a regression would end the JVM."""
    code = """
import sys; sys.path.insert(0, %r)
from fleetlens.session import local_session
from fleetlens.operators.access import parse_access
spark = local_session(1)
line = '192.0.2.1 - - [01/Mar/2023:00:00:00 +0000] "GET /%%s HTTP/1.1" 200 1 "-" "b" 5'
df = spark.createDataFrame([(line %% ('a' * 200000),), (line %% ('\\\\"' * 50000),)], 'value string')
print('rows', parse_access(df)[0].count())
""" % str(DATA.parent.parent)
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert "rows 2" in done.stdout, done.stderr[-2000:]


def test_long_run_of_letters_is_no_mail_line(spark, lines_of):
    start = time.perf_counter()
    lines = lines_of(["x" * 1_000_000, "Feb  8 15:51:20 mx a: " + "y" * 1_000_000, "junk xxFeb  8 15:51:20 mx b: c"])
    records, rejects = parse_syslog(lines, 2022)
    assert records.count() == 1 and rejects.count() == 2
    assert time.perf_counter() - start < 30
