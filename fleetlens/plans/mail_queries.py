"""Registered queries over mail logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetlens.operators.lines import route_lines, tail_start
from fleetlens.operators.mail import classify_mail, drop_statistics, enrich_msgid, parse_syslog
from fleetlens.plans.pipelines import mail_log
from fleetlens.plans.registry import query, table
from fleetlens.plans.render import mail_lines, session_lines
from fleetlens.session import stored

YEAR = 2022

MAIL_SQL = r"""
WITH raw AS (
  SELECT *, (l_orderkey * 7 + l_linenumber * 3 + l_partkey) % 18 AS k,
    'h' || l_partkey || '.example.org' AS h,
    printf('10.%d.%d.%d', l_suppkey % 250, l_partkey % 250, l_linenumber) AS ip,
    upper(substr(md5(l_orderkey::VARCHAR), 1, 10)) AS id
  FROM lineitem),
mail AS (
  SELECT *, '2022' || strftime(l_shipdate, '-%m-%d') AS date,
    printf('%02d:%02d:%02d', l_suppkey % 24, l_partkey % 60, l_orderkey % 60) AS time,
    'mx' || (l_suppkey % 50) AS host,
    CASE WHEN k BETWEEN 10 AND 12 THEN 'dovecot' WHEN k = 6 THEN 'policyd-spf(' || l_linenumber || ')'
      ELSE 'postfix/smtpd' END AS process,
    CASE WHEN k NOT IN (6, 10, 11, 12) THEN l_partkey END::BIGINT AS pid,
    ['conn_prewarn', 'conn_start', 'conn_auth_fail', 'conn_lost', 'conn_timeout', 'conn_end', 'conn_spf',
     'conn_reject_rcpt', 'msg_start', 'msg_generic', 'sys_dovecot_1', 'sys_dovecot_2', 'sys_dovecot_3',
     'anvil_stats_1', 'anvil_stats_2', 'anvil_stats_3', 'unparsed', 'reject'][k + 1] AS kind,
    CASE WHEN k = 9 THEN NULL WHEN k < 13 THEN ip ELSE '' END AS ipaddr,
    CASE WHEN k IN (8, 9) THEN id ELSE '' END AS msgid,
    CASE WHEN k IN (1, 5) THEN 'notice' WHEN k IN (10, 11, 12) THEN 'alert' ELSE 'info' END AS severity,
    CASE k WHEN 0 THEN 'hostname [' || h || '] does not resolve back'
        || CASE WHEN l_linenumber % 2 = 0 THEN ' (Name or service not known)' ELSE '' END
      WHEN 1 THEN 'connect from ' || h
      WHEN 2 THEN 'warning: unknown[' || ip || ']: SASL LOGIN authentication failed: UGFz'
      WHEN 3 THEN 'lost connection after AUTH'
      WHEN 4 THEN 'timeout after DATA'
      WHEN 5 THEN 'disconnect from ' || h || ' ehlo=1 commands=' || l_linenumber
      WHEN 6 THEN 'result=Pass; idnt=mailfrom; helo=' || h || '; from=a@example.org; recv=b@example.net'
      WHEN 7 THEN 'NOQUEUE: reject RCPT: 550 5.7.1 rejected'
      WHEN 8 THEN 'client=' || h || ', sasl_method=LOGIN'
      WHEN 9 THEN 'from=<a@example.org>, size=' || l_partkey || ', nrcpt=1 (queue active)'
      WHEN 10 THEN CASE WHEN l_linenumber % 2 = 0 THEN 'auth: passwd-file' ELSE 'auth-worker: sql' END
        || '(user' || l_suppkey || '): unknown user'
      WHEN 11 THEN 'auth: login(user,' || ip
        || '): Request timed out waiting for client to continue authentication (150 secs)'
      WHEN 12 THEN 'auth: login(?,' || ip
        || '): Username character disallowed by auth_username_chars: 0x7d (username: }x)'
      WHEN 16 THEN 'statistics: other text ' || l_partkey ELSE '' END AS content
  FROM raw)
"""


def _parsed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = mail_lines(table(spark, sf_dir, "lineitem"))
    return parse_syslog(route_lines(lines)[0], YEAR)


@query(
    "mail_classify",
    f"""{MAIL_SQL} SELECT l_orderkey, l_linenumber, date, time, host, process, pid, kind, ipaddr, msgid,
        severity, content FROM mail WHERE k < 17""",
)
def mail_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_mail(_parsed(spark, sf_dir)[0]).select(
        "l_orderkey", "l_linenumber", "date", "time", "host", "process", "pid", "kind", "ipaddr", "msgid",
        "severity", "content",
    )


@query(
    "mail_rejects",
    f"""{MAIL_SQL} SELECT l_orderkey, l_linenumber, 'mail/' || host AS file_path, 'syslog' AS stage
        FROM mail WHERE k = 17""",
)
def mail_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir)[1].select("l_orderkey", "l_linenumber", "file_path", "stage")


SESSION_SQL = r"""
WITH raw AS (
  SELECT *, upper(substr(md5(user_id::VARCHAR), 1, 10)) AS id,
    CASE WHEN event_type = 'signup' AND user_id % 7 > 0
      THEN printf('10.%d.0.%d', event_id % 200, user_id % 250) END AS client,
    '2022' || strftime(ts, '-%m-%d') AS date
  FROM events),
carried AS (
  SELECT *, last_value(client IGNORE NULLS) OVER (PARTITION BY id ORDER BY event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS known
  FROM raw WHERE event_type IN ('signup', 'click', 'view')),
session AS (
  SELECT event_id, user_id, date, strftime(ts, '%H:%M:%S') AS time, id AS msgid,
    coalesce(known, '**UNKNOWN**') AS ipaddr,
    CASE WHEN client IS NOT NULL THEN 'msg_start' ELSE 'msg_generic' END AS kind,
    CASE WHEN client IS NOT NULL THEN 'client=h' || user_id WHEN event_type = 'signup' THEN 'no client'
      ELSE event_type || ' ' || event_id END AS content
  FROM carried
  UNION ALL
  SELECT event_id, user_id, date, strftime(ts, '%H:%M:%S'), '', '10.0.0.' || (user_id % 250), 'conn_start',
    'connect from h' || user_id
  FROM raw WHERE event_type = 'purchase')
"""


def session_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = session_lines(table(spark, sf_dir, "events"))
    return classify_mail(parse_syslog(route_lines(lines)[0], YEAR)[0])


@query("mail_enrich", f"{SESSION_SQL} SELECT event_id, kind, msgid, ipaddr, content FROM session")
def mail_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = stored(drop_statistics(session_records(spark, sf_dir)), "sessions")
    return enrich_msgid(records).select("event_id", "kind", "msgid", "ipaddr", "content")


@query(
    "mail_report",
    f"""{SESSION_SQL} SELECT event_id, date, time, ipaddr, msgid, content,
        coalesce(lag(date) OVER (PARTITION BY user_id % 3 ORDER BY event_id) <> date, true) AS new_section
        FROM session""",
)
def mail_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = session_lines(table(spark, sf_dir, "events"))
    report, _ = mail_log(lines, YEAR, tail=tail_start, scope=["host"])
    return report.select(
        "event_id", "date", "time", "ipaddr", "msgid", "content", "new_section"
    )
