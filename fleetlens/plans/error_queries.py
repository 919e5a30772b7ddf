"""Registered queries over web error logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators.errors import flag_noise, parse_error
from fleetlens.operators.lines import route_lines
from fleetlens.plans.pipelines import error_log
from fleetlens.plans.registry import query, table
from fleetlens.plans.render import error_lines

ERROR_SQL = r"""
WITH raw AS (
  SELECT event_id, user_id, ts,
    CASE event_id % 5 WHEN 0 THEN 'ssl' WHEN 1 THEN 'core' WHEN 2 THEN 'php7' WHEN 3 THEN ''
      ELSE 'reqtimeout' END AS channel,
    CASE WHEN event_id % 2 = 0 THEN 'info' ELSE 'error' END AS level,
    CASE WHEN event_id % 37 = 36 THEN 'line' WHEN event_id % 31 = 30 THEN 'datetime'
      WHEN event_id % 3 > 0 AND event_id % 29 = 28 THEN 'client' END AS stage
  FROM events),
error AS (
  SELECT *, strftime(ts, '%d/%b/%Y') AS date, strftime(ts, '%H:%M:%S') AS time,
    epoch(date_trunc('second', ts))::BIGINT AS stamp, (1000 + user_id)::BIGINT AS pid,
    CASE WHEN event_id % 4 = 0 THEN event_id * 31 END::BIGINT AS tid,
    CASE WHEN event_id % 3 > 0 THEN CASE WHEN event_id % 13 = 0 THEN '2a01::' || printf('%x', user_id + 1)
      ELSE printf('10.%d.%d.%d', user_id % 4, event_id % 200, user_id % 250) END END AS ip,
    CASE WHEN event_id % 3 > 0 THEN 1024 + event_id % 60000 END::BIGINT AS port,
    CASE event_id % 9 WHEN 0 THEN 'AH01964: Connection to child ' || event_id || ' established'
      WHEN 1 THEN 'AH01998: Connection closed to child' WHEN 2 THEN 'AH01991: SSL input filter'
      WHEN 3 THEN 'AH01993: SSL output filter' WHEN 4 THEN 'AH01382: Request header read timeout'
      WHEN 5 THEN 'script ''/srv/a.php'' not found or unable to stat'
      WHEN 6 THEN 'AH00128: File does not exist: /srv/b'
      WHEN 7 THEN 'Notice:  undefined index k' || event_id ELSE 'late AH01382: not at the start' END AS message,
    CASE event_id % 9 WHEN 0 THEN channel = 'ssl' AND level = 'info' WHEN 1 THEN channel = 'ssl' AND level = 'info'
      WHEN 2 THEN channel = 'ssl' AND level = 'info' WHEN 3 THEN channel = 'ssl' AND level = 'info'
      WHEN 4 THEN channel = 'reqtimeout' AND level = 'info' WHEN 5 THEN channel = 'php7' AND level = 'error'
      WHEN 6 THEN channel = 'core' AND level = 'info' ELSE false END AS noise
  FROM raw)
"""


def _parsed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return parse_error(route_lines(error_lines(table(spark, sf_dir, "events")))[0])


@query(
    "error_parse",
    f"""{ERROR_SQL} SELECT event_id, stamp, date, time, channel, level, pid, tid, ip, port, message
        FROM error WHERE stage IS NULL""",
)
def error_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _ = _parsed(spark, sf_dir)
    return records.withColumn("stamp", F.unix_timestamp("stamp")).select(
        "event_id", "stamp", "date", "time", "channel", "level", "pid", "tid", "ip", "port", "message"
    )


@query("error_rejects", f"{ERROR_SQL} SELECT event_id, stage FROM error WHERE stage IS NOT NULL")
def error_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir)[1].select("event_id", "stage")


@query("error_noise", f"{ERROR_SQL} SELECT event_id, noise FROM error WHERE stage IS NULL")
def error_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_noise(_parsed(spark, sf_dir)[0]).select("event_id", "noise")


@query(
    "error_report",
    f"""{ERROR_SQL} SELECT event_id, date, time, ip, level, channel, message,
        coalesce(lag(date) OVER (PARTITION BY user_id % 10 ORDER BY event_id) <> date, true) AS new_section
        FROM error WHERE stage IS NULL AND NOT noise""",
)
def error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report, _ = error_log(error_lines(table(spark, sf_dir, "events")), drop_noise=True)
    return report.select(
        "event_id", "date", "time", "ip", "level", "channel", "message", "new_section"
    )
