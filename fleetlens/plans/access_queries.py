"""Registered queries over web access logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators.access import apply_filters, label_access, parse_access, parse_request, prefilter_lines
from fleetlens.operators.lines import mark_sections, route_lines, tail_bytes, tail_lines, with_offsets
from fleetlens.plans.registry import query, table
from fleetlens.plans.render import access_lines
from fleetlens.session import stored

# The columns that the rendered access lines stand for, straight from the raw table.
ACCESS_SQL = r"""
WITH raw AS (
  SELECT event_id, user_id, event_type, ts,
    CASE WHEN event_id % 13 = 0 THEN '2a01::' || printf('%x', user_id + 1)
      ELSE printf('10.%d.%d.%d', user_id % 4, event_id % 200, user_id % 250) END AS ip,
    CASE WHEN event_id % 3 = 0 THEN '' ELSE 'u' || user_id END AS "user",
    CASE WHEN event_id % 4 = 0 THEN '' ELSE 'TLSv1.3' END AS proto,
    strftime(ts, '%d/%b/%Y') AS date, strftime(ts, '%H:%M:%S') AS time,
    epoch(date_trunc('second', ts))::BIGINT AS stamp,
    '"GET /' || event_type || CASE WHEN event_id % 2 = 0 THEN '?k=' || event_id ELSE '' END
      || CASE WHEN event_id % 17 = 0 THEN ' HTTP/2.0"' ELSE ' HTTP/1.1"' END AS req,
    CASE event_type WHEN 'click' THEN 200 WHEN 'view' THEN 204 WHEN 'purchase' THEN 302
      WHEN 'signup' THEN 404 ELSE 500 END::BIGINT AS status,
    CASE WHEN event_id % 19 = 0 THEN 0 ELSE round(value * 100)::BIGINT * 500 END AS size,
    CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 3 > 0 THEN ''
      ELSE 'https://www.example.org/' || event_type END AS referer,
    CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 23 = 0 THEN 'agent \"q\" x'
      ELSE 'Mozilla/5.0 (u' || user_id || ')' END AS agent,
    CASE WHEN event_id % 7 < 2 THEN NULL
      ELSE round(((event_id * 7919) % 120000000) / 1000.0)::BIGINT END AS duration_ms
  FROM events),
access AS (
  SELECT *, CASE WHEN event_id % 5 = 1 THEN '172.16.0.' || (event_id % 250) ELSE '' END AS peer
  FROM raw)
"""
FIELDS = "event_id stamp peer ip user proto date time req status size referer agent duration_ms".split()
FIELDS_SQL = ", ".join(f'"{f}"' for f in FIELDS)


def _lines(spark: SparkSession, sf_dir: str, closing: Column | None = None) -> DataFrame:
    return access_lines(table(spark, sf_dir, "events"), closing)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _ = parse_access(route_lines(_lines(spark, sf_dir))[0])
    return records


def _as_seconds(records: DataFrame) -> DataFrame:
    return records.withColumn("stamp", F.unix_timestamp("stamp"))


@query("access_parse", f"{ACCESS_SQL} SELECT {FIELDS_SQL} FROM access")
def access_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_seconds(_records(spark, sf_dir)).select(*FIELDS)


@query(
    "access_rejects",
    """SELECT event_id, 'access/' || user_id AS file_path, 'line' AS stage FROM events
       WHERE event_id % 11 = 0""",
)
def access_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = F.when(F.col("event_id") % 11 == 0, "").otherwise("]")
    _, rejects = parse_access(_lines(spark, sf_dir, damaged))
    return rejects.select("event_id", "file_path", "stage")


@query(
    "access_request",
    f"""{ACCESS_SQL} SELECT event_id, event_id % 17 = 0 AS malformed,
        CASE WHEN event_id % 17 > 0 THEN 'GET' END AS method,
        CASE WHEN event_id % 17 > 0 THEN '/' || event_type END AS path,
        CASE WHEN event_id % 17 > 0 THEN CASE WHEN event_id % 2 = 0 THEN '?k=' || event_id ELSE '' END
          END AS query,
        CASE WHEN event_id % 17 > 0 THEN '1.1' END AS http_version FROM access""",
)
def access_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = _records(spark, sf_dir).select("event_id", parse_request(F.col("req")).alias("r"))
    return parsed.select("event_id", "r.*")


@query(
    "request_parse_urls",
    r"""WITH t AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]+', '') AS target FROM pages)
        SELECT page_id, 'GET' AS method,
          CASE WHEN strpos(target, '?') > 1 THEN split_part(target, '?', 1) ELSE target END AS path,
          CASE WHEN strpos(target, '?') > 1 THEN substr(target, strpos(target, '?')) ELSE '' END AS query,
          '1.1' AS http_version, false AS malformed FROM t""",
)
def request_parse_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = F.regexp_replace("url", "(?d)^[a-z]+://[^/]+", "")
    request = F.concat(F.lit('"GET '), target, F.lit(' HTTP/1.1"'))
    pages = table(spark, sf_dir, "pages").select("page_id", request.alias("req"))
    return pages.select("page_id", parse_request(F.col("req")).alias("r")).select("page_id", "r.*")


@query(
    "access_filter_and_or",
    f"""{ACCESS_SQL} SELECT {FIELDS_SQL} FROM access
        WHERE status IN (404, 500) AND size >= 1000000 AND size <= 20000000
          AND (contains(req, 'sign') OR contains(req, '?k=1')) AND contains(ip, '10.')
          AND (starts_with(time, '0') OR starts_with(time, '12:'))""",
)
def access_filter_and_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = [
        "status=404,500", "minsize=1000000", "maxsize=20000000", "url=sign,?k=1", "ip=10.", "time=0,12:",
    ]
    lines = prefilter_lines(route_lines(_lines(spark, sf_dir))[0], filters)
    records, _ = parse_access(lines)
    return _as_seconds(apply_filters(records, filters)).select(*FIELDS)


@query(
    "access_filter_peer",
    f"{ACCESS_SQL} SELECT {FIELDS_SQL} FROM access WHERE contains(peer, '172.16.0.1') AND contains(req, 'click')",
)
def access_filter_peer(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = ["peer=172.16.0.1", ("req", ["click"])]
    return _as_seconds(apply_filters(_records(spark, sf_dir), filters)).select(*FIELDS)


@query("access_filter_unknown", f"{ACCESS_SQL} SELECT {FIELDS_SQL} FROM access WHERE false")
def access_filter_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = ["status=200", "colour=red"]
    return _as_seconds(apply_filters(_records(spark, sf_dir), filters)).select(*FIELDS)


def labels_sql(net: str | None = None) -> str:
    """The display classes of the access columns; ``net`` is the network label column, if any."""
    flag = f"CASE WHEN {net} IS NOT NULL THEN '@' WHEN peer <> '' THEN '>' ELSE '' END"
    plain_flag = "CASE WHEN peer <> '' THEN '>' ELSE '' END"
    return f"""
  CASE WHEN status = 200 THEN 'ok' WHEN status // 100 = 2 THEN 'success'
    WHEN status // 100 = 3 THEN 'redirect' ELSE 'problem' END AS status_class,
  CASE WHEN size = 0 THEN '  - ' WHEN size / 1024.0 < 0.5 THEN '  < '
    WHEN size / 1024.0 < 999.5 THEN printf('%3.0fk', round(size / 1024.0))
    WHEN size / 1048576.0 < 9.95 THEN printf('%3.1fM', round(size / 1048576.0::DOUBLE, 1))
    ELSE printf('%3.0fM', round(size / 1048576.0)) END AS size_label,
  CASE WHEN coalesce(duration_ms, 0) = 0 THEN '  -   '
    WHEN duration_ms < 10000 THEN printf('%4dms', duration_ms)
    WHEN duration_ms < 99950 THEN printf('%4.1fs ', duration_ms / 1000.0::DOUBLE)
    ELSE printf('%4ds ', round(duration_ms / 1000.0)::BIGINT) END AS duration_label,
  CASE WHEN duration_ms >= 10000 THEN 'critical' WHEN duration_ms > 1499 THEN 'slow'
    WHEN duration_ms > 299 THEN 'warn' ELSE 'normal' END AS duration_band,
  {flag if net else plain_flag} AS origin_flag,
  {f"coalesce({net}, ip)" if net else "ip"} AS client, CASE WHEN proto = '' THEN 'PLAIN' ELSE proto END AS protocol
"""


@query("access_labels", f"{ACCESS_SQL} SELECT event_id, {labels_sql()} FROM access")
def access_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_access(_records(spark, sf_dir)).select(
        "event_id", "status_class", "size_label", "duration_label", "duration_band", "origin_flag",
        "client", "protocol",
    )


@query(
    "access_sections",
    f"""{ACCESS_SQL} SELECT event_id, date,
        coalesce(lag(date) OVER (PARTITION BY user_id ORDER BY event_id) <> date, true) AS new_section
        FROM access WHERE status <> 200""",
)
def access_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = apply_filters(_records(spark, sf_dir), [("status", ["204", "302", "404", "500"])])
    needed = records.select("event_id", "file_path", "block_start", "seq", "date")
    return mark_sections(stored(needed, "sections")).select("event_id", "date", "new_section")


# The rendered line itself, for byte positions.
LINE_SQL = ACCESS_SQL + r""", lines AS (
  SELECT event_id, user_id,
    CASE WHEN event_id % 5 = 0 THEN ip || '>' WHEN event_id % 5 = 1 THEN peer || '>' ELSE '' END || ip || ' '
    || CASE WHEN "user" = '' THEN '-' ELSE "user" END || ' '
    || CASE WHEN proto = '' THEN '-' ELSE proto END || ' [' || date || ':' || time || ' +0000] ' || req
    || ' ' || status || ' ' || CASE WHEN event_id % 19 = 0 THEN '-' ELSE size::VARCHAR END
    || CASE WHEN referer IS NULL THEN '' ELSE
         CASE WHEN event_id % 3 = 1 THEN ' "-"' ELSE ' "' || referer || '"' END
         || ' "' || agent || '"' || CASE WHEN event_id % 7 = 1 THEN ''
         ELSE ' ' || ((event_id * 7919) % 120000000) END END AS line
  FROM access),
placed AS (
  SELECT *, strlen(line) + 1 AS n_bytes,
    coalesce(sum(strlen(line) + 1) OVER (PARTITION BY user_id ORDER BY event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS line_offset,
    sum(strlen(line) + 1) OVER (PARTITION BY user_id)::BIGINT AS file_size,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS from_end
  FROM lines)
"""


@query("line_offsets", f"{LINE_SQL} SELECT event_id, line, line_offset FROM placed")
def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = with_offsets(_lines(spark, sf_dir), "line_offset")
    return placed.select("event_id", F.col("value").alias("line"), "line_offset")


@query("tail_bytes", f"{LINE_SQL} SELECT event_id, line FROM placed WHERE line_offset >= file_size - 2048")
def tail_bytes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = tail_bytes(_lines(spark, sf_dir), "2k")
    return tail.select("event_id", F.col("value").alias("line"))


@query("tail_lines", f"{LINE_SQL} SELECT event_id, line FROM placed WHERE from_end <= 5")
def tail_lines_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = tail_lines(_lines(spark, sf_dir))
    return tail.select("event_id", F.col("value").alias("line"))
