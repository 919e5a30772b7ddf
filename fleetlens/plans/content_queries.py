"""Registered queries over duplicate content, repeated lines, backups and directory sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.json_text import json_pretty
from fleetlens.functions.labels import line_length, preview
from fleetlens.operators.duplicates import (
    dedup_plan,
    duplicate_count,
    duplicate_groups,
    duplicate_members,
    in_walk_order,
    number_files,
    reuse_digest,
    size_candidates,
)
from fleetlens.operators.purify import purified, purify, purify_stats
from fleetlens.operators.retention import retention_plan
from fleetlens.operators.usage import ascending, dir_usage, root_usage
from fleetlens.plans.registry import query, table
from fleetlens.plans.render import document_files, document_lines, page_files
from fleetlens.session import stored

FILES_SQL = """
WITH files AS (
  SELECT source AS root, lang || '/' || doc_id || '.txt' AS subpath, strlen(text)::BIGINT AS size,
    md5(text) AS md5, doc_id
  FROM documents),
members AS (
  SELECT *, count(*) OVER (PARTITION BY md5) AS n,
    row_number() OVER (PARTITION BY md5 ORDER BY root, string_split(subpath, '/')) AS place
  FROM files)
"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_files(table(spark, sf_dir, "documents"))


def _indexed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file rows with their digests, stored, so that the content is read and hashed once."""
    return stored(_files(spark, sf_dir), "files")


@query(
    "dup_candidates",
    f"""{FILES_SQL} SELECT root, subpath, size FROM files
        WHERE size IN (SELECT size FROM files GROUP BY size HAVING count(*) > 1)""",
)
def dup_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return size_candidates(_files(spark, sf_dir).select("root", "subpath", "size"))


@query(
    "dup_groups",
    f"""{FILES_SQL} SELECT md5, n, sum(size)::BIGINT AS bytes, arg_min(root, place) AS first_root,
        arg_min(subpath, place) AS first_subpath FROM members WHERE n > 1 GROUP BY md5, n""",
)
def dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(_files(spark, sf_dir))


@query("dup_members", f"{FILES_SQL} SELECT root, subpath, size, md5, n FROM members WHERE n > 1")
def dup_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _indexed_files(spark, sf_dir).select("root", "subpath", "size", "md5")
    return in_walk_order(duplicate_members(files))


@query("dup_count", f"{FILES_SQL} SELECT count(DISTINCT md5) AS groups FROM members WHERE n > 1")
def dup_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_count(_files(spark, sf_dir))


@query(
    "dup_plan",
    f"""{FILES_SQL} SELECT root, subpath, md5, n, CASE WHEN place = 1 THEN 'keep' ELSE 'delete' END AS action
        FROM members WHERE n > 1""",
)
def dup_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_plan(_indexed_files(spark, sf_dir)).select("root", "subpath", "md5", "n", "action")


@query(
    "dup_plan_third",
    f"""{FILES_SQL} SELECT root, subpath, md5, n, CASE WHEN n < 3 THEN 'skip' WHEN place = 3 THEN 'keep'
        ELSE 'delete' END AS action FROM members WHERE n > 1""",
)
def dup_plan_third(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_plan(_indexed_files(spark, sf_dir), keep=3).select("root", "subpath", "md5", "n", "action")


def _numbered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number_files(_indexed_files(spark, sf_dir))


@query(
    "dup_groups_numbered",
    f"""{FILES_SQL} SELECT md5, n, sum(size)::BIGINT AS bytes, arg_min(root, place) AS first_root,
        arg_min(subpath, place) AS first_subpath FROM members WHERE n > 1 GROUP BY md5, n""",
)
def dup_groups_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(_numbered_files(spark, sf_dir))


@query(
    "dup_plan_numbered",
    f"""{FILES_SQL} SELECT root, subpath, md5, n, CASE WHEN place = 1 THEN 'keep' ELSE 'delete' END AS action
        FROM members WHERE n > 1""",
)
def dup_plan_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_plan(_numbered_files(spark, sf_dir)).select("root", "subpath", "md5", "n", "action")


@query(
    "dup_incremental",
    f"""{FILES_SQL} SELECT root, subpath, toxic IS NOT NULL AND toxic = 0 AS reused,
          CASE WHEN toxic = 0 THEN reverse(md5) ELSE md5 END AS md5
        FROM files LEFT JOIN labels USING (doc_id)
        WHERE size IN (SELECT size FROM files GROUP BY size HAVING count(*) > 1)""",
)
def dup_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier index holds the labelled documents; toxic ones have changed since.

    Its digests are written backwards, which shows where a digest was taken over.
    """
    files = _indexed_files(spark, sf_dir)
    changed = F.when(F.col("toxic") == 1, F.expr("mtime - interval 1 day")).otherwise(F.col("mtime"))
    previous = files.join(table(spark, sf_dir, "labels"), "doc_id").select(
        "root", "subpath", "size", changed.alias("mtime"), F.reverse("md5").alias("md5")
    )
    current = size_candidates(files.withColumnRenamed("md5", "fresh"))
    joined = reuse_digest(current, previous)
    return joined.select(
        "root", "subpath", F.col("md5").isNotNull().alias("reused"), F.coalesce("md5", "fresh").alias("md5")
    )


LINES_SQL = r"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
lines AS (
  SELECT doc_id, unnest(parts) AS value, unnest(range(len(parts)))::BIGINT AS pos FROM split),
marked AS (
  SELECT *, strlen(value) > 3000 AS long,
    row_number() OVER (PARTITION BY value ORDER BY doc_id, pos) AS occurrence
  FROM lines)
"""


@query(
    "purify",
    f"""{LINES_SQL} SELECT doc_id, pos, strlen(value)::INTEGER AS length,
          CASE WHEN strlen(value) > 60 THEN substr(value, 1, 60) || '...[TRIMMED]' ELSE value END AS preview,
          CASE WHEN long THEN 'TLL' WHEN occurrence = 1 THEN '---' ELSE 'DUP' END AS status
        FROM marked""",
)
def purify_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = purify(document_lines(table(spark, sf_dir, "documents")))
    value = F.col("value")
    return rows.select(
        F.col("block_start").alias("doc_id"),
        F.col("seq").alias("pos"),
        line_length(value).alias("length"),
        preview(value).alias("preview"),
        "status",
    )


@query("purified_lines", f"{LINES_SQL} SELECT doc_id, pos, value FROM marked WHERE NOT long AND occurrence = 1")
def purified_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = purified(document_lines(table(spark, sf_dir, "documents")))
    return kept.select(F.col("block_start").alias("doc_id"), F.col("seq").alias("pos"), "value")


@query(
    "purify_stats",
    f"""{LINES_SQL} SELECT count(*) AS processed, count_if(NOT long AND occurrence > 1)::BIGINT AS duplicates,
        count_if(long)::BIGINT AS long, count_if(NOT long AND occurrence = 1)::BIGINT AS preserved FROM marked""",
)
def purify_stats_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return purify_stats(document_lines(table(spark, sf_dir, "documents")))


@query(
    "retention",
    """WITH ranked AS (
         SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) > 12 AS rotated,
           date_diff('day', o_orderdate, (SELECT max(o_orderdate) FROM orders)) > 15 AS expired
         FROM orders)
       SELECT o_custkey AS host, o_orderkey AS file, rotated, expired,
         CASE WHEN rotated OR expired THEN 'delete' ELSE 'keep' END AS action FROM ranked""",
)
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as backup files of their customer."""
    orders = table(spark, sf_dir, "orders")
    now = orders.agg(F.max("o_orderdate")).first()[0]
    files = orders.select(
        F.col("o_custkey").alias("host"),
        F.lit("auto").alias("dir"),
        F.col("o_orderkey").alias("file"),
        F.col("o_orderdate").alias("mtime"),
    )
    return retention_plan(files, str(now)).select("host", "file", "rotated", "expired", "action")


PAGES_SQL = r"""
WITH files AS (
  SELECT split_part(url, '/', 3) AS root, regexp_replace(url, '^[a-z]+://[^/]+/|[?#].*$', '', 'g') AS subpath,
    strlen(html) AS size
  FROM pages)
"""


@query(
    "dir_usage",
    f"""{PAGES_SQL} SELECT root, split_part(subpath, '/', 1) AS dir, sum(size)::BIGINT AS bytes FROM files
        WHERE contains(subpath, '/') GROUP BY ALL
        UNION ALL SELECT root, '.', sum(size)::BIGINT FROM files GROUP BY root""",
)
def dir_usage_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ascending(dir_usage(page_files(table(spark, sf_dir, "pages"))))


@query(
    "root_usage",
    f"""{PAGES_SQL} SELECT root, split_part(subpath, '/', 1) AS entry, sum(size)::BIGINT AS bytes FROM files
        WHERE split_part(subpath, '/', 1) NOT IN ('proc', 'dev', 'sys', 'fr') GROUP BY ALL""",
)
def root_usage_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = page_files(table(spark, sf_dir, "pages"))
    return ascending(root_usage(files, exclude=("proc", "dev", "sys", "fr")))


@query(
    "json_pretty",
    """SELECT event_id, '{' || chr(10) || '    "k": ' || (props->>'k') || chr(10) || '}' AS pretty FROM events""",
)
def json_pretty_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", json_pretty(F.col("props")).alias("pretty"))
