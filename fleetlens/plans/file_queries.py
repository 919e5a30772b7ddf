"""Registered queries that write the tables as files below the shared folder and read them back.

They run the readers, writers and sorted outputs that the other queries, which render lines in
place, do not touch.
"""

from __future__ import annotations

from datetime import datetime
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.operators.aliases import in_order, read_aliases
from fleetlens.operators.duplicates import in_walk_order
from fleetlens.operators.lines import route_lines
from fleetlens.operators.network import lookup_network, network_union
from fleetlens.operators.snapshots import by_mount, parse_container_meta, read_disk_snapshot, resolve_mounts
from fleetlens.operators.usage import ascending, dir_usage
from fleetlens.plans.access_queries import ACCESS_SQL, LINE_SQL
from fleetlens.plans.content_queries import FILES_SQL, PAGES_SQL
from fleetlens.plans.host_queries import ALIASES_SQL
from fleetlens.plans.network_queries import group_feeds
from fleetlens.plans.pipelines import log_lines
from fleetlens.plans.registry import query, table
from fleetlens.plans.render import (
    access_lines,
    alias_lines,
    container_meta,
    disk_lines,
    document_files,
    event_ip,
    page_files,
    write_images,
)
from fleetlens.plans.stream_queries import finished
from fleetlens.session import shared_folder, stored
from fleetlens.sources.files import read_image_manifest, read_index, read_manifest, write_index
from fleetlens.sources.follow import follow_lines
from fleetlens.sources.follow_log import follow_many
from fleetlens.sources.lines import read_lines, stream_lines
from fleetlens.sources.networks import cidr_table, read_cidr_json, read_cidr_text, write_cidr_table
from fleetlens.sources.sinks import write_by_name, write_lines
from fleetlens.sources.walk import walk_files

NOW = datetime(2024, 1, 1)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/files/{name}-{uuid4().hex}"


def positions(ordered: DataFrame, name: str) -> DataFrame:
    """Add ``position`` from 1 on to the rows of a sorted frame: number inside partitions, then shift."""
    rows = stored(
        ordered.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), name
    )
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))  # a row per task
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    position = F.col("_before") + F.col("_row") - F.col("_first") + 1
    return rows.join(starts, "_part").select(*ordered.columns, position.alias("position"))


# Lines


def _event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access_lines(table(spark, sf_dir, "events"))


def _written_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per log; their manifest."""
    folder = new_folder(spark, "logs")
    rows = _event_lines(spark, sf_dir).select(F.element_at(F.split("file_path", "/"), -1).alias("name"), "seq", "value")
    write_by_name(rows, folder)
    return walk_files(spark, [folder])


@query("files_lines", f"{LINE_SQL} SELECT line FROM lines")
def files_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "lines")
    write_lines(_event_lines(spark, sf_dir), folder)
    return read_lines(spark, folder).select(F.col("value").alias("line"))


@query("files_streamed", f"{LINE_SQL} SELECT line FROM lines")
def files_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "streamed")
    write_lines(_event_lines(spark, sf_dir), folder)
    return finished(stream_lines(spark, folder).select(F.col("value").alias("line")), "streamed")


@query("files_followed", f"{LINE_SQL} SELECT line FROM lines")
def files_followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "followed")
    write_lines(_event_lines(spark, sf_dir), folder)
    return finished(follow_lines(spark, folder).select(F.col("value").alias("line")), "followed")


@query("files_followed_log", f"{LINE_SQL} SELECT line FROM lines")
def files_followed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "followed")
    write_lines(_event_lines(spark, sf_dir), folder)
    lines = follow_many(spark, folder, new_folder(spark, "manifests"))
    return finished(lines.select(F.col("value").alias("line")), "followed")


@query("files_tail_bytes", f"{LINE_SQL} SELECT line FROM placed WHERE line_offset >= file_size - 2048")
def files_tail_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_lines(spark, _written_logs(spark, sf_dir), last_bytes="2k").select(F.col("value").alias("line"))


@query("files_tail_lines", f"{LINE_SQL} SELECT line FROM placed WHERE from_end <= 5")
def files_tail_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_lines(spark, _written_logs(spark, sf_dir), last_lines=5).select(F.col("value").alias("line"))


@query(
    "lines_routed",
    """SELECT event_id, event_id % 10 = 3 AS passed, CASE event_id % 10 WHEN 1 THEN '# ' || event_type
         WHEN 3 THEN '' ELSE event_type END AS line FROM events WHERE event_id % 10 <> 2 AND event_id % 10 <> 1
       UNION ALL SELECT event_id, TRUE, '# ' || event_type FROM events WHERE event_id % 10 = 1""",
)
def lines_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.expr(
        """CASE event_id % 10 WHEN 1 THEN concat('# ', event_type) WHEN 2 THEN concat('= ', event_type)
             WHEN 3 THEN '' ELSE event_type END"""
    )
    lines = table(spark, sf_dir, "events").select("event_id", value.alias("value"))
    records, passthrough = route_lines(lines)
    both = records.withColumn("passed", F.lit(False)).unionByName(passthrough.withColumn("passed", F.lit(True)))
    return both.select("event_id", "passed", F.col("value").alias("line"))


# Networks


@query(
    "feeds_cached",
    """SELECT printf('10.%d.%d.0/24', c_nationkey, c_custkey % 250) AS cidr, 'cloudflare' AS label,
         'cloudflare' AS net_group FROM customer
       UNION ALL SELECT printf('20.%d.%d.0/24', s_nationkey, s_suppkey % 250), 'google:bot', 'google:bot' FROM supplier
       UNION ALL SELECT printf('2a01:%x::/32', s_suppkey), 'google:bot', 'google:bot' FROM supplier""",
)
def feeds_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "feeds")
    text = table(spark, sf_dir, "customer").selectExpr(
        "concat(' 10.', c_nationkey, '.', c_custkey % 250, '.0/24\t', if(c_custkey % 3 = 0, '\n', '')) AS value"
    )
    text.write.text(f"{folder}/text")
    entries = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey % 16 AS part",
        "array(named_struct('ipv4Prefix', concat('20.', s_nationkey, '.', s_suppkey % 250, '.0/24'), 'ipv6Prefix', "
        "cast(null AS string)), named_struct('ipv4Prefix', cast(null AS string), 'ipv6Prefix', "
        "concat('2a01:', lower(hex(s_suppkey)), '::/32'))) AS entries",
    )
    feeds = entries.groupBy("part").agg(F.to_json(F.struct(F.flatten(F.collect_list("entries")).alias("prefixes"))).alias("value"))
    feeds.repartition("part").write.partitionBy("part").text(f"{folder}/json")  # a file holds one feed
    cached = {
        "cloudflare": read_cidr_text(spark, f"{folder}/text", "cloudflare"),
        "google:bot": read_cidr_json(spark, f"{folder}/json", "google:bot"),
    }
    write_cidr_table(cached, f"{folder}/cache", NOW)
    return cidr_table(spark, f"{folder}/cache", NOW).select("cidr", "label", "net_group")


@query(
    "net_local",
    f"""{ACCESS_SQL} SELECT event_id, CASE event_id % 11 WHEN 0 THEN 'localhost' WHEN 1 THEN 'localhost' END AS net_label
        FROM access""",
)
def net_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    ip = F.expr("CASE event_id % 11 WHEN 0 THEN '127.0.0.1' WHEN 1 THEN '::1' END")
    rows = table(spark, sf_dir, "events").select("event_id", F.coalesce(ip, event_ip()).alias("ip"))
    nets = network_union(spark, ["local"], group_feeds(spark, sf_dir))
    return lookup_network(rows, "ip", nets).select("event_id", "net_label")


# File trees


def _written_tree(spark: SparkSession, sf_dir: str) -> str:
    """The documents as one file per source."""
    folder = new_folder(spark, "tree")
    rows = table(spark, sf_dir, "documents").selectExpr("source", "coalesce(text, '') AS value").repartition("source")
    rows.write.partitionBy("source").option("lineSep", "\n").text(folder)
    return folder


@query(
    "files_index",
    """SELECT 'source=' || source AS folder, (sum(strlen(coalesce(text, '')) + 1))::BIGINT AS size FROM documents
       GROUP BY source""",
)
def files_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _written_tree(spark, sf_dir)
    index = new_folder(spark, "index")
    files = read_manifest(spark, [tree]).where("subpath LIKE '%/part-%'")
    write_index(files.withColumn("md5", F.lit(None).cast("string")), index, NOW)
    return read_index(spark, index).select(F.split("subpath", "/")[0].alias("folder"), "size")


@query(
    "files_images",
    """SELECT s_suppkey || '.png' AS name, CASE WHEN s_suppkey % 7 > 0 THEN (s_suppkey % 50 + 1)::INTEGER END AS width,
         CASE WHEN s_suppkey % 7 > 0 THEN (s_nationkey + 1)::INTEGER END AS height FROM supplier""",
)
def files_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "images")
    write_images(table(spark, sf_dir, "supplier"), folder)
    images, rejects = read_image_manifest(spark, folder)
    return images.select("name", "width", "height").unionByName(rejects.select("name"), allowMissingColumns=True)


# Sorted outputs


@query("order_aliases", f"{ALIASES_SQL} SELECT alias, row_number() OVER (ORDER BY alias) AS position FROM aliases")
def order_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = read_aliases(alias_lines(table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")))
    return positions(in_order(aliases.select("alias")), "order-aliases")


@query(
    "order_usage",
    f"""{PAGES_SQL}, usage AS (
          SELECT root, split_part(subpath, '/', 1) AS dir, sum(size)::BIGINT AS bytes FROM files
            WHERE contains(subpath, '/') GROUP BY ALL
          UNION ALL SELECT root, '.', sum(size)::BIGINT FROM files GROUP BY root)
        SELECT bytes, row_number() OVER (ORDER BY bytes) AS position FROM usage""",
)
def order_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = dir_usage(page_files(table(spark, sf_dir, "pages")))
    return positions(ascending(usage), "order-usage").select("bytes", "position")


@query(
    "order_walk",
    f"""{FILES_SQL} SELECT root, subpath, row_number() OVER (ORDER BY root, string_split(subpath, '/')) AS position
        FROM files""",
)
def order_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = document_files(table(spark, sf_dir, "documents")).select("root", "subpath")
    return positions(in_walk_order(files), "order-walk")


@query(
    "order_disks",
    """WITH m AS (
         SELECT CASE WHEN s_suppkey % 4 > 0 THEN '/var/lib/docker/containers/{docker:svc' || s_suppkey || '='
             || sha256('c' || s_suppkey)[:12] || '...}/mounts/shm' ELSE '/data/' || s_suppkey END AS mount_label
         FROM supplier
         UNION ALL
         SELECT '/var/lib/docker/overlay2/' || CASE WHEN s_suppkey % 4 > 0 AND s_suppkey % 5 > 0
             THEN '{docker:svc' || s_suppkey || ':fs=' || sha256('o' || s_suppkey)[:12] || '...}'
           ELSE sha256('o' || s_suppkey) END || '/merged' FROM supplier
         UNION ALL SELECT '/srv/' || s_suppkey FROM supplier)
       SELECT mount_label, row_number() OVER (ORDER BY mount_label) AS position FROM m""",
)
def order_disks(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    resolved = resolve_mounts(read_disk_snapshot(disk_lines(supplier)), parse_container_meta(container_meta(supplier)))
    return positions(by_mount(resolved).select("mount_label"), "order-disks")
