"""Registered queries over host snapshots and aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.labels import thousands
from fleetlens.operators.aliases import annotate_ids, in_order, read_aliases, resolve_alias
from fleetlens.operators.snapshots import (
    by_mount,
    normalise_rule,
    parse_accounts,
    parse_container_meta,
    read_container_snapshot,
    read_disk_snapshot,
    read_firewall_snapshot,
    resolve_mounts,
    with_ports,
)
from fleetlens.plans.registry import query, table
from fleetlens.plans.render import (
    account_lines,
    alias_lines,
    container_lines,
    container_meta,
    disk_lines,
    firewall_lines,
)


@query(
    "disk_mounts",
    """WITH s AS (
         SELECT *, 'h' || s_nationkey AS host, sha256('c' || s_suppkey) AS c, sha256('o' || s_suppkey) AS o,
           trunc(abs(s_acctbal) * 100)::BIGINT AS size FROM supplier),
       m AS (
         SELECT *, '/dev/sd0' AS fsname, CASE WHEN s_suppkey % 4 > 0 THEN '/var/lib/docker/containers/{docker:svc'
             || s_suppkey || '=' || c[:12] || '...}/mounts/shm' ELSE '/data/' || s_suppkey END AS mount_label FROM s
         UNION ALL
         SELECT *, '/dev/sd1', '/var/lib/docker/overlay2/' || CASE WHEN s_suppkey % 4 > 0 AND s_suppkey % 5 > 0
             THEN '{docker:svc' || s_suppkey || ':fs=' || o[:12] || '...}' ELSE o END || '/merged' FROM s
         UNION ALL SELECT *, '/dev/sd2', '/srv/' || s_suppkey FROM s)
       SELECT host, fsname, 'ext4' AS fstype, size, (size // 2)::BIGINT AS used, (size - size // 2)::BIGINT AS free,
         '50%' AS pp, mount_label,
         CASE WHEN size < 1000 THEN size::VARCHAR ELSE (size // 1000) || '''' || lpad((size % 1000)::VARCHAR, 3, '0')
           END AS size_text FROM m""",
)
def disk_mounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    disks = read_disk_snapshot(disk_lines(supplier))
    resolved = resolve_mounts(disks, parse_container_meta(container_meta(supplier)))
    return by_mount(resolved).select(
        "host", "fsname", "fstype", "size", "used", "free", "pp", "mount_label",
        thousands(F.col("size")).alias("size_text"),
    )


CONTAINERS_SQL = r"""
WITH c AS (
  SELECT *, 'ps/' || l_suppkey AS file_path, md5(l_orderkey::VARCHAR)[:12] AS container_id,
    CASE l_linenumber WHEN 1 THEN 'exited' WHEN 2 THEN 'created' WHEN 3 THEN 'other' ELSE 'up' END AS state,
    CASE l_linenumber WHEN 1 THEN 'Ex(' || (l_suppkey % 3) || ') 2 days ago' WHEN 2 THEN 'Created'
      WHEN 3 THEN 'Restarting (1) 5 seconds ago' ELSE 'Up 2 hours' END AS status,
    'svc' || l_orderkey AS name, '[10.' || (l_suppkey % 250) || '.0.1]:' AS iface
  FROM lineitem)
"""


@query(
    "container_state",
    f"""{CONTAINERS_SQL} SELECT l_orderkey, container_id, 'img' || l_partkey || ':1.0' AS image,
          l_linenumber || ' days ago' AS created, status, state,
          CASE WHEN l_linenumber = 6 THEN '' ELSE name END AS name FROM c""",
)
def container_state_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = container_lines(table(spark, sf_dir, "lineitem"))
    containers, _ = read_container_snapshot(lines)
    return containers.select("l_orderkey", "container_id", "image", "created", "status", "state", "name")


@query(
    "ports_by_interface",
    f"""{CONTAINERS_SQL} SELECT l_orderkey, container_id,
          CASE WHEN l_linenumber = 1 THEN '' ELSE '[*]:tcp{{' || CASE WHEN l_partkey = 80 THEN '80'
            ELSE l_partkey || '->80' END || ',443}}; ' || iface || 'tcp{{25}}; [-]:udp{{53}}; ' || iface || 'udp{{'
            || CASE WHEN l_partkey = 53 THEN '53' ELSE l_partkey || '->53' END || '}}' END AS port_text
        FROM c WHERE l_linenumber NOT IN (2, 7)""",
)
def ports_by_interface_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = container_lines(table(spark, sf_dir, "lineitem"))
    containers, _ = with_ports(read_container_snapshot(lines)[0])
    return containers.select("l_orderkey", "container_id", "port_text")


@query("ports_rejects", f"{CONTAINERS_SQL} SELECT l_orderkey, container_id FROM c WHERE l_linenumber IN (2, 7)")
def ports_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = container_lines(table(spark, sf_dir, "lineitem"))
    _, rejects = with_ports(read_container_snapshot(lines)[0])
    return rejects.select("l_orderkey", "container_id")


@query(
    "firewall_rules",
    """SELECT 'filter' AS table, p_brand AS chain, '(policy DROP 0 packets, 0 bytes)' AS policy, p_partkey::VARCHAR AS num,
         p_size::BIGINT AS pkts_n, 'K' AS pkts_mult, (p_partkey * 3)::BIGINT AS bytes_n, '' AS bytes_mult,
         ['REJECT', 'DROP', 'ACCEPT', 'LOG', 'RETURN', p_type][p_partkey % 6 + 1] AS target,
         ['reject', 'drop', 'accept', 'log', 'return', 'plain'][p_partkey % 6 + 1] AS verdict,
         CASE WHEN p_size % 2 = 0 THEN '*' ELSE 'tcp' END AS prot, '' AS opt,
         CASE WHEN p_size % 3 = 0 THEN 'eth0' ELSE '*' END AS in_iface, p_size % 3 = 0 AS in_iface_negated,
         'eth' || p_size AS out_iface, CASE WHEN p_size % 5 = 0 THEN '*' ELSE '10.0.0.0/8' END AS source,
         p_size % 5 > 0 AS source_negated, '*' AS destination,
         CASE WHEN p_size % 7 = 0 THEN '' ELSE 'tcp dpt:' || p_size END AS other
       FROM part
       UNION ALL
       SELECT CASE WHEN r_regionkey % 2 = 1 THEN 'nat' ELSE 'filter' END, 'OUTPUT', '(policy ACCEPT 0 packets, 0 bytes)',
         i::VARCHAR, 0, '', 0, '', 'ACCEPT', 'accept', '*', '', '*', FALSE, '*', '*', FALSE, '*', ''
       FROM region, range(1, 10) AS t(i) WHERE i <= r_regionkey""",
)
def firewall_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = firewall_lines(table(spark, sf_dir, "part"), table(spark, sf_dir, "region"))
    rules = normalise_rule(read_firewall_snapshot(lines)[0])
    return rules.select(
        "table", "chain", "policy", "num",
        F.coalesce("pkts_count.n", F.col("pkts").try_cast("bigint")).alias("pkts_n"),
        F.col("pkts_count.mult").alias("pkts_mult"),
        F.coalesce("bytes_count.n", F.col("bytes").try_cast("bigint")).alias("bytes_n"),
        F.col("bytes_count.mult").alias("bytes_mult"),
        "target", "verdict", "prot", "opt", "in_iface", "in_iface_negated", "out_iface", "source",
        "source_negated", "destination", "other",
    )


@query(
    "firewall_chains",
    """SELECT 'filter' AS table, p_brand AS chain, count(*) AS rules FROM part GROUP BY p_brand
       UNION ALL SELECT 'filter', replace(r_name, ' ', '-'), 0 FROM region
       UNION ALL SELECT CASE WHEN r_regionkey % 2 = 1 THEN 'nat' ELSE 'filter' END, 'OUTPUT', r_regionkey FROM region""",
)
def firewall_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = firewall_lines(table(spark, sf_dir, "part"), table(spark, sf_dir, "region"))
    return read_firewall_snapshot(lines)[1].select("table", "chain", "rules")


@query("firewall_rejects", "SELECT 'stray ' || r_name AS value, 'chain' AS stage FROM region")
def firewall_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = firewall_lines(table(spark, sf_dir, "part"), table(spark, sf_dir, "region"))
    return read_firewall_snapshot(lines)[2].select("value", "stage")


@query(
    "accounts",
    """SELECT c_name AS username, 'x' AS x, c_custkey AS uid, (100 + c_nationkey)::BIGINT AS gid,
         c_mktsegment AS name, '/home/' || c_custkey AS home,
         CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '/bin/bash' END AS shell FROM customer""",
)
def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse_accounts(account_lines(table(spark, sf_dir, "customer")))
    return rows.select("username", "x", "uid", "gid", "name", "home", "shell")


ALIASES_SQL = """
WITH aliases AS (
  SELECT n_nationkey, n_name, md5(n_nationkey::VARCHAR)[:6] AS alias,
    n_name || CASE WHEN n_regionkey = 1 THEN '_new' ELSE '' END AS label
  FROM nation)
"""


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_aliases(alias_lines(table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")))


@query("alias_table", f"{ALIASES_SQL} SELECT alias, label FROM aliases")
def alias_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_order(_aliases(spark, sf_dir).select("alias", "label"))


@query(
    "alias_annotate",
    f"""{ALIASES_SQL}, t AS (SELECT c_custkey, c_name, c_nationkey, md5(c_nationkey::VARCHAR) AS id FROM customer)
        SELECT c_custkey, id || ' ' || label || ' up x' || id || ' ' || label || ' f' || id || ' ' || c_name
          AS annotated FROM t JOIN aliases ON n_nationkey = c_nationkey""",
)
def alias_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr(
        """concat(md5(cast(c_nationkey AS string)), ' up x', md5(cast(c_nationkey AS string)), ' f',
             md5(cast(c_nationkey AS string)), ' ', c_name)"""
    )
    texts = table(spark, sf_dir, "customer").select("c_custkey", text.alias("text"))
    return annotate_ids(texts, "text", _aliases(spark, sf_dir)).select("c_custkey", "annotated")


@query(
    "alias_resolve",
    f"""{ALIASES_SQL} SELECT c_custkey, coalesce(alias, 'NATION_' || c_nationkey) AS resolved
        FROM customer LEFT JOIN aliases ON label = 'NATION_' || c_nationkey""",
)
def alias_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "customer").selectExpr("c_custkey", "concat('NATION_', c_nationkey) AS id")
    return resolve_alias(ids, "id", _aliases(spark, sf_dir)).select("c_custkey", "resolved")
