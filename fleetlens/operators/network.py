"""Which known network an address belongs to."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.addresses import bound, ip_bits, net_parts
from fleetlens.functions.matching import held
from fleetlens.operators.netranges import RANGE_SCHEMA, address_key, flat_ranges, local_ranges, part_of, with_bounds
from fleetlens.operators.ordered import HOT_ROWS, join_group_facts, row_hash
from fleetlens.session import stored

# Known groups in priority order, and the addresses of the built-in one.
GROUPS = ("local", "cloudflare", "google:bot", "google:ads", "google:user")
GOOGLE_GROUPS = ("google:bot", "google:ads", "google:user")
LOCAL_ADDRESSES = ("127.0.0.1", "::1")
LOCAL_LABEL = "localhost"

# Networks up to this number in all are broadcast as ranges, two a network and one a part at most; 412,500 rows of
# at most about 150 bytes stay below 62 MB. More networks are shuffled.
BROADCAST_NETS = 200_000
STREAM_SALTS = 8  # tasks that the rows of one part in a micro-batch go to
_GROUP_STEP = 2**40
IN_RANGE = "_key >= _start AND _key < _until"


def select_groups(names: Iterable[str]) -> list[str]:
    """Known groups for the given names, in priority order.

    ``none`` adds nothing, ``google`` its three groups, ``all`` every group. Raises ``ValueError``
    for an unknown name.
    """
    chosen: set[str] = set()
    for name in names:
        if name == "all":
            chosen.update(GROUPS)
        elif name == "google":
            chosen.update(GOOGLE_GROUPS)
        elif name in GROUPS:
            chosen.add(name)
        elif name != "none":
            raise ValueError(f"unknown network group {name!r}")
    return [group for group in GROUPS if group in chosen]


def local_feed(spark: SparkSession) -> DataFrame:
    rows = [(cidr, position, LOCAL_LABEL) for position, cidr in enumerate(LOCAL_ADDRESSES)]
    return spark.createDataFrame(rows, "cidr string, pos bigint, label string")


def network_union(spark: SparkSession, names: Iterable[str], feeds: Mapping[str, DataFrame]) -> DataFrame:
    """``(cidr, priority, label)`` of the enabled groups; earlier groups come first.

    A feed has ``cidr`` and ``pos``; its label is the group name.
    """
    nets = [spark.createDataFrame([], "cidr string, priority bigint, label string")]
    for group in select_groups(names):
        if group == "local":
            feed = local_feed(spark)
        else:
            feed = feeds[group].select("cidr", "pos", F.lit(group).alias("label"))
        rank = F.lit(GROUPS.index(group) * _GROUP_STEP) + F.col("pos")
        nets.append(feed.select("cidr", rank.cast("bigint").alias("priority"), "label"))
    return reduce(DataFrame.unionByName, nets[1:] or nets)


def network_table(nets: DataFrame) -> DataFrame:
    """``(family, prefix_len, bits, priority, label)``; texts that are no network are left out.

    One row per distinct network remains, the one of the best priority.
    """
    parts = held(nets, net=net_parts(F.col("cidr")))
    best = F.min(F.struct("priority", "label"))
    return (
        parts.where(F.col("net").isNotNull())
        .groupBy("net.family", "net.prefix_len", "net.bits")
        .agg(best.alias("best"))
        .select("family", "prefix_len", "bits", "best.*")
    )


def bad_networks(nets: DataFrame) -> DataFrame:
    """Rows whose text is no network."""
    return nets.where(net_parts(F.col("cidr")).isNull())


def lookup_network(
    df: DataFrame,
    ip: str,
    nets: DataFrame,
    out: str = "net_label",
    broadcast_nets: int = BROADCAST_NETS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the label of the first network, by priority, that holds the address; null without one.

    The networks are swept into disjoint ranges, so each address is looked up once: a join on the part of the
    ranges that its key falls in, with a range test. Runs one job to fetch up to ``broadcast_nets`` networks
    and one more. If that was all of them, they are swept here and broadcast, one join per family, and
    the rows are not shuffled. Otherwise they are swept in parts by tasks, and distinct addresses meet
    their part in a shuffled join and are joined back, hot parts and addresses spread by their counts. A stream
    cannot be grouped by address without end; its rows meet the parts themselves, each part repeated ``STREAM_SALTS`` times.
    """
    table = network_table(nets)
    fetched = with_bounds(table).limit(broadcast_nets + 1).toArrow()
    if fetched.num_rows <= broadcast_nets:
        splitters, ranges = local_ranges([(n["low"], n["high"], n["priority"], n["label"]) for n in fetched.to_pylist()])
        return _lookup_in_broadcast(df, ip, splitters, ranges, out)
    splitters, kept = flat_ranges(stored(table, "networks"))
    if df.isStreaming:
        return _lookup_in_stream(df, ip, splitters, kept, out)
    return _lookup_by_address(df, ip, splitters, kept, out, hot_rows)


def _keyed(df: DataFrame, ip: str, splitters: list[str]) -> DataFrame:
    """Add ``_key`` of the address and ``_part``; null where the text is no address."""
    rows = held(df, _key=bound(ip_bits(F.col(ip)), address_key))
    return held(rows, _part=part_of(df, F.col("_key"), splitters))


def _lookup_in_broadcast(
    df: DataFrame, ip: str, splitters: list[str], ranges: list[tuple[int, str, str, str]], out: str
) -> DataFrame:
    families = sorted({start[0] for _, start, _, _ in ranges})
    if not families:
        return df.withColumn(out, F.lit(None).cast("string"))
    rows = _keyed(df, ip, splitters)
    for family in families:
        own = df.sparkSession.createDataFrame([r for r in ranges if r[1][0] == family], RANGE_SCHEMA)
        side = F.broadcast(own.toDF("_in", "_start", "_until", f"_label_{family}"))
        rows = rows.join(side, (F.col("_part") == F.col("_in")) & F.expr(IN_RANGE), "left").drop("_in", "_start", "_until")
    labels = [F.col(f"_label_{family}") for family in families]
    return rows.select(*df.columns, F.coalesce(*labels).alias(out))


def _lookup_in_stream(df: DataFrame, ip: str, splitters: list[str], ranges: DataFrame, out: str) -> DataFrame:
    # Rows without an address meet nothing, each under a part of its own.
    spread = F.pmod(row_hash(df), F.lit(2**31 - 1)).cast("int")
    rows = held(_keyed(df, ip, splitters), _spread=spread)
    rows = rows.select(
        *df.columns,
        "_key",
        F.coalesce(F.col("_part"), -2 - F.col("_spread")).alias("_part"),
        (F.col("_spread") % STREAM_SALTS).alias("_salt"),
    )
    salts = F.explode(F.sequence(F.lit(0), F.lit(STREAM_SALTS - 1)))
    side = ranges.toDF("_in", "_start", "_until", "_label").withColumn("_salted", salts)
    met = rows.join(side, (F.col("_part") == F.col("_in")) & (F.col("_salt") == F.col("_salted")) & F.expr(IN_RANGE), "left")
    return met.select(*df.columns, F.col("_label").alias(out))


def _lookup_by_address(
    df: DataFrame, ip: str, splitters: list[str], ranges: DataFrame, out: str, hot_rows: int
) -> DataFrame:
    counts = df.where(F.col(ip).isNotNull()).groupBy(F.col(ip).alias("_ip")).agg(F.count("*").alias("_n"))
    addresses = stored(_keyed(counts, "_ip", splitters), "addresses")
    usable = addresses.where(F.col("_part") >= 0).select("_ip", "_key", "_part")
    sizes = usable.groupBy("_part").agg(F.count("*").alias("_held"))
    side = ranges.toDF("_part", "_start", "_until", "_label").join(sizes, "_part")
    met = join_group_facts(usable, side, "_part", "_held", hot_rows=hot_rows, sizes=sizes)
    found = met.where(IN_RANGE).select("_ip", F.col("_label").alias(out))
    # Every address has its facts, so one that is very frequent is spread whether it was found or not.
    facts = addresses.select("_ip", "_n").join(found, "_ip", "left")
    nowhere = F.concat(F.lit("none "), row_hash(df).cast("string"))
    rows = held(df, _ip=F.coalesce(F.col(ip), nowhere))
    return join_group_facts(rows, facts, "_ip", "_n", "left", hot_rows, sizes=addresses).select(*df.columns, out)
