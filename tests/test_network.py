"""Addresses and networks against Python's own reading of them."""

from __future__ import annotations

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.functions.addresses import ip_bits, net_bits
from fleetlens.operators.network import bad_networks, lookup_network, network_union, select_groups
from fleetlens.streaming.options import options

ADDRESSES = [
    "0.0.0.0", "255.255.255.255", "10.1.2.3", "1.2.3", "1.2.3.4.5", "256.1.1.1", "01.2.3.4", "1.2.3.4 ", "", "bad",
    "::", "::1", "1::", "ff10::", "2a01:4f8:13b:184e::2", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8",
    "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", ":::", "1:::2", ":1", "1:", "12345::", "g::", "::ffff:1.2.3.4",
    "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3", "::1.2.3.400", "1.2.3.4::", "ABCD::ef", "1:2:3:4::5:6:7:8",
]


def expected_bits(text):
    try:
        address = ipaddress.ip_address(text)
    except ValueError:
        return None
    return format(int(address), f"0{address.max_prefixlen}b")


def test_ip_bits(spark):
    rng = random.Random(1)
    texts = ADDRESSES + [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(50)]
    texts += [str(ipaddress.IPv6Address(rng.getrandbits(128) & rng.getrandbits(128))) for _ in range(200)]
    got = spark.createDataFrame([(t,) for t in texts], "ip string").select("ip", ip_bits(F.col("ip")).alias("b"))
    found = {r["ip"]: r["b"] for r in got.collect()}
    # A "::" that stands for no group at all is not accepted.
    assert found == {t: expected_bits(t) for t in texts}


def test_net_bits(spark):
    cases = {
        "10.0.0.0/8": "00001010", "10.1.2.3": format(0x0A010203, "032b"), "0.0.0.0/0": "", "ff10::/16": "1111111100010000",
        "10.0.0.0/99": format(0x0A000000, "032b"), "10.0.0.0/": None, "10.0.0/8": None, "x": None, "FF10::/16": None,
        "10.0.0.0/1000": None,
    }
    got = spark.createDataFrame([(c,) for c in cases], "c string").select("c", net_bits(F.col("c")).alias("b"))
    assert {r["c"]: r["b"] for r in got.collect()} == cases


NETS = [
    ("10.0.0.0/8", 0, "one"), ("ff10::/16", 1, "one"), ("20.0.0.0/8", 2, "two"), ("ff20::/16", 3, "two"),
    ("10.5.0.0/16", 4, "late"), ("broken", 5, "never"), ("30.0.0.1", 6, "host"), ("30.0.0.0/8", 7, "wide"),
    ("30.0.0.0/8", 8, "again"), ("::ffff:0:0/96", 9, "mapped"),
]
LABELS = {
    "10.0.0.1": "one", "10.5.0.1": "one", "11.1.0.1": None, "20.1.0.1": "two", "21.1.0.1": None, "ff10::1": "one",
    "ff11::1": None, "ff20::1": "two", "30.0.0.1": "host", "30.0.0.2": "wide", "bad": None, "999.1.1.1": None,
    "::ffff:10.0.0.1": "mapped", None: None,
}


@pytest.mark.parametrize("broadcast_nets", [1000, 3, 0])
def test_lookup(spark, broadcast_nets):
    nets = spark.createDataFrame(NETS, "cidr string, priority bigint, label string")
    df = spark.createDataFrame([(ip, i) for i, ip in enumerate(list(LABELS) * 3)], "ip string, id int")
    got = lookup_network(df, "ip", nets, broadcast_nets=broadcast_nets).collect()
    assert len(got) == len(LABELS) * 3
    assert {r["ip"]: r["net_label"] for r in got} == LABELS
    assert [r["cidr"] for r in bad_networks(nets).collect()] == ["broken"]


def test_net_zero_matches_all_of_its_family(spark):
    nets = spark.createDataFrame([("0.0.0.0/0", 1, "any"), ("1.0.0.0/8", 2, "late")], "cidr string, priority bigint, label string")
    df = spark.createDataFrame([("1.2.3.4",), ("::1",)], "ip string")
    assert [r["net_label"] for r in lookup_network(df, "ip", nets).orderBy("ip").collect()] == ["any", None]


def test_groups(spark):
    assert select_groups(["none"]) == []
    assert select_groups(["google:user", "local"]) == ["local", "google:user"]
    assert select_groups(["google"]) == ["google:bot", "google:ads", "google:user"]
    assert len(select_groups(["all"])) == 5
    with pytest.raises(ValueError):
        select_groups(["nowhere"])
    feeds = {"cloudflare": spark.createDataFrame([("127.0.0.0/8", 0)], "cidr string, pos bigint")}
    df = spark.createDataFrame([("127.0.0.1",), ("127.0.0.2",), ("::1",), ("10.0.1.1",)], "ip string")
    got = lookup_network(df, "ip", network_union(spark, ["cloudflare", "local"], feeds)).collect()
    assert {r["ip"]: r["net_label"] for r in got} == {
        "127.0.0.1": "localhost", "127.0.0.2": "cloudflare", "::1": "localhost", "10.0.1.1": None,
    }
    assert lookup_network(df, "ip", network_union(spark, ["none"], {})).where("net_label IS NOT NULL").count() == 0


@pytest.mark.parametrize("ip", ["10.9.9.9", "172.16.0.1", "no address", None])
def test_a_hot_address_is_spread(spark, ip):
    """Found, unmatched, invalid and null addresses alike, without adaptive execution."""
    nets = spark.createDataFrame(NETS, "cidr string, priority bigint, label string")
    df = spark.createDataFrame([(ip, i) for i in range(20_000)], "ip string, id int").repartition(8)
    with options(spark, spark__sql__adaptive__enabled="false", spark__sql__shuffle__partitions="16",
                 spark__sql__autoBroadcastJoinThreshold="-1"):
        got = lookup_network(df, "ip", nets, broadcast_nets=0, hot_rows=100)
        sizes = got.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 20_000
    assert max(r["count"] for r in sizes) < 6_000
    assert got.where("net_label IS NOT NULL").count() == (20_000 if ip == "10.9.9.9" else 0)


def expected_label(nets, text):
    """The first network by priority that holds the address, as one scan in order finds it."""
    address = ipaddress.ip_address(text)
    for cidr, _, label in sorted(nets, key=lambda n: n[1]):
        if address in ipaddress.ip_network(cidr):
            return label
    return None


def nested_networks(rng, n):
    """Networks that nest deeply in a few places, lie apart elsewhere, and touch the ends of both families."""
    nets = {"0.0.0.0/1", "255.255.255.255/32", "::/128", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff/128", "ff00::/8"}
    while len(nets) < n:
        wide = rng.random() < 0.5
        if rng.random() < 0.6:
            base = rng.choice([0x0A000000, 0xC0A80000, 0xFFFFFF00, rng.getrandbits(32)])
            address = base ^ rng.getrandbits(10 if wide else 16)
            nets.add(str(ipaddress.ip_network((address, rng.randrange(4, 33)), strict=False)))
        else:
            base = rng.choice([0x2A01 << 112, ((1 << 128) - 1) ^ 0xFFFF, rng.getrandbits(128)])
            address = base ^ rng.getrandbits(12 if wide else 80)
            nets.add(str(ipaddress.ip_network((address, rng.randrange(8, 129)), strict=False)))
    order = rng.sample(range(n), n)
    return [(cidr, order[i], f"net {order[i] % 50}") for i, cidr in enumerate(sorted(nets))]


def edge_addresses(rng, nets, n):
    """First, last and neighbouring addresses of networks, and any others."""
    found = []
    for cidr, _, _ in rng.sample(nets, n):
        net = ipaddress.ip_network(cidr)
        last = (1 << net.max_prefixlen) - 1
        for value in (int(net[0]), int(net[-1]), int(net[0]) - 1, int(net[-1]) + 1):
            if 0 <= value <= last:
                found.append(str(type(net[0])(value)))
    return found + [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(n)]


@pytest.mark.parametrize("nets_n, broadcast_nets", [(200, 1000), (200, 0), (900, 1000), (900, 0)])
def test_first_match_wins_over_longest_prefix(spark, nets_n, broadcast_nets):
    rng = random.Random(nets_n)
    nets = nested_networks(rng, nets_n)
    table = spark.createDataFrame(nets, "cidr string, priority bigint, label string").repartition(5)
    addresses = edge_addresses(rng, nets, 60)
    df = spark.createDataFrame([(a, i) for i, a in enumerate(addresses)], "ip string, part int")
    got = lookup_network(df, "ip", table, broadcast_nets=broadcast_nets)
    assert got.columns == ["ip", "part", "net_label"]
    assert {r["ip"]: r["net_label"] for r in got.collect()} == {a: expected_label(nets, a) for a in addresses}


def test_ranges_are_apart_and_few(spark):
    from fleetlens.operators.netranges import flat_ranges, local_ranges, with_bounds
    from fleetlens.operators.network import network_table

    rng = random.Random(8)
    nets = nested_networks(rng, 700)
    table = with_bounds(network_table(spark.createDataFrame(nets, "cidr string, priority bigint, label string")))
    rows = [(r.low, r.high, r.priority, r.label) for r in table.collect()]
    for splitters, ranges in (local_ranges(rows), flat_ranges(table.drop("low", "high"))):
        ranges = sorted(tuple(r) for r in (ranges if isinstance(ranges, list) else ranges.collect()))
        assert len(ranges) <= 2 * len(nets) + len(splitters)
        for (part, start, until, _), later in zip(ranges, [*ranges[1:], None]):
            assert start < until and splitters[part] <= start
            assert later is None or until <= later[1]
            assert part + 1 == len(splitters) or until <= splitters[part + 1]


def test_many_networks_on_a_stream(spark, tmp_path):
    """A hundred thousand networks are not broadcast, and the plan has one join."""
    nets = spark.range(100_000).selectExpr(
        "concat('10.', id div 65536, '.', id div 256 % 256, '.', id % 256) AS cidr", "id AS priority", "cast(id AS string) AS label"
    )
    nets = nets.union(spark.sql("SELECT '10.0.0.0/8', 50000L, 'wide'"))
    spark.range(500).selectExpr("concat('10.', id % 3, '.', id % 200, '.', id % 250) AS ip", "id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ip string, id long").parquet(str(tmp_path / "in"))
    found = lookup_network(stream, "ip", nets, broadcast_nets=1000)
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count("Join ") == 1
    query = found.writeStream.format("memory").queryName("many_networks").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.table("many_networks").collect()
    assert len(rows) == 500
    for r in rows:
        number = (r["id"] % 3) * 65536 + (r["id"] % 200) * 256 + r["id"] % 250
        assert r["net_label"] == (str(number) if number < 50_000 else "wide")
