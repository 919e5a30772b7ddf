"""Captured command output of hosts as typed rows: disks, containers, firewall rules, accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.addresses import bound
from fleetlens.functions.labels import container_state, short_id, short_status, verdict_class
from fleetlens.functions.matching import held, match_groups
from fleetlens.operators.lines import BLOCK, FILE, KEY, SEQ

# Patterns of paths, ports, chains, counters and header lines.
_CONTAINER_PATH = r"(?d)^/var/lib/docker/containers/([0-9a-f]+)/"
_OVERLAY_PATH = r"(?d)^/var/lib/docker/overlay2/([0-9a-f]+)/"
_PORT = r"(?:([0-9.]+):(\d+)->)?(\d+)/(tcp|udp)"
_PORTS = rf"(?d)^(?:{_PORT})?(?:, (?:{_PORT})?)*+$"
_CHAIN = r"(?d)^Chain (\S+) (.*)$"
_COUNTER = r"(?d)^([0-9]+)([^0-9]+)$"
_BLANKS = r"\s+"
_WIDE_BLANKS = r"\s{2,}"
DISK_HEADER = r"^Filesystem\s+Type\s"
CONTAINER_HEADER = r"^CONTAINER ID\s"
_TRIMMED = " \t\n\r\0\x0b"
ANY_ADDRESS = "0.0.0.0"
ANY_NETWORK = "0.0.0.0/0"


def _token(name: str, position: int) -> Column:
    return F.get(F.col(name), F.lit(position))


def by_mount(disks: DataFrame) -> DataFrame:
    """Disks in the order of their mounts."""
    return disks.orderBy("mount_label")


def drop_header(lines: DataFrame, header: str | None) -> DataFrame:
    """Drop the lines that match the header pattern, or with ``None`` the first line of each file.

    The pattern works row by row; finding first lines shuffles the lines by their key.
    """
    if header is not None:
        return lines.where(~F.col("value").rlike(header))
    first = lines.groupBy(*FILE).agg(F.min(F.struct(*BLOCK, SEQ)).alias("_first"))
    return lines.join(first.select(*FILE, "_first.*"), KEY, "left_anti")


# Disks


def read_disk_snapshot(lines: DataFrame, header: str | None = DISK_HEADER) -> DataFrame:
    """``df -T -B 1M`` text to rows; sizes in MiB, null where the text is no number."""
    rows = drop_header(lines, header).where(F.col("value") != "")
    names = "fsname fstype size used free pp mount".split()
    tokens = rows.select(*[c for c in lines.columns if c != "value"], F.split("value", _BLANKS).alias("t"))
    columns = [
        (_token("t", i).try_cast("bigint") if name in ("size", "used", "free") else _token("t", i)).alias(name)
        for i, name in enumerate(names)
    ]
    return tokens.select(*[c for c in tokens.columns if c != "t"], *columns)


CONTAINER_META = "array<struct<Id: string, Name: string, GraphDriver: struct<Data: struct<MergedDir: string>>>>"


def parse_container_meta(rows: DataFrame, json: str = "value") -> DataFrame:
    """Inspect output, a JSON array of which the first element counts, to ``name`` and ``overlay_id``."""
    meta = held(rows, meta=F.get(F.from_json(F.col(json), CONTAINER_META), F.lit(0)))
    merged = match_groups(F.col("meta.GraphDriver.Data.MergedDir"), _OVERLAY_PATH + r".*$", 1)
    overlay = F.when(F.col("meta.GraphDriver.Data.MergedDir").rlike(_OVERLAY_PATH), F.get(merged, F.lit(0)))
    return meta.where(F.col("meta.Name").isNotNull()).select(
        *[c for c in rows.columns if c != json],
        F.col("meta.Id").alias("container_id"),
        F.expr("substring(meta.Name, 2)").alias("name"),
        overlay.alias("overlay_id"),
    )


def mount_labels(disks: DataFrame, meta: DataFrame) -> DataFrame:
    """``(host, id, label)`` of the containers that occur as a mount, and of their overlays."""
    mounted = (
        disks.where(F.col("mount").rlike(_CONTAINER_PATH))
        .select("host", F.regexp_extract("mount", _CONTAINER_PATH, 1).alias("container_id"))
        .distinct()
    )
    known = mounted.join(meta.select("host", "container_id", "name", "overlay_id"), ["host", "container_id"])

    def label(id_column: str, separator: str) -> Column:
        return F.concat(
            F.lit("{docker:"), F.col("name"), F.lit(separator), short_id(F.col(id_column)), F.lit("...}")
        )

    containers = known.select("host", F.col("container_id").alias("id"), label("container_id", "=").alias("label"))
    overlays = known.where(F.col("overlay_id").isNotNull()).select(
        "host", F.col("overlay_id").alias("id"), label("overlay_id", ":fs=").alias("label")
    )
    return containers.unionByName(overlays)


def resolve_mounts(disks: DataFrame, meta: DataFrame) -> DataFrame:
    """Add ``mount_label``: the mount path with container and overlay ids replaced by labels.

    Ids are runs of hexadecimal digits, so the runs of each path are joined to the labels by
    equality. ``(host, mount)`` identifies a row.
    """
    labels = mount_labels(disks, meta)
    runs = F.array_distinct(F.regexp_extract_all("mount", F.lit("([0-9a-f]+)"), 1))
    found = (
        disks.select("host", "mount", F.explode(runs).alias("id"))
        .distinct()
        .join(labels, ["host", "id"])
        .groupBy("host", "mount")
        .agg(F.sort_array(F.collect_list(F.struct("id", "label"))).alias("_found"))  # the runs of one path
    )
    replaced = F.aggregate(
        F.coalesce("_found", F.expr("array()").cast("array<struct<id: string, label: string>>")),
        F.col("mount"),
        lambda path, hit: F.replace(path, hit["id"], hit["label"]),
    )
    return disks.join(found, ["host", "mount"], "left").select(*disks.columns, replaced.alias("mount_label"))


# Containers


def read_container_snapshot(
    lines: DataFrame, header: str | None = CONTAINER_HEADER
) -> tuple[DataFrame, DataFrame]:
    """``(containers, rejects)`` of a container listing; six columns mean no ports."""
    others = [c for c in lines.columns if c != "value"]
    rows = drop_header(lines, header)
    tokens = held(rows, t=F.split("value", _WIDE_BLANKS, -1))
    whole = F.size("t").isin(6, 7)
    ports = F.when(F.size("t") == 7, _token("t", 5)).otherwise("")
    containers = tokens.where(whole).select(
        *others,
        _token("t", 0).alias("container_id"),
        _token("t", 1).alias("image"),
        _token("t", 2).alias("command"),
        _token("t", 3).alias("created"),
        short_status(_token("t", 4)).alias("status"),
        container_state(_token("t", 4)).alias("state"),
        ports.alias("ports"),
        F.get("t", F.size("t") - 1).alias("name"),
    )
    rejects = tokens.where(~whole).select(*lines.columns, F.lit("container").alias("stage"))
    return containers, rejects


def parse_ports(ports: Column) -> Column:
    """``array<struct<iface, proto, host_port, container_port>>``; null when any entry is malformed.

    Ports of all addresses have ``*`` as interface, ports that are not exposed have ``-``. One
    pattern checks the whole text and one replacement splits all its entries.
    """
    fields = F.regexp_replace(ports, _PORT, "$1 $2 $3 $4")

    def entry(part: Column) -> Column:
        iface, host_port = F.get(part, F.lit(0)), F.get(part, F.lit(1))
        return F.struct(
            F.when(iface == "", "-").when(iface == ANY_ADDRESS, "*").otherwise(iface).alias("iface"),
            F.get(part, F.lit(3)).alias("proto"),
            F.when(host_port != "", host_port).alias("host_port"),
            F.get(part, F.lit(2)).alias("container_port"),
        )

    # Split before the entries are made, as an expression of a lambda is computed wherever it is mentioned.
    parts = F.transform(F.filter(F.split(fields, ", ", -1), lambda text: text != ""), lambda text: F.split(text, " ", -1))
    return F.when(ports.rlike(_PORTS), F.transform(parts, entry))


def ports_by_interface(entries: Column) -> Column:
    """Text like ``[*]:tcp{80,443->8443}; [-]:udp{53}`` with groups in first-seen order.

    All ports of a container are in its row, so this needs no grouping of rows.
    """

    def group_of(e: Column) -> Column:
        return F.concat(F.lit("["), e["iface"], F.lit("]:"), e["proto"])

    def numbers(e: Column) -> Column:
        same = e["host_port"].isNull() | (e["host_port"] == e["container_port"])
        return F.when(same, e["container_port"]).otherwise(
            F.concat(e["host_port"], F.lit("->"), e["container_port"])
        )

    def grouped(named: Column) -> Column:
        texts = F.transform(
            F.array_distinct(named["group"]),
            lambda g: F.concat(
                g, F.lit("{"), F.concat_ws(",", F.filter(named, lambda e: e["group"] == g)["number"]), F.lit("}")
            ),
        )
        return F.concat_ws("; ", texts)

    # Group and number of an entry are made once, not for each group they are compared with.
    named = F.transform(entries, lambda e: F.struct(group_of(e).alias("group"), numbers(e).alias("number")))
    return bound(named, grouped)


def with_ports(containers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(containers, rejects)`` with ``port_list`` and ``port_text``; malformed ports reject the row."""
    rows = held(containers, port_list=parse_ports(F.col("ports")))
    good = rows.where(F.col("port_list").isNotNull())
    rejects = rows.where(F.col("port_list").isNull()).drop("port_list")
    return (
        good.withColumn("port_text", ports_by_interface(F.col("port_list"))),
        rejects.withColumn("stage", F.lit("ports")),
    )


# Firewall


def carry_chain(lines: DataFrame) -> DataFrame:
    """Add ``chain`` and ``policy`` of the section a line is in, its key, and ``role``; null outside of any.

    A line ``Chain NAME TEXT`` opens a section and an empty line ends it. A line inside a section is
    never taken for an opening one unless it has that form. The section is known by the place of
    its opening line, ``section_block`` and ``section_seq``, as a name may occur twice. ``role`` is
    ``open``, ``header`` for the line after it, or ``rule``; ``table`` is taken from the lines, and is
    ``filter`` where they name none.
    """
    groups = match_groups(F.col("value"), _CHAIN, 2)
    opens = F.col("value").rlike(_CHAIN)
    mark = F.when(opens, F.struct(F.get(groups, F.lit(0)).alias("chain"), F.get(groups, F.lit(1)).alias("policy")))
    mark = F.when(F.col("value") == "", F.struct(F.lit("").alias("chain"), F.lit("").alias("policy"))).otherwise(mark)
    marked = held(lines, _mark=mark, _opens=opens)
    marks = F.when(F.col("_mark").isNotNull(), F.col(SEQ))
    places = marked.groupBy(*FILE, *BLOCK).agg(F.max(marks).alias("_at"), F.max_by("_opens", SEQ).alias("_opened"))
    blocks = Window.partitionBy(*FILE).orderBy(*BLOCK)
    place = F.when(F.col("_at").isNotNull(), F.struct(F.col("block_start").alias("_from"), "_at"))
    before = F.last(place, ignorenulls=True).over(blocks.rowsBetween(Window.unboundedPreceding, -1))
    edges = places.select(*FILE, *BLOCK, before.alias("_place"), F.lag("_opened").over(blocks).alias("_opened"))
    edges = edges.select(*FILE, *BLOCK, "_place._from", "_place._at", "_opened")
    values = marked.where(F.col("_mark").isNotNull()).select(
        *FILE, F.col("block_start").alias("_from"), F.col(SEQ).alias("_at"), F.col("_mark").alias("_edge")
    )
    edges = edges.join(values, [*FILE, "_from", "_at"], "left")
    inside = Window.partitionBy(*FILE, *BLOCK).orderBy(SEQ)
    here = F.struct(F.col("_mark").alias("mark"), F.col("block_start").alias("block"), F.col(SEQ).alias("seq"))
    there = F.struct(F.col("_edge").alias("mark"), F.col("_from").alias("block"), F.col("_at").alias("seq"))
    own, edge = F.when(F.col("_mark").isNotNull(), here), F.when(F.col("_edge").isNotNull(), there)
    placed = marked.join(edges, [*FILE, *BLOCK], "left").select(
        *lines.columns,
        "_opens",
        F.coalesce(F.last(own, ignorenulls=True).over(inside), edge).alias("_section"),
        F.coalesce(F.lag("_opens").over(inside), F.col("_opened"), F.lit(False)).alias("_after"),
    )
    found = F.col("_section.mark.chain") != ""
    others = [c for c in lines.columns if c != "table"]
    return placed.select(
        *others,
        F.col("table") if "table" in lines.columns else F.lit("filter").alias("table"),
        F.when(found, F.col("_section.mark.chain")).alias("chain"),
        F.when(found, F.col("_section.mark.policy")).alias("policy"),
        F.when(found, F.col("_section.block")).alias("section_block"),
        F.when(found, F.col("_section.seq")).alias("section_seq"),
        F.when(found, F.when(F.col("_opens"), "open").when(F.col("_after"), "header").otherwise("rule")).alias("role"),
    )


def read_firewall_snapshot(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(rules, chains, rejects)`` of a rule listing; ``chains`` has a row per section, empty ones too."""
    placed = carry_chain(lines)
    body = placed.where(F.col("role") == "rule")
    names = "num pkts bytes target prot opt in_iface out_iface source destination".split()
    tokens = body.select(
        *[c for c in body.columns if c not in ("value", "role")],
        F.split(F.btrim("value", F.lit(_TRIMMED)), _BLANKS).alias("t"),
    )
    rules = tokens.select(
        *[c for c in tokens.columns if c != "t"],
        *[_token("t", i).alias(name) for i, name in enumerate(names)],
        F.concat_ws(" ", F.slice("t", len(names) + 1, F.greatest(F.size("t") - len(names), F.lit(0)))).alias("other"),
    )
    section = [*FILE, "table", "section_block", "section_seq", "chain", "policy"]
    sections = placed.where(F.col("role").isNotNull()).groupBy(*section)
    chains = sections.agg(F.count_if(F.col("role") == "rule").alias("rules"))
    rejects = placed.where(F.col("chain").isNull() & (F.col("value") != "")).select(
        *lines.columns, F.lit("chain").alias("stage")
    )
    return rules, chains, rejects


def split_counter(counter: Column) -> Column:
    """``struct<n, mult>``: ``12K`` to ``12`` and ``K``; plain numbers have no multiplier."""
    parts = match_groups(counter, _COUNTER, 2)
    return F.struct(
        F.get(parts, F.lit(0)).try_cast("bigint").alias("n"),
        F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("mult"),
    )


def normalise_rule(rules: DataFrame) -> DataFrame:
    """Shorten wildcards, turn ``!`` prefixes into flags, and split the counters."""
    fields = ("in_iface", "out_iface", "source", "destination")

    def shortened(name: str) -> Column:
        value = F.col(name)
        return F.when(value == ANY_NETWORK, "*").otherwise(value) if name in fields[2:] else value

    changed = {
        "prot": F.when(F.col("prot") == "all", "*").otherwise(F.col("prot")),
        "opt": F.when(F.col("opt") == "--", "").otherwise(F.col("opt")),
        **{f: F.when(F.col(f).startswith("!"), F.expr(f"substring({f}, 2)")).otherwise(shortened(f)) for f in fields},
    }
    return rules.select(
        *[changed.get(c, F.col(c)).alias(c) for c in rules.columns],
        *[F.col(f).startswith("!").alias(f"{f}_negated") for f in fields],
        split_counter(F.col("pkts")).alias("pkts_count"),
        split_counter(F.col("bytes")).alias("bytes_count"),
        verdict_class(F.col("target")).alias("verdict"),
    )


# Accounts

ACCOUNT_SCHEMA = "username string, x string, uid bigint, gid bigint, name string, home string, shell string"


def parse_accounts(lines: DataFrame) -> DataFrame:
    """Account lines with seven fields separated by colons."""
    tokens = lines.select(*[c for c in lines.columns if c != "value"], F.split("value", ":", -1).alias("t"))
    names = "username x uid gid name home shell".split()
    return tokens.select(
        *[c for c in tokens.columns if c != "t"],
        *[
            (_token("t", i).try_cast("bigint") if name in ("uid", "gid") else _token("t", i)).alias(name)
            for i, name in enumerate(names)
        ],
    )
