"""The prefix trie of conversations, its subtrees summed over an Euler tour."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.list_ranking import FINISH, list_ranks
from fleetlens.llm.numbering import numbered
from fleetlens.operators.ordered import join_group_facts
from fleetlens.session import stored

SPAN = 64  # turns whose digests are put together at once
TOUR_BLOCK = 1 << 16  # arcs summed in one window partition
ROOT = ""


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``depth`` (from 1), ``digest`` of role and text, and ``chars`` (code points of the text).

    Turns are ordered by ``turn``, null first, and those of equal turn by role and text. Null roles and texts
    are empty. Rows without a ``conv_id`` are no conversation's. Stored.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    framed = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        F.sha2(framed, 256).alias("digest"),
        F.length(text).cast("bigint").alias("chars"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    turns = numbered(rows, "conv_id", order, ["digest", "chars"], "trie-turns")
    return stored(turns.select("conv_id", (F.col("pos") + 1).alias("depth"), "digest", "chars"), "trie-numbered")


def prefix_digests(turns: DataFrame, span: int = SPAN) -> DataFrame:
    """Add ``prefix``, a digest of the first ``depth`` turns, to turns numbered from 1 without gaps.

    The digests of up to ``span`` turns are joined in a window; what lies before them comes from
    the prefixes of whole spans, found in the same way. So no task holds a conversation, and there
    are ``log64`` levels in the longest one's turns.
    """
    spans = turns.withColumn("span", F.floor((F.col("depth") - 1) / span))
    so_far = Window.partitionBy("conv_id", "span").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    own = spans.withColumn("own", F.array_join(F.collect_list("digest").over(so_far), ""))
    if turns.filter(F.col("depth") > span).isEmpty():
        before = own.withColumn("before", F.lit(""))
    else:
        own = stored(own, "trie-spans")
        whole = own.filter(F.col("depth") % span == 0)
        blocks = whole.select("conv_id", (F.col("span") + 1).alias("depth"), F.sha2("own", 256).alias("digest"))
        earlier = prefix_digests(blocks, span).select("conv_id", F.col("depth").alias("span"), F.col("prefix").alias("before"))
        before = own.join(earlier, ["conv_id", "span"], "left")
    framed = F.concat(F.col("depth").cast("string"), F.lit(":"), F.coalesce("before", F.lit("")), F.lit(":"), F.col("own"))
    return before.withColumn("prefix", F.sha2(framed, 256)).drop("span", "own", "before")


def id_list_digests(members: DataFrame) -> DataFrame:
    """SHA-256 of each ``prefix``'s decimal ``conv_id``, ascending, joined by commas.

    A digest of a list is a chain, so one task follows it, but holds a piece at a time: the
    ids are sorted and written as text in many tasks, a row per batch, before they meet.
    """

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if not len(rows):
                continue
            prefix, ids = rows["prefix"].to_numpy(), rows["conv_id"].to_numpy()
            cuts = np.flatnonzero(prefix[1:] != prefix[:-1]) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(ids)]])
            text = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(starts, ends)]
            yield pd.DataFrame({"prefix": prefix[starts], "first": ids[starts], "piece": text})

    def chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for rows in batches:
            names, digests = [], []
            for prefix, piece in zip(rows["prefix"], rows["piece"]):
                if state is not None and prefix == current:
                    state.update(b"," + piece.encode())
                    continue
                if state is not None:
                    names.append(current)
                    digests.append(state.hexdigest())
                current, state = prefix, hashlib.sha256(piece.encode())
            yield pd.DataFrame({"prefix": names, "ends_sha256": digests}, dtype=object)
        if state is not None:
            yield pd.DataFrame({"prefix": [current], "ends_sha256": [state.hexdigest()]})

    ordered = members.select("prefix", "conv_id").orderBy("prefix", "conv_id")
    texts = ordered.mapInPandas(pieces, "prefix string, first long, piece string")
    together = texts.repartition("prefix").sortWithinPartitions("prefix", "first")
    return together.mapInPandas(chained, "prefix string, ends_sha256 string")


def _nodes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per trie node with its parent's ``prefix`` as ``up`` and an id ``node``."""
    facts = [F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")]
    inner = rows.groupBy("depth", "prefix").agg(*facts, F.max("chars").alias("chars"))
    # The smallest member of a node passes through the node's parent one turn before.
    before = rows.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
    inner = inner.join(before, ["conv_id", "depth"], "left").withColumn("up", F.coalesce("up", F.lit(ROOT)))
    top = convs.agg(*facts).filter("n_convs > 0").select(
        "conv_id",
        F.lit(0).cast("bigint").alias("depth"),
        F.lit(ROOT).alias("prefix"),
        "n_convs",
        F.lit(0).cast("bigint").alias("chars"),
        F.lit(None).cast("string").alias("up"),
    )
    return inner.unionByName(top).withColumn("node", F.monotonically_increasing_id())


def tour_links(nodes: DataFrame, children: DataFrame) -> DataFrame:
    """The Euler tour as a list (``id``, ``next``): arc ``2 * node`` enters a node, the one after it leaves it.

    ``nodes`` has ``node``; ``children`` has ``node``, ``parent`` and ``conv_id``, which orders siblings within a block. Children are
    dealt into blocks by hash and linked inside them; a second step links the blocks of a parent, so a parent with
    very many children is no single group.
    """
    blocks = 1 + isqrt(nodes.count())  # so neither a block nor the blocks of a parent are many
    dealt = children.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks)))
    inside = Window.partitionBy("parent", "block").orderBy("conv_id")
    linked = stored(dealt.withColumn("sibling", F.lead("node").over(inside)), "trie-siblings")
    ends = linked.groupBy("parent", "block").agg(
        F.min_by("node", "conv_id").alias("first"), F.max_by("node", "conv_id").alias("last")
    )
    ends = stored(ends.withColumn("after", F.lead("first").over(Window.partitionBy("parent").orderBy("block"))), "trie-blocks")
    across = ends.filter("after IS NOT NULL").select(F.col("last").alias("node"), "after")
    sibling = linked.join(across, "node", "left").select("node", "parent", F.coalesce("sibling", "after").alias("sibling"))
    first = ends.groupBy(F.col("parent").alias("node")).agg(F.min_by("first", "block").alias("first"))
    entering = nodes.select("node").join(first, "node", "left").select(
        (F.col("node") * 2).alias("id"), F.coalesce(F.col("first") * 2, F.col("node") * 2 + 1).alias("next")
    )
    leaving = nodes.select("node").join(sibling, "node", "left").select(
        (F.col("node") * 2 + 1).alias("id"), F.coalesce(F.col("sibling") * 2, F.col("parent") * 2 + 1).alias("next")
    )
    return entering.unionByName(leaving)


def subtree_sums(ranks: DataFrame, weights: DataFrame, block: int = TOUR_BLOCK) -> DataFrame:
    """Per ``node`` the sums of the columns of ``weights`` over its subtree, from prefix sums at the arcs' places.

    Weights count where a node is entered. What the prefix sums differ by between leaving a node
    and before entering it is its subtree. Places have no gaps, so blocks of them are even.
    """
    names = [c for c in weights.columns if c != "node"]
    arcs = ranks.select(
        F.floor(F.col("id") / 2).alias("node"), (F.col("id") % 2 == 0).alias("enters"), F.floor(F.col("rank") / block).alias("block"), "rank"
    )
    arcs = arcs.join(weights, "node").select(
        "node", "enters", "block", "rank", *[F.when(F.col("enters"), F.col(c)).otherwise(0).alias(c) for c in names]
    )
    arcs = stored(arcs, "trie-arcs")
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    totals = arcs.groupBy("block").agg(*[F.sum(c).alias(c) for c in names])
    before = totals.select("block", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in names])
    inside = Window.partitionBy("block").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = arcs.join(before, "block").select(
        "node", "enters", *[(F.col(f"{c}_before") + F.sum(c).over(inside)).alias(f"{c}_sum") for c in names], *names
    )
    return sums.groupBy("node").agg(
        *[
            F.sum(F.when(F.col("enters"), F.col(c) - F.col(f"{c}_sum")).otherwise(F.col(f"{c}_sum"))).alias(c)
            for c in names
        ]
    )


def conversation_trie(turns: DataFrame, convs: DataFrame, finish: int = FINISH, span: int = SPAN) -> DataFrame:
    """The trie of all prefixes of conversations: a row per node, the root without turns included.

    ``turns`` has ``conv_id``, ``depth`` (from 1, without gaps), ``digest`` and ``chars`` as from
    :func:`numbered_turns`; ``convs`` has each ``conv_id``, also of conversations without turns.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null at the root), ``n_convs``, ``n_children``,
    ``n_leaves`` and ``saved_tokens`` (of the subtree; a node saves its characters once for each member but one), and
    ``ends_sha256`` over the ids of the conversations that end in the node.

    Nodes are known by SHA-256 digests of their turns' digests. Enter and exit arcs of all nodes form one list,
    :func:`tour_links`; :func:`list_ranks` ranks it; :func:`subtree_sums` reads subtrees off the prefix sums.

    Without conversations there is no node. Equal conversations meet in all their nodes. A repeated ``conv_id`` in
    ``convs`` counts once. Other columns are not read and may have any name.
    """
    convs = convs.select("conv_id").filter("conv_id IS NOT NULL").distinct()
    rows = prefix_digests(turns.select("conv_id", "depth", "digest", "chars"), span)
    rows = stored(rows.select("conv_id", "depth", "prefix", "chars"), "trie-prefixes")
    nodes = stored(_nodes(rows, convs), "trie-nodes")

    kids = nodes.filter("up IS NOT NULL").groupBy(F.col("up").alias("prefix")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stored(nodes.join(kids, "prefix", "left").fillna(0, ["n_children"]), "trie-parents")
    above = nodes.filter("n_children > 0").select(
        F.col("prefix").alias("up"), F.col("conv_id").alias("parent_conv_id"), F.col("node").alias("parent"), F.col("n_children").alias("siblings")
    )
    below = nodes.filter("up IS NOT NULL").select("node", "conv_id", "up")
    children = stored(join_group_facts(below, above, "up", "siblings").drop("up", "siblings"), "trie-children")

    ranks = list_ranks(tour_links(nodes, children), "trie-tour", finish)
    weights = nodes.select(
        "node",
        (F.col("n_children") == 0).cast("bigint").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"),
    )
    sums = subtree_sums(ranks, weights)

    length = rows.groupBy("conv_id").agg(F.max("depth").alias("depth"))
    ended = rows.join(length, ["conv_id", "depth"], "left_semi").select("prefix", "conv_id")
    ended = ended.unionByName(convs.join(length, "conv_id", "left_anti").select(F.lit(ROOT).alias("prefix"), "conv_id"))
    return (
        nodes.join(sums, "node")
        .join(children.select("node", "parent_conv_id"), "node", "left")
        .join(id_list_digests(ended), "prefix", "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )


def prefix_trie(conversations: DataFrame, finish: int = FINISH, span: int = SPAN) -> DataFrame:
    """:func:`conversation_trie` of rows of ``conv_id``, ``turn``, ``role`` and ``text``."""
    turns = numbered_turns(conversations)
    return conversation_trie(turns, turns.select("conv_id"), finish, span)


def with_shared_heads(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are those of the first conversation of their hundred.

    Of conversation ``c`` the first ``h = crc32(c) mod most`` turns are replaced by as many turns of conversation
    ``c - c mod every``, or all if it has fewer, none if it is absent. Returns the turns and all ids.
    """
    convs = turns.groupBy("conv_id").agg(F.max("depth").alias("n"))
    heads = convs.select(
        "conv_id",
        "n",
        (F.col("conv_id") - F.col("conv_id") % every).alias("base"),
        (F.crc32(F.col("conv_id").cast("string")) % most).alias("h"),
    )
    bases = convs.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    heads = stored(
        heads.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0)))), "trie-heads"
    )
    first = turns.filter((F.col("conv_id") % every == 0) & (F.col("depth") < most)).withColumnRenamed("conv_id", "base")
    copied = heads.filter("taken > 0").join(first, "base").filter("depth <= h").select("conv_id", "depth", "digest", "chars")
    facts = heads.select("conv_id", "n", "h", "taken")
    own = join_group_facts(turns, facts, "conv_id", "n").filter("depth > h")
    own = own.select("conv_id", (F.col("depth") - F.col("h") + F.col("taken")).alias("depth"), "digest", "chars")
    return stored(copied.unionByName(own), "trie-rebuilt"), heads.select("conv_id")
