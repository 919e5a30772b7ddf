"""Merkle manifests of a dataset, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.numbering import numbered
from fleetlens.session import stored

RUN = 3  # nodes hashed into one parent
LEVELS = 6  # levels built inside one window partition, which holds RUN ** LEVELS nodes
STEP = "array<struct<left:string,right:string>>"


def record_digest(columns: Sequence[Column]) -> Column:
    """SHA-256 of the values one after another, each as UTF-8 byte count, colon and value; ``-`` for null."""
    text = [c.cast("string") for c in columns]
    framed = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]
    return F.sha2(F.concat(*framed), 256)


def _levels(nodes: DataFrame) -> DataFrame:
    """Build up to ``LEVELS`` levels over nodes (``g``, ``pos``, ``n``, ``digest``, others).

    Adds ``block``, ``low`` (siblings of the node and of its ancestors below the block's top, lowest
    first) and ``top`` (on the first row of a block, its digest). On each level the row of a node's
    first leaf holds its digest. Runs do not cross blocks, so siblings are at fixed offsets of the
    level's width in the window; slot and number of nodes mask what lies beyond the run.
    """
    block = Window.partitionBy("g", "block").orderBy("pos")
    so_far = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = nodes.withColumn("block", F.floor(F.col("pos") / RUN**LEVELS))
    rows = rows.withColumn("digest_0", F.col("digest"))
    own = [c for c in rows.columns if c != "digest_0"]
    for level in range(LEVELS):
        width, digest = RUN**level, F.col(f"digest_{level}")
        index = F.floor(F.col("pos") / width)
        count, slot = F.ceil(F.col("n") / width), index % RUN
        first = (F.col("pos") % width == 0) & (count > 1)
        before = [F.when(slot >= k, F.lag(digest, k * width).over(block)) for k in range(RUN - 1, 0, -1)]
        after = [
            F.when((slot + k < RUN) & (index + k < count), F.lead(digest, k * width).over(block))
            for k in range(1, RUN)
        ]
        step = F.struct(F.concat_ws("", *before).alias("left"), F.concat_ws("", *after).alias("right"))
        rows = rows.select(
            *own,
            *[c for c in rows.columns if c.startswith("step_")],
            F.when(first, step).alias(f"step_{level}"),
            digest,
        )
        parent = F.sha2(F.concat(digest, F.col(f"step_{level}.right")), 256)
        rows = rows.withColumn(
            f"digest_{level + 1}", F.when(count <= 1, digest).when(F.col("pos") % (RUN * width) == 0, parent)
        ).drop(f"digest_{level}")
    # All leaves of a node take its siblings from the row of its first leaf.
    steps = [F.last(f"step_{level}", ignorenulls=True).over(so_far) for level in range(LEVELS)]
    applies = [F.col("n") > RUN**level for level in range(LEVELS)]
    path = F.array(*[F.when(use, step) for use, step in zip(applies, steps)])
    return rows.select(*own, path.alias("low"), F.col(f"digest_{LEVELS}").alias("top")).withColumn(
        "low", F.filter("low", lambda s: s.isNotNull()).cast(STEP)
    )


def climb(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Build all levels of the groups' trees: the stored passes, and ``g`` and ``digest`` of each group's root.

    Only the tops of blocks go to the next pass, so a pass has 729 times fewer rows than the one before.
    """
    passes = []
    while not passes or not nodes.filter("n > 1").isEmpty():
        built = stored(_levels(nodes), f"{name}-levels")
        passes.append(built)
        nodes = built.filter(F.col("pos") == F.col("block") * RUN**LEVELS).select(
            "g",
            F.col("block").alias("pos"),
            F.ceil(F.col("n") / RUN**LEVELS).alias("n"),
            F.col("top").alias("digest"),
        )
    return passes, nodes.select("g", "digest")


def descend(passes: Sequence[DataFrame], roots: DataFrame) -> DataFrame:
    """Rows of the first pass with their group's facts and the whole ``path`` to the root.

    ``roots`` has ``g``, the ``path`` above a group's root, and facts. ``path`` lists for each level the digests left
    and right of the ancestor in its run. Each join is by group and block, 729 rows at most under one key.
    """
    facts = [c for c in roots.columns if c not in ("g", "path")]
    upper = roots.select("g", F.lit(0).cast("bigint").alias("block"), F.col("path").alias("high"), *facts)
    for built in reversed(passes):
        met = built.join(upper, ["g", "block"]).withColumn("path", F.concat("low", "high"))
        upper = met.select("g", F.col("pos").alias("block"), F.col("path").alias("high"), *facts)
    return met.drop("low", "high", "top", "block", "n")


def merkle_manifest(
    docs: DataFrame,
    fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_col: str = "doc_id",
    group_col: str = "source",
    altered: dict[str, Column] | None = None,
) -> DataFrame:
    """The hash tree over all rows: a tree per group, and one over the groups' roots.

    One row per input row: the id, ``leaf``, ``altered_leaf``, ``subroot``, ``root`` and ``path``, from which
    :func:`proof_digest` and :func:`folded` derive. Leaves are digests of ``fields``. Per group they ascend by id, null
    first, rows of equal id by leaf; ``RUN`` consecutive nodes have one parent, the last run may be shorter, and a lone
    leaf is its group's root. Groups are ordered by UTF-8 bytes, null first. ``altered`` replaces fields for
    ``altered_leaf``, the leaf of a changed row.

    Rows are numbered by a sort over ranges, and windows hold 729 rows of a group, so a group of any size is
    spread. Siblings reach the leaves from the top down, a join by block on each pass. Text is read once, where it is
    hashed, and never shuffled.

    Null fields count as ``-``, unlike empty ones. Equal rows are leaves of their own. An empty table gives an empty result. Columns
    other than the named ones are not read and may have any name.
    """
    plain = {f: F.col(f) for f in fields}
    group = F.col(group_col).cast("string")
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("g"),
        F.col(id_col).alias("_id"),
        record_digest([plain[f] for f in fields]).alias("digest"),
        record_digest([(altered or {}).get(f, plain[f]) for f in fields]).alias("altered_leaf"),
    )
    leaves = stored(leaves, "merkle-leaves")
    order = [F.col("_id").asc_nulls_first(), F.col("digest"), F.col("altered_leaf")]
    nodes = numbered(leaves, "g", order, ["_id", "digest", "altered_leaf"], "merkle-sorted")
    passes, tops = climb(nodes, "merkle-groups")

    members = stored(tops.select(F.lit("").alias("g"), F.col("g").alias("member"), "digest"), "merkle-subroots")
    groups = numbered(members, "g", [F.col("member")], ["member", "digest"], "merkle-members")
    above, top = climb(groups, "merkle-root")
    whole = top.select("g", F.array().cast(STEP).alias("path"), F.col("digest").alias("root"))
    roots = descend(above, whole).select(F.col("member").alias("g"), "path", F.col("digest").alias("subroot"), "root")
    return descend(passes, roots).select(
        F.col("_id").alias(id_col), F.col("digest").alias("leaf"), "altered_leaf", "subroot", "root", "path"
    )


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf has with these siblings."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))
