"""Order-dependent operators in two levels.

A file, a message id or any other group may hold a large part of all rows, so no window here spans
a whole group. Rows are ordered by ``block`` columns, then by ``seq`` inside a block. A block is a
bounded stretch of the input: a scan split, or a fixed range of keys. The first level works inside
one ``(group, block)``; the second level sees one summary row per block. The summary joins back on
the same ``(group, block)`` keys that the first-level window is partitioned by, so the rows are
shuffled once.

The summary branch reads the group, block, seq and measured columns only. Give these operators a
stored table rather than a long chain of expressions when the input is costly to compute.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# More rows than this under one key are spread over several tasks.
HOT_ROWS = 1_000_000
SPREAD = 64
# Keys that are spread number at most this many, as a key is also left whole while it holds less
# than that share of all rows. So the list of them may be broadcast.
HOT_KEYS = 100_000


def block_totals(
    df: DataFrame,
    group: Sequence[str],
    block: Sequence[str],
    measure: Column,
    reverse: bool = False,
) -> DataFrame:
    """One row per (group, block): its ``total``, the sum ``before`` it, and the ``grand`` total.

    With ``reverse`` the sum before a block is that of the later blocks.
    """
    totals = df.groupBy(*group, *block).agg(F.sum(measure).alias("total"))
    order = [F.col(c).desc() if reverse else F.col(c).asc() for c in block]
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *group,
        *block,
        "total",
        F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"),
        F.sum("total").over(whole).alias("grand"),
    )


def running_total(
    df: DataFrame,
    group: Sequence[str],
    block: Sequence[str],
    seq: str,
    measure: Column,
    out: str,
    keep_blocks: Column | None = None,
    reverse: bool = False,
    grand: str | None = None,
) -> DataFrame:
    """Sum of ``measure`` over the earlier rows of the group, this row not included.

    ``keep_blocks`` is a condition on the columns of :func:`block_totals`; rows of other blocks are
    dropped before the window, which is how a tail reads only the end of a file.
    """
    facts = block_totals(df, group, block, measure, reverse)
    if keep_blocks is not None:
        facts = facts.where(keep_blocks)
    facts = facts.select(*group, *block, F.col("before").alias("_before"), F.col("grand").alias("_grand"))
    inside = (
        Window.partitionBy(*group, *block)
        .orderBy(F.col(seq).desc() if reverse else F.col(seq).asc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    total = F.col("_before") + F.coalesce(F.sum(measure).over(inside), F.lit(0))
    extra = [F.col("_grand").alias(grand)] if grand else []
    return df.join(facts, [*group, *block]).select(*df.columns, total.alias(out), *extra)


def previous_value(
    df: DataFrame,
    group: Sequence[str],
    block: Sequence[str],
    seq: str,
    value: Column,
    out: str,
    initial: DataFrame | None = None,
    summary: DataFrame | None = None,
) -> DataFrame:
    """``value`` of the preceding row of the group; null on the first row.

    ``value`` is of a fixed-width type, so that blocks are summed up by hash, and never null. Where
    only equality counts, give a hash of a text. ``initial`` has the group columns and ``v``, the value
    before the first row of a group. It joins the block summary, not the rows. ``summary`` are the same rows where they
    cost less to read, for the block summary.
    """
    edges = (df if summary is None else summary).groupBy(*group, *block).agg(F.max_by(value, F.col(seq)).alias("_edge"))
    whole = Window.partitionBy(*group).orderBy(*block)
    edges = edges.select(*group, *block, F.lag("_edge").over(whole).alias("_edge"))
    if initial is not None:
        edges = edges.join(initial.select(*group, F.col("v").alias("_initial")), [*group], "left").select(
            *group, *block, F.coalesce("_edge", "_initial").alias("_edge")
        )
    inside = Window.partitionBy(*group, *block).orderBy(seq)
    # Every block has its edge; a left join can be left out where the result is not asked for.
    return df.join(edges, [*group, *block], "left").select(
        *df.columns, F.coalesce(F.lag(value).over(inside), F.col("_edge")).alias(out)
    )


def _carried_in(
    rows: DataFrame, group: Sequence[str], block: Sequence[str], seq: str, value: Column, initial: DataFrame | None = None
) -> DataFrame:
    """``_edge``, the latest non-null ``value`` before a block, of each (group, block) that has one."""
    places = rows.groupBy(*group, *block).agg(F.max(F.when(value.isNotNull(), F.col(seq))).alias("_at"))
    earlier = Window.partitionBy(*group).orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    from_block = [f"_from_{c}" for c in block]
    place = F.when(F.col("_at").isNotNull(), F.struct(*[F.col(c).alias(f) for c, f in zip(block, from_block)], "_at"))
    places = places.select(*group, *block, F.last(place, ignorenulls=True).over(earlier).alias("_place"))
    values = rows.where(value.isNotNull()).select(
        *group, *[F.col(c).alias(f) for c, f in zip(block, from_block)], F.col(seq).alias("_at"), value.alias("_edge")
    )
    placed = places.where(F.col("_place").isNotNull()).select(*group, *block, "_place.*")
    edges = placed.join(values, [*group, *from_block, "_at"]).select(*group, *block, "_edge")
    if initial is None:
        return edges
    first = places.where(F.col("_place").isNull()).select(*group, *block)
    before = initial.select(*group, F.col("v").alias("_edge"))
    return edges.unionByName(first.join(before, [*group]).select(*group, *block, "_edge"))


def carry_last(
    df: DataFrame,
    group: Sequence[str],
    block: Sequence[str],
    seq: str,
    value: Column,
    out: str,
    within: Column | None = None,
) -> DataFrame:
    """The latest non-null ``value`` up to and including this row of the group.

    The block summary holds places only, which are numbers and so summed up by hash; the values are
    fetched from the rows at those places. Nothing is carried from one block to another by rows
    outside ``within``.
    """
    edges = _carried_in(df if within is None else df.where(within), group, block, seq, value)
    inside = (
        Window.partitionBy(*group, *block)
        .orderBy(seq)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    carried = F.last(value, ignorenulls=True).over(inside)
    return df.join(edges, [*group, *block], "left").select(
        *df.columns, F.coalesce(carried, F.col("_edge")).alias(out)
    )


def carry_last_by_block(
    df: DataFrame,
    group: Sequence[str],
    block: Sequence[str],
    seq: str,
    value: Column,
    out: str,
    within: Column | None = None,
    initial: DataFrame | None = None,
) -> DataFrame:
    """:func:`carry_last` for rows that later steps take by block, shuffled by block alone.

    What is carried into a block comes as rows before its own, not by a join on group and block, so a window
    over the block needs no further shuffle. ``initial`` has the group columns and ``v``, the value
    before the first row of a group.
    """
    edges = _carried_in(df if within is None else df.where(within), group, block, seq, value, initial)
    own = df.select(*df.columns, value.alias("_value"), F.lit(True).alias("_own"))
    carried_in = edges.select(*group, *block, F.col("_edge").alias("_value"), F.lit(False).alias("_own"))
    rows = own.unionByName(carried_in, allowMissingColumns=True).repartition(*block)
    # Sorted by the group first: its columns tell rows apart sooner than those of the block.
    inside = (
        Window.partitionBy(*group, *block)
        .orderBy("_own", seq)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    carried = rows.withColumn(out, F.last("_value", ignorenulls=True).over(inside))
    return carried.where("_own").select(*df.columns, out)


def first_in_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, salt: Column, spread: int = SPREAD
) -> DataFrame:
    """The first ``n`` rows of each group with their ``rank``.

    Every group is ranked in ``spread`` parts first, so a task sees a part of a hot group, and the
    last step sees ``n * spread`` rows per group at most. ``salt`` is a hash of row identity.
    """
    part = Window.partitionBy(*group, "_part").orderBy(*order)
    whole = Window.partitionBy(*group).orderBy(*order)
    return (
        df.withColumn("_part", F.pmod(salt, F.lit(spread)))
        .withColumn("rank", F.row_number().over(part))
        .where(F.col("rank") <= n)
        .drop("_part", "rank")
        .withColumn("rank", F.row_number().over(whole))
        .where(F.col("rank") <= n)
    )


def row_hash(df: DataFrame) -> Column:
    """A hash that tells rows apart, equal rows of different tasks too."""
    plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(F.spark_partition_id(), *plain)


def join_group_facts(
    rows: DataFrame,
    facts: DataFrame,
    key: str,
    n: str,
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    hot_keys: int = HOT_KEYS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Attach the one facts row of a key to all rows of that key, hot keys spread over many tasks.

    ``facts[n]`` is the number of rows under the key. Keys of more than ``hot_rows`` rows, and of more than
    one in ``hot_keys`` of all rows, get a salt for each so many rows: their facts are repeated and
    their rows salted. There are ``hot_keys`` such keys at most. All other keys join as they are.
    ``sizes`` has the key and the number of rows alone, where the facts cost more to compute.
    """
    sizes = facts.select(key, n) if sizes is None else sizes.select(key, n)
    share = sizes.agg(F.sum(n) / hot_keys).scalar()
    limit = F.greatest(F.lit(float(hot_rows)), F.coalesce(share, F.lit(0.0)))
    salts = F.when(F.col(n) > limit, F.ceil(F.col(n) / limit)).otherwise(1).cast("bigint")
    hot = sizes.withColumn("_salts", salts).where(F.col("_salts") > 1).select(key, "_salts")
    salted_rows = rows.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.coalesce(F.pmod(row_hash(rows), F.col("_salts")), F.lit(0).cast("bigint"))
    )
    repeated = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)))
    return salted_rows.drop("_salts").join(repeated, [key, "_salt"], how).drop("_salt")
