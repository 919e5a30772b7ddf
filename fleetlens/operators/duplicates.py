"""Files with equal content.

A file row has ``root``, ``subpath``, ``size`` and ``mtime``, later also ``md5``. Only these columns
are shuffled; content is hashed where it is read and never moves. One size or digest may belong to
a large part of all files, so groups are counted with partial aggregation, members are joined to
their group with hot groups salted, and no group is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.ordered import HOT_ROWS, first_in_group, join_group_facts
from fleetlens.session import stored

IDENTITY = ["root", "subpath"]
PLACE = "walk_place"
DELETE_ALL = "X"


def member_order(files: DataFrame) -> Column:
    """Roots in order, then names per directory level, as a depth-first walk meets them."""
    if PLACE in files.columns:
        return F.col(PLACE)
    return F.struct(F.col("root").alias("root"), F.split("subpath", "/").alias("names"))


def in_walk_order(files: DataFrame) -> DataFrame:
    if PLACE in files.columns:
        return files.orderBy(PLACE)
    return files.orderBy("root", F.split("subpath", "/"))


def number_files(files: DataFrame) -> DataFrame:
    """Add ``walk_place``, a number that rises in walk order, and store the files in that order.

    Paths are sorted once. After that the operators here compare and shuffle one long in the place of
    a root and a list of names, and find first members by hash instead of by sorting. Numbers rise
    but have gaps. The table is stored, since rows computed again might be numbered differently.

    Nulls come first, as in the sort. A path that is there twice gets two numbers, so that the plan
    keeps one of its rows, where it keeps both without numbers.
    """
    ordered = in_walk_order(files.drop(PLACE))
    return stored(ordered.withColumn(PLACE, F.monotonically_increasing_id()), "numbered")


def skip_version_control(files: DataFrame) -> DataFrame:
    """Drop empty files and everything below ``.git`` and ``.svn`` directories."""
    folders = F.concat(F.lit("/"), F.col("subpath"))
    hidden = folders.contains("/.git/") | folders.contains("/.svn/")
    return files.where((F.col("size") > 0) & ~hidden)


def size_candidates(files: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Files whose size occurs more than once; no other file can have a duplicate."""
    sizes = files.groupBy("size").agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
    return join_group_facts(files, sizes, "size", "_n", "inner", hot_rows).select(*files.columns)


def reuse_digest(files: DataFrame, previous: DataFrame) -> DataFrame:
    """Take over the digest of an earlier index where path, size and mtime all agree."""
    known = previous.where(F.col("md5").isNotNull()).select(*IDENTITY, "size", "mtime", "md5")
    return files.drop("md5").join(known, [*IDENTITY, "size", "mtime"], "left")


def duplicate_groups(files: DataFrame) -> DataFrame:
    """One row per digest that more than one file has: count, bytes, and the first member."""
    if PLACE in files.columns:
        return _numbered_groups(files)
    return (
        files.where(F.col("md5").isNotNull())
        .groupBy("md5")
        .agg(
            F.count("*").alias("n"),
            F.sum("size").alias("bytes"),
            F.min(F.struct(member_order(files).alias("place"), F.col("subpath"))).alias("_first"),
        )
        .where(F.col("n") > 1)
        .select(
            "md5",
            "n",
            "bytes",
            F.col("_first.place.root").alias("first_root"),
            F.col("_first.subpath").alias("first_subpath"),
        )
    )


def _numbered_groups(files: DataFrame) -> DataFrame:
    """The first member is a minimum of numbers; its path is fetched from the row at that place.

    All that is aggregated is of fixed width, so groups are found by hash. The path is not part of that.
    """
    groups = (
        files.where(F.col("md5").isNotNull())
        .groupBy("md5")
        .agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min(PLACE).alias(PLACE))
        .where(F.col("n") > 1)
    )
    paths = files.select(PLACE, F.col("root").alias("first_root"), F.col("subpath").alias("first_subpath"))
    return groups.join(paths, PLACE).select("md5", "n", "bytes", "first_root", "first_subpath")


def _group_sizes(files: DataFrame) -> DataFrame:
    return files.where(F.col("md5").isNotNull()).groupBy("md5").agg(F.count("*").alias("n")).where("n > 1")


def duplicate_members(files: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per member of a duplicate group, with the size of the group."""
    members = join_group_facts(files, _group_sizes(files), "md5", "n", "inner", hot_rows)
    return members.select(*files.columns, "n")


def duplicate_count(files: DataFrame) -> DataFrame:
    """The number of duplicate groups, as one row."""
    return _group_sizes(files).agg(F.count("*").alias("groups"))


def dedup_plan(files: DataFrame, keep: int | str | None = 1, hot_rows: int = HOT_ROWS) -> DataFrame:
    """What to do with each member of a duplicate group; nothing is deleted here.

    ``keep`` is the number of the member to keep, counted in walk order. ``"X"`` deletes all, and
    ``0`` or ``None`` skips. A group with fewer members than ``keep`` is skipped.
    """
    members = duplicate_members(files, hot_rows)
    if not keep:
        return members.withColumn("action", F.lit("skip"))
    if keep == DELETE_ALL:
        return members.withColumn("action", F.lit("delete"))
    with_md5 = files.where(F.col("md5").isNotNull())
    if keep == 1:
        kept = with_md5.groupBy("md5").agg(F.count("*").alias("n"), F.min(member_order(files)).alias("_kept"))
    else:
        ranked = first_in_group(with_md5, ["md5"], [member_order(files)], keep, F.xxhash64(*IDENTITY))
        nth = ranked.where(F.col("rank") == keep).select("md5", member_order(files).alias("_kept"))
        kept = _group_sizes(files).join(nth, "md5", "left")
    members = join_group_facts(files, kept.where("n > 1"), "md5", "n", "inner", hot_rows)
    action = (
        F.when(F.col("_kept").isNull(), "skip")
        .when(F.col("_kept") == member_order(files), "keep")
        .otherwise("delete")
    )
    return members.select(*files.columns, "n", action.alias("action"))
