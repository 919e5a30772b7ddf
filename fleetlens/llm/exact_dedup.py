"""Exact duplicates with skew-safe combining, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.session import stored

SALTS = 32


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """Group equal texts; of each group the row with the largest id stays.

    One row per input row: the id, ``keep_id``, ``group_size`` (rows), ``kept``, ``text_sha256``.

    Winners are combined in three steps, and each groups by the whole text beside its digest: the
    partial aggregate removes copies inside a task before anything is shuffled; a digest's rows are
    then merged in ``salts`` groups; at last the salt winners of a digest are combined, ``salts``
    rows at most. Rows find their winner by digest alone, without moving their text. Only if two
    different texts share a digest, which a count shows, do the rows of such digests meet their
    winner by text as well.

    A null text counts as empty. Rows that repeat an id are one document: all count in
    ``group_size`` and all or none stay. A null id is never kept while its group has another; a
    group of null ids only has a null ``keep_id`` and stays. An empty table gives an empty result.
    Other columns of the input are not read and may have any name.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("body"), F.sha2(text, 256).alias("sha"))
    salt = F.pmod(F.xxhash64("id", F.spark_partition_id()), F.lit(salts))
    merged = (
        rows.withColumn("salt", salt)
        .groupBy("sha", "salt", "body")
        .agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n"))
    )
    # The salt must not survive into the plan's choice of partitioning: each digest meets once more.
    winners = merged.groupBy("sha", "body").agg(F.max("top").alias("keep_id"), F.sum("n").alias("group_size"))
    classes = stored(
        winners.groupBy("sha").agg(
            F.count(F.lit(1)).alias("texts"),
            F.max("keep_id").alias("keep_id"),
            F.max("group_size").alias("group_size"),
        ),
        "exact-classes",
    )
    single = rows.join(classes.filter("texts = 1").drop("texts"), "sha")
    found = single.select("id", "keep_id", "group_size", "sha")
    if not classes.filter("texts > 1").isEmpty():
        shared = classes.filter("texts > 1").select("sha")
        by_text = rows.join(shared, "sha", "left_semi").join(winners, ["sha", "body"])
        found = found.unionByName(by_text.select("id", "keep_id", "group_size", "sha"))
    return found.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
