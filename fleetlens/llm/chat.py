"""Preference pairs rendered for training, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"


def _header(role: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"))


def _body(text: Column) -> Column:
    return F.concat(F.coalesce(text, F.lit("")), F.lit(END))


def _messages(turns: Column, side: str) -> Column:
    return F.flatten(F.transform(turns, lambda t: t[side]))


def _segments(messages: Column, learned_role: str) -> Column:
    """Header and body of each message; loss is taken on the bodies of the learned role."""

    def two(m: Column) -> Column:
        learned = F.coalesce(m["role"] == F.lit(learned_role), F.lit(False))
        return F.array(
            F.struct(_header(m["role"]).alias("text"), F.lit(False).alias("loss")),
            F.struct(_body(m["text"]).alias("text"), learned.alias("loss")),
        )

    return F.flatten(F.transform(messages, two))


def preference_pairs(rows: DataFrame, pair_col: str = "pair_id", learned_role: str = "assistant") -> DataFrame:
    """One row per pair: the shared prompt and two masked completions.

    ``rows`` has the pair's id, ``side`` (``chosen`` or ``rejected``), ``turn``, ``role``, ``text``.
    The prompt is the longest run of first turns that are the same on both sides, rendered once as
    text. ``chosen`` and ``rejected`` are the turns after it, as arrays of ``text`` and ``loss``;
    the texts of an array join to the rendered completion, and loss is taken on the bodies of
    ``learned_role`` only. Two passes of grouping find the prompt: turns are first grouped by pair
    and turn, where the sides meet, and then by pair, as a rendered pair is one row.

    A null role or text renders as empty, though it differs from an empty one in the comparison. A
    null turn comes before all others. Rows that repeat a side, turn, role and text count once;
    several messages of one turn are rendered in the order of role and text. A side without rows
    gives an empty completion, equal sides give two. Other values of ``side`` are left out; a null
    pair id is an id as any other. An empty table gives an empty result. Other columns are not read.
    """
    message = F.struct("role", "text")
    turns = (
        rows.select(F.col(pair_col).alias("pair"), "side", "turn", "role", "text")
        .filter(F.col("side").isin("chosen", "rejected"))
        .groupBy("pair", "turn")
        .agg(
            F.array_sort(F.collect_set(F.when(F.col("side") == "chosen", message))).alias("chosen"),
            F.array_sort(F.collect_set(F.when(F.col("side") == "rejected", message))).alias("rejected"),
        )
    )
    whole = turns.groupBy("pair").agg(
        F.sort_array(F.collect_list(F.struct("turn", "chosen", "rejected"))).alias("turns")
    )
    differing = F.filter(
        F.transform("turns", lambda t, i: F.when(t["chosen"] != t["rejected"], i)), lambda i: i.isNotNull()
    )
    cut = F.coalesce(F.get(differing, F.lit(0)), F.size("turns"))
    parted = whole.withColumn("cut", cut).select(
        "pair",
        "cut",
        F.slice("turns", F.lit(1), F.col("cut")).alias("shared"),
        F.slice("turns", F.col("cut") + 1, F.size("turns")).alias("rest"),
        F.size(F.filter("turns", lambda t: F.size(t["chosen"]) > 0)).alias("n_chosen_turns"),
        F.size(F.filter("turns", lambda t: F.size(t["rejected"]) > 0)).alias("n_rejected_turns"),
    )
    rendered = F.transform(_messages(F.col("shared"), "chosen"), lambda m: F.concat(_header(m["role"]), _body(m["text"])))
    return parted.select(
        F.col("pair").alias(pair_col),
        F.col("cut").alias("n_prompt_turns"),
        "n_chosen_turns",
        "n_rejected_turns",
        F.array_join(rendered, "").alias("prompt"),
        _segments(_messages(F.col("rest"), "chosen"), learned_role).alias("chosen"),
        _segments(_messages(F.col("rest"), "rejected"), learned_role).alias("rejected"),
    )
