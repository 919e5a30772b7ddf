"""Aliases of hexadecimal ids."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.lines import FILE, KEY
from fleetlens.operators.ordered import join_group_facts, row_hash
from fleetlens.session import stored

# The line that ends an alias file, and the comment mark.
END_MARK = "_EOF_"
COMMENT = ";"
_RUN = "[0-9a-f]+"  # fixed value: what an id and an alias consist of
IN_PLACE = 200  # up to this many aliases are part of the plan


def read_aliases(lines: DataFrame) -> DataFrame:
    """``(alias, label, seq)`` of an alias file: blank and comment lines skipped, ``_EOF_`` ends it.

    The last label of an alias wins, at the place of its first mention.
    """
    rows = lines.withColumn("value", F.btrim("value", F.lit(" \t\n\r\0\x0b")))
    ends = rows.where(F.col("value") == END_MARK).groupBy(*FILE).agg(F.min(F.struct(*KEY[1:])).alias("_end"))
    place = F.struct(*KEY[1:])
    tokens = F.split("value", r"\s+")
    entries = (
        rows.join(ends, FILE, "left")
        .where(F.col("_end").isNull() | (place < F.col("_end")))
        .where((F.col("value") != "") & ~F.col("value").startswith(COMMENT))
        .select(
            F.get(tokens, F.lit(0)).alias("alias"),
            F.coalesce(F.get(tokens, F.lit(1)), F.lit("")).alias("label"),
            F.struct(*KEY).alias("seq"),
        )
    )
    return entries.groupBy("alias").agg(
        F.max_by("label", "seq").alias("label"), F.min("seq").alias("seq")
    )


def in_order(aliases: DataFrame) -> DataFrame:
    return aliases.orderBy("alias")


def _prefixes(text: Column, lengths: list[int]) -> Column:
    """The beginnings of all hexadecimal runs in a text, of the given lengths."""
    starts = F.transform(
        F.regexp_extract_all(text, F.lit(f"({_RUN})"), F.lit(1)),
        lambda run: F.array(*[F.when(F.length(run) >= n, F.substring(run, 1, n)) for n in lengths]),
    )
    return F.array_distinct(F.array_compact(F.flatten(starts)))


def _followers(aliases: DataFrame, lengths: list[int], rounds: int = 64) -> DataFrame | None:
    """For each alias those later ones that its label brings in, directly or through another label."""
    heads = aliases.select("alias", "seq", F.explode(_prefixes(F.col("label"), lengths)).alias("next"))
    ends = aliases.select(F.col("alias").alias("next"), F.col("seq").alias("next_seq"))
    step = heads.join(ends, "next").where("next_seq > seq").select("alias", "next")
    if step.isEmpty():  # as a rule labels are names, and hold no ids
        return None
    known = new = step = stored(step.distinct(), "alias-steps")
    onward = step.select(F.col("alias").alias("next"), F.col("next").alias("last"))
    for _ in range(rounds):
        further = new.join(onward, "next").select("alias", F.col("last").alias("next")).distinct()
        new = stored(further.join(known, ["alias", "next"], "left_anti"), "alias-steps")
        if new.isEmpty():
            return known
        known = known.unionByName(new)
    raise ValueError(f"labels bring in aliases over more than {rounds} steps")


Entry = tuple[int, str, str]  # place, alias and label


def _brought_in(entries: list[Entry]) -> dict[str, list[Entry]]:
    """Each alias with itself and the later ones that its label brings in, directly or through another label."""
    found: dict[str, list[Entry]] = {}
    by_alias = {entry[1]: entry for entry in entries}
    lengths = sorted({len(alias) for alias in by_alias})
    for entry in reversed(entries):  # so what a label brings in is known
        runs = re.findall(_RUN, entry[2])
        heads = {run[:n] for run in runs for n in lengths if len(run) >= n}
        later = [by_alias[h] for h in heads if h in by_alias and by_alias[h][0] > entry[0]]
        found[entry[1]] = sorted({entry, *(e for first in later for e in found[first[1]])})
    return found


def _annotated_in_place(df: DataFrame, text: str, entries: list[Entry], out: str) -> DataFrame:
    """Each row by itself: runs look their beginning up in a map of all aliases, by the shortest alias' length."""
    shortest = min(len(alias) for _, alias, _ in entries)
    heads: dict[str, list[Column]] = {}
    for alias, brought in _brought_in(entries).items():
        steps = F.array(*[F.struct(F.lit(p).alias("seq"), F.lit(a).alias("alias"), F.lit(lb).alias("label")) for p, a, lb in brought])
        heads.setdefault(alias[:shortest], []).append(F.struct(F.lit(alias).alias("head"), steps.alias("steps")))
    known = F.create_map(*[c for head, found in heads.items() for c in (F.lit(head), F.array(*found))])

    def steps_of(run: Column) -> Column:
        near = F.filter(F.try_element_at(known, F.substring(run, 1, shortest)), lambda c: run.startswith(c["head"]))
        return F.flatten(F.transform(near, lambda c: c["steps"]))

    runs = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(f"({_RUN})"), F.lit(1)))
    steps = F.array_sort(F.array_distinct(F.flatten(F.array_compact(F.transform(runs, steps_of)))))
    return df.select("*", F.coalesce(F.aggregate(steps, F.col(text), _annotate), F.col(text)).alias(out))


def _annotate(result: Column, entry: Column) -> Column:
    pattern = F.concat(F.lit("(?d)(^|[^0-9a-f])("), entry["alias"], F.lit(")([0-9a-f]*)"))
    label = F.regexp_replace(entry["label"], r"([\\$])", r"\\$1")
    replacement = F.concat(F.lit("$1$2$3 "), label)
    return F.when(result.contains(entry["alias"]), F.regexp_replace(result, pattern, replacement)).otherwise(result)


def annotate_ids(
    df: DataFrame, text: str, aliases: DataFrame, out: str = "annotated", in_place: int = IN_PLACE, rounds: int = 64
) -> DataFrame:
    """Add ``text`` with a label after each hexadecimal run that starts with an alias.

    Aliases apply one after the other, each to the text the earlier ones left, labels included. An
    alias that is no hexadecimal text starts no run. Runs one job that fetches up to ``in_place`` aliases and one
    more. If those are all, they become part of the plan, and rows are rewritten where they are, without a join.
    Otherwise texts meet the aliases in a join on the
    beginnings of their runs, one for each length of an alias; each distinct text is then rewritten
    by the few aliases it has. That runs jobs for the lengths and for aliases within labels, which may bring in each other
    over ``rounds`` steps.
    """
    usable = aliases.where(F.col("alias").rlike(f"^{_RUN}$")).select("alias", "label", "seq")
    few = usable.limit(in_place + 1).collect()
    if len(few) <= in_place:
        if not few:
            return df.withColumn(out, F.col(text))
        ranked = sorted(few, key=lambda r: (r["seq"], r["alias"]))
        return _annotated_in_place(df, text, [(i, r["alias"], r["label"]) for i, r in enumerate(ranked)], out)
    usable = stored(usable, "aliases")
    lengths = sorted(r["n"] for r in usable.select(F.length("alias").alias("n")).distinct().collect())
    texts = df.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("_text")).agg(F.count("*").alias("_n"))
    hits = texts.select("_text", F.explode(_prefixes(F.col("_text"), lengths)).alias("alias")).join(usable, "alias")
    entries = hits.select("_text", "alias", "label", "seq")
    followers = _followers(usable, lengths, rounds)
    if followers is not None:
        later = followers.join(usable.withColumnRenamed("alias", "next"), "next")
        brought = hits.select("_text", "alias").join(later, "alias")
        entries = entries.unionByName(brought.select("_text", F.col("next").alias("alias"), "label", "seq"))
    found = entries.groupBy("_text").agg(F.sort_array(F.collect_set(F.struct("seq", "alias", "label"))).alias("_entries"))

    rewritten = found.select("_text", F.aggregate("_entries", F.col("_text"), _annotate).alias(out))
    # Every text has its facts, so one that is very frequent is spread whether it has an alias or not.
    facts = texts.join(rewritten, "_text", "left")
    rows = df.withColumn("_text", F.coalesce(F.col(text), F.concat(F.lit("none "), row_hash(df).cast("string"))))
    joined = join_group_facts(rows, facts, "_text", "_n", "left", sizes=texts)
    return joined.select(*df.columns, F.coalesce(out, F.col(text)).alias(out))


def resolve_alias(df: DataFrame, id_column: str, aliases: DataFrame, out: str = "resolved") -> DataFrame:
    """Add the hexadecimal id behind a label; the first alias with that label, else the id itself."""
    ids = aliases.groupBy(F.col("label").alias("_label")).agg(F.min_by("alias", "seq").alias("_alias"))
    joined = df.join(ids, F.col(id_column) == F.col("_label"), "left")
    return joined.select(*df.columns, F.coalesce("_alias", F.col(id_column)).alias(out))
