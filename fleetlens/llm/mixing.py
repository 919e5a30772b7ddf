"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.numbering import group_spans, numbered, placed, sorted_rows
from fleetlens.session import stored

CAP = 3  # a document is taken this many times at most
TOLERANCE = 1e-7  # of a source's target
ROUNDS = 200
EXACT = "decimal(38,12)"  # sums of decimals are the same in any order, so runs agree


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sources: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = CAP, rounds: int = ROUNDS) -> DataFrame:
    """Add ``target`` to sources (``g``, ``source_size``): their share of all sizes by weight, within ``cap`` times their own.

    Sources in the order of ``g`` weigh as ``weights`` repeating. A share above the cap stops there, and the
    excess goes to the others by weight, until no share is above. Each round is one sum over the table.
    """
    placed_ = numbered(sources.withColumn("all", F.lit("")), "all", [F.col("g")], ["g", "source_size"], "mix-order")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    table = stored(placed_.select("g", "source_size", weight.alias("weight"), (F.col("source_size") * cap).alias("most")), "mix-weights")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    for _ in range(rounds):
        # The level is what one unit of weight gets; it only rises, so what is at its cap stays there.
        over = F.col("most") < F.lit(level) * F.col("weight")
        spent, weighing, n = table.agg(
            F.sum(F.when(over, F.col("most"))), F.sum(F.when(~over, F.col("weight"))), F.count(F.when(over, 1))
        ).first()
        if n == capped or not weighing:
            break
        level, capped = (total - (spent or 0)) / weighing, n
    else:
        raise RuntimeError(f"targets are not settled after {rounds} rounds")
    return table.select("g", "source_size", F.least(F.col("most").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def tilted_rates(
    classes: DataFrame, sources: DataFrame, cap: int = CAP, tolerance: float = TOLERANCE, rounds: int = ROUNDS
) -> DataFrame:
    """The ``tilt`` of each source by Newton steps on the dual of entropy balancing.

    ``classes`` has the documents of a source (``g``) by ``size``, and how many (``n``). Of all rates in
    0 to ``cap`` that give a source its target of words, those nearest to 1 in relative entropy are
    ``min(cap, exp(tilt * size / mean))``, where the tilt solves the convex dual: its gradient is the words taken
    less the target, its curvature what the words not at the cap gain. Each step sums both over all
    classes of all sources; a step that leaves the interval known to hold the solution is replaced
    by its middle. Sums are of decimals, so they do not depend on order.

    The tilt is null where it has no finite solution: a target of nothing, or of all the cap allows.
    """
    found = stored(
        sources.select(
            "*",
            F.lit(0.0).alias("tilt"),
            F.lit(None).cast("double").alias("low"),
            F.lit(None).cast("double").alias("high"),
            ((F.col("target") <= 0) | (F.col("target") >= F.col("source_size") * cap * (1 - tolerance))).alias("fixed"),
            F.lit(False).alias("done"),
        ),
        "mix-tilts",
    )
    for _ in range(rounds):
        free = found.filter("NOT fixed AND NOT done")
        if free.isEmpty():
            return found.select("g", "source_size", "docs", "target", F.when(~F.col("fixed"), F.col("tilt")).alias("tilt"))
        rows = classes.filter("size > 0").join(free, "g")
        share = F.col("size") / F.col("source_size") * F.col("docs")
        rate = F.exp(F.col("tilt") * share)
        words = F.col("n") * F.col("size") * F.least(rate, F.lit(float(cap)))
        gain = F.when(rate < cap, F.col("n") * F.col("size") * share * rate).otherwise(0.0)
        sums = rows.groupBy("g").agg(
            F.sum(words.cast(EXACT)).cast("double").alias("words"), F.sum(gain.cast(EXACT)).cast("double").alias("gain")
        )
        met = found.join(sums, "g", "left")
        short = F.col("words") < F.col("target")
        low, high = F.when(short, F.col("tilt")).otherwise(F.col("low")), F.when(short, F.col("high")).otherwise(F.col("tilt"))
        step = F.col("tilt") + F.when(F.col("gain") > 0, (F.col("target") - F.col("words")) / F.col("gain"))
        # Without the other end of the interval, it is looked for at twice the distance from zero.
        middle = F.coalesce((low + high) / 2, 2 * F.col("tilt") + F.when(short, 1.0).otherwise(-1.0))
        inside = step.isNotNull() & (low.isNull() | (step > low)) & (high.isNull() | (step < high))
        reached = F.abs(F.col("words") - F.col("target")) <= F.col("target") * tolerance
        open_ = ~F.col("fixed") & ~F.col("done")
        found = stored(
            met.select(
                *[c for c in found.columns if c not in ("tilt", "low", "high", "done")],
                F.when(open_ & ~reached, F.when(inside, step).otherwise(middle)).otherwise(F.col("tilt")).alias("tilt"),
                F.when(open_, low).otherwise(F.col("low")).alias("low"),
                F.when(open_, high).otherwise(F.col("high")).alias("high"),
                (F.col("done") | (open_ & reached)).alias("done"),
            ),
            "mix-newton",
        )
    raise RuntimeError(f"tilts are not settled after {rounds} rounds")


def rounded_copies(sizes: np.ndarray, n: np.ndarray, rates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Copies that all documents of a class get, and how many of them get one more.

    Classes of one source come with falling size. Words that a class takes more or less than its rate says are
    carried to the next, so what is left in the end is half of the smallest size, as far as rates that are
    no whole numbers leave room.
    """
    base = np.floor(rates).astype(np.int64)
    room = np.where(rates > base, n, 0)
    extra = np.zeros(len(sizes), dtype=np.int64)
    carry = 0.0
    for i in range(len(sizes)):
        wanted = carry + n[i] * (rates[i] - base[i]) * sizes[i]
        if room[i]:
            extra[i] = min(max(math.floor(wanted / sizes[i] + 0.5), 0), room[i])
        carry = wanted - float(extra[i]) * sizes[i]
    return base, extra


def class_copies(classes: DataFrame, tilts: DataFrame, cap: int = CAP) -> DataFrame:
    """``base`` and ``extra`` copies of each class (``g``, ``size``).

    A source has fewer classes than the root of twice its words, as their sizes all differ, so one
    task takes the classes of a source in order.
    """

    def of_source(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ascending=False, ignore_index=True)
        sizes, n = rows["size"].to_numpy(dtype=np.int64), rows["n"].to_numpy(dtype=np.int64)
        tilt, target = rows["tilt"].iloc[0], rows["target"].iloc[0]
        if pd.isna(tilt):
            rates = np.full(len(sizes), float(cap) if target > 0 else 0.0)
        else:
            mean = rows["source_size"].iloc[0] / rows["docs"].iloc[0]
            rates = np.minimum(np.exp(np.minimum(tilt * (sizes / mean), 50.0)), cap)
        base, extra = rounded_copies(sizes, n, rates)
        return pd.DataFrame({"g": rows["g"], "size": sizes, "rate": rates, "base": base, "extra": extra})

    rows = classes.filter("size > 0").join(tilts, "g")
    return rows.groupBy("g").applyInPandas(of_source, "g string, size long, rate double, base long, extra long")


def entropy_mix(
    docs: DataFrame,
    weights: Sequence[int] = (1, 2, 3),
    cap: int = CAP,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_col: str = "source",
) -> DataFrame:
    """How often each document is taken, so that sources reach their target number of words.

    One row per input row: the id, ``size`` (words), ``source_size``, ``target`` of its source, ``rate``, ``copies`` and ``taken``
    (copies times size). Targets are those of :func:`source_targets`, rates those of :func:`tilted_rates`:
    they depend on size only, so documents of one source and size are one class, and Newton steps
    run over classes. :func:`rounded_copies` turns rates into copies; which documents of a class get
    one copy more is decided by a hash of their id. Every step is deterministic.

    A source's taken words miss its target by half of its smallest document, or by less than the largest where
    whole rates leave no room. Classes are numbered by a sort over ranges, so a class or source may
    hold most documents.

    A null text has no words; documents without words are never taken. A null source is a source, the last. Rows that
    repeat an id count each, and may differ by a copy. An empty table gives an empty result. Other columns are
    not read and may have any name.
    """
    group = F.col(group_col).cast("string")
    # Null last: '=' sorts before '>'.
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), group), F.lit(">")).alias("g"), F.col(id_col).alias("_id"), word_count(F.col(text_col)).alias("size")
    )
    rows = stored(rows, "mix-sizes")
    classes = stored(rows.groupBy("g", "size").agg(F.count(F.lit(1)).alias("n")), "mix-classes")
    sums = classes.groupBy("g").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    targets = source_targets(stored(sums.select("g", "source_size"), "mix-sources"), weights, cap)
    sources = targets.join(sums.select("g", "docs"), "g")
    tilts = tilted_rates(classes, sources, cap)
    copies = class_copies(classes, tilts, cap)

    key = F.concat("g", F.lit("|"), F.lpad(F.col("size").cast("string"), 12, "0"))
    by_class = classes.join(tilts.select("g", "source_size", "target"), "g").join(copies, ["g", "size"], "left")
    facts = by_class.select(key.alias("class"), "source_size", "target", "rate", "base", "extra")
    chance = F.xxhash64(F.col("_id").cast("string"))
    marked = sorted_rows(rows.withColumn("class", key), "class", [chance, F.col("_id")], ["_id", "size"], "mix-sorted")
    spans = group_spans(marked, "class").join(facts, "class")
    copies_of = F.coalesce(F.col("base") + (F.col("pos") < F.col("extra")).cast("bigint"), F.lit(0).cast("bigint"))
    return placed(marked, spans, "class").select(
        F.col("_id").alias(id_col),
        "size",
        "source_size",
        "target",
        F.coalesce("rate", F.lit(0.0)).alias("rate"),
        copies_of.alias("copies"),
        (copies_of * F.col("size")).alias("taken"),
    )
