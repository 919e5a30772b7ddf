"""Language of texts by prediction by partial matching over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.textbytes import lower_table, member_table, text_batches

ORDER = 4
DOCS_PER_LANGUAGE = 300
UNKNOWN = "und"
BEFORE = 0x0A  # a text is taken to follow line ends
KNOWN_WINDOWS = 1_000_000


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether a document is kept from learning; a null id is."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(True))


def windows(data: np.ndarray, bounds: np.ndarray, order: int) -> np.ndarray:
    """For each byte, lowered, the number made of it and the ``order`` bytes before it in its text."""
    sizes = np.diff(bounds)
    padded = np.full(len(data) + order * len(sizes), BEFORE, dtype=np.uint8)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(data)) + order * (row + 1)
    padded[at] = lower_table()[data]
    out = np.zeros(len(data), dtype=np.uint64)
    for back in range(order, -1, -1):
        out = (out << np.uint64(8)) | padded[at - back]
    return out


class Trees:
    """Context trees of all languages: how often each byte follows each context of up to ``order`` bytes.

    A byte that a context has not seen costs the context's escape, the share of its different bytes
    in all it has seen and those, and is then looked for in the context that is one byte shorter. A context
    that was never seen costs nothing. After the empty context all 256 bytes are equally likely.
    The statistics stay as learned while texts are scored.
    """

    def __init__(self, grams: dict[str, list[tuple[np.ndarray, np.ndarray]]], order: int) -> None:
        self.languages, self.order = sorted(grams), order
        self.levels = []
        for language in self.languages:
            levels = []
            for gram, count in grams[language]:
                by = np.argsort(gram)
                gram, count = gram[by], count[by].astype(np.float64)
                context, first = np.unique(gram >> np.uint64(8), return_index=True)
                total = np.add.reduceat(count, first)
                distinct = np.diff(np.append(first, len(gram)))
                levels.append((gram, count, context, total, distinct.astype(np.float64)))
            self.levels.append(levels)

    def code_lengths(self, window: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each window after the bytes before it; a column per language."""
        out = np.zeros((len(window), len(self.languages)))
        for column, levels in enumerate(self.levels):
            bits = out[:, column]
            open_ = np.arange(len(window))
            for order in range(self.order, -1, -1):
                gram, count, context, total, distinct = levels[order]
                value = window[open_] & np.uint64((1 << 8 * (order + 1)) - 1)
                at = np.minimum(np.searchsorted(context, value >> np.uint64(8)), len(context) - 1)
                seen = context[at] == value >> np.uint64(8)
                cell = np.minimum(np.searchsorted(gram, value), len(gram) - 1)
                hit = gram[cell] == value
                whole = total[at] + distinct[at]
                bits[open_[hit]] -= np.log2(count[cell[hit]] / whole[hit])
                escaped = seen & ~hit
                bits[open_[escaped]] -= np.log2(distinct[at[escaped]] / whole[escaped])
                open_ = open_[~hit]
            bits[open_] += 8.0
        return out


class Scorer:
    """Code lengths of whole texts; each different window is looked up once a task."""

    def __init__(self, trees: Trees, limit: int = KNOWN_WINDOWS) -> None:
        self.trees, self.limit = trees, limit
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.bits = np.zeros((0, len(self.trees.languages)))

    def totals(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        found, inverse = np.unique(windows(data, bounds, self.trees.order), return_inverse=True)
        if len(self.known) > self.limit:
            self.clear()
        new = found[~np.isin(found, self.known, assume_unique=True)]
        if len(new):
            known = np.concatenate([self.known, new])
            by = np.argsort(known)
            self.bits = np.concatenate([self.bits, self.trees.code_lengths(new)])[by]
            self.known = known[by]
        at = np.searchsorted(self.known, found)
        out = np.zeros((len(bounds) - 1, len(self.trees.languages)))
        filled = np.flatnonzero(np.diff(bounds))
        for column in range(out.shape[1]):
            per_byte = self.bits[at, column][inverse]
            out[filled, column] = np.add.reduceat(per_byte, bounds[:-1][filled]) if len(filled) else 0
        return out


def have_letters(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    sizes = np.diff(bounds)
    out = np.zeros(len(sizes), dtype=bool)
    filled = np.flatnonzero(sizes)
    if len(filled):
        ascii_letter = member_table(bytes(b for b in range(128) if chr(b).isalpha()))[data]
        out[filled] = np.logical_or.reduceat(ascii_letter, bounds[:-1][filled])
        for row in filled[~out[filled]]:
            text = data[bounds[row] : bounds[row + 1]].tobytes().decode("utf-8")
            out[row] = any(c.isalpha() for c in text)
    return out


def fit_languages(
    docs: DataFrame,
    docs_per_language: int = DOCS_PER_LANGUAGE,
    order: int = ORDER,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> Trees | None:
    """Learn a context tree for each value of ``lang_col`` from at most ``docs_per_language`` documents.

    A document is an id with a text: rows that repeat both count once, rows that repeat an id alone are documents
    of their own. Those with the smallest hash of id and text are taken, in every language, so none is left out.
    Only they are counted, by a distributed aggregate, and its rows, bounded by the sample of each
    language, make the trees on the driver. Rows without text, language or id are not used. ``None`` if nothing is left.
    """
    usable = docs.select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    ).filter("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    usable = usable.select("lang", "text", F.xxhash64("id", "text").alias("place"))
    counts = usable.groupBy("lang").agg(F.approx_count_distinct("place").alias("n"))
    # Twice as many as wanted are taken by a share of the hashes, whatever the size of the table, and then the first.
    # The share follows from the different hashes, as of a few hashes with many rows each none might be within it.
    # Like the trees, counts and sample have rows for each language.
    share = F.pmod("place", F.lit(1 << 31)) / F.lit(1 << 31)
    hashed = usable.select("lang", "place").join(F.broadcast(counts), "lang")
    taken = hashed.filter(share < F.lit(2.0 * docs_per_language) / F.col("n")).select("lang", "place").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("place", F.lit(1 << 31)), "place"))
    sample = taken.withColumn("rank", rank).filter(F.col("rank") <= docs_per_language).select("lang", "place")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = set()
        for rows, data, bounds in text_batches(batches, "text", 1 << 20):
            window = windows(data, bounds, order)
            for row, key in enumerate(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())):
                if key in counted:
                    continue
                counted.add(key)
                own = window[bounds[row] : bounds[row + 1]]
                for level in range(order + 1):
                    gram, n = np.unique(own & np.uint64((1 << 8 * (level + 1)) - 1), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([key[0]] * len(gram), pa.string()),
                            pa.array(np.full(len(gram), key[1], dtype=np.int64)),
                            pa.array(np.full(len(gram), level, dtype=np.int32)),
                            pa.array(gram.view(np.int64)),
                            pa.array(n),
                        ],
                        names=["lang", "place", "level", "gram", "n"],
                    )

    chosen = usable.join(F.broadcast(sample), ["lang", "place"]).select("lang", "place", "text")
    counted = chosen.mapInArrow(count, "lang string, place long, level int, gram long, n long")
    # Tasks that met the same document counted the same.
    counted = counted.groupBy("lang", "place", "level", "gram").agg(F.max("n").alias("n"))
    table = counted.groupBy("lang", "level", "gram").agg(F.sum("n").alias("n")).toArrow()
    if not table.num_rows:
        return None
    lang = table["lang"].to_numpy()
    level, gram, n = (table[c].to_numpy() for c in ("level", "gram", "n"))
    grams = {}
    for name in sorted(set(lang)):
        grams[name] = []
        for k in range(order + 1):
            own = (lang == name) & (level == k)
            grams[name].append((gram[own].view(np.uint64), n[own]))
    return Trees(grams, order)


def predict_languages(docs: DataFrame, trees: Trees | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``lang_pred``, ``score`` and ``bits`` of every text, one row per input row with its id.

    The language is the one with the shortest code for the whole text; ``score`` is its share if
    each language's share is two to the power of minus its code length, and ``bits`` is the code
    length per byte. Equal lengths go to the first name. Text that is null, empty or has no letter
    is ``und`` with the score 0, as is all text if nothing was learned. Ids may repeat or be null;
    an empty table gives an empty result. Other columns are not read and may have any name.
    """
    held = docs.sparkSession.sparkContext.broadcast(trees)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        scorer = Scorer(model) if model is not None else None
        for rows, data, bounds in text_batches(batches, "text"):
            best, share, least = _judged(scorer, data, bounds)
            names = [model.languages[b] if b >= 0 else UNKNOWN for b in best]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array(names, pa.string()),
                    pa.array(share),
                    pa.array(least / np.maximum(np.diff(bounds), 1)),
                ],
                names=["id", "lang_pred", "score", "bits"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(predict, f"id {kind}, lang_pred string, score double, bits double")
    return found.withColumnRenamed("id", id_col)


def _judged(scorer: Scorer | None, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the best language of each text (-1 for none), its share, and its code length."""
    letters = have_letters(data, bounds)
    n = len(bounds) - 1
    if scorer is None:
        return np.full(n, -1), np.zeros(n), np.zeros(n)
    totals = scorer.totals(data, bounds)
    best = np.argmin(totals, axis=1)
    least = totals[np.arange(n), best]
    share = 1.0 / np.exp2(np.maximum(least[:, None] - totals, -1000.0)).sum(axis=1)
    return np.where(letters, best, -1), np.where(letters, share, 0.0), least


def in_known_language(
    docs: DataFrame, trees: Trees | None, text_col: str = "text", margin: float | None = None
) -> DataFrame:
    """The rows whose text is predicted to be in some language, with all their columns as they are.

    That is text with a letter. With a ``margin``, its shortest code must also not exceed eight bits a byte, the
    code of bytes in no language, by more than that many bits: such text is in no learned language, as
    noise is, and short text is kept. If nothing was learned, text with a letter is kept.
    """
    held = docs.sparkSession.sparkContext.broadcast(trees)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value) if held.value is not None else None
        for rows, data, bounds in text_batches(batches, text_col):
            if scorer is None:
                kept = have_letters(data, bounds)
            else:
                best, _, least = _judged(scorer, data, bounds)
                kept = best >= 0
                if margin is not None:
                    kept &= least <= 8.0 * np.diff(bounds) + margin
            yield rows.filter(pa.array(kept))

    return docs.mapInArrow(keep, docs.schema)
