"""Toxicity by multiple-instance learning: sentences combined by noisy-or, learned from document labels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.textbytes import Rolling, lower_table, member_table, runs, text_batches
from fleetlens.session import stored

TRAINING_DOCS = 20_000
FEATURES = 20_000
LEAST_DOCS = 3
LEAST_CHI2 = 15.0
PREFIXES = (4, 5, 6)
ENDS = b".!?\n"
STEPS = 600
RATE = 0.1
DECAY = 3e-6
OFFENDING = 0.3


def word_bytes() -> np.ndarray:
    """Words are runs of ASCII letters and digits and of all bytes beyond ASCII."""
    return member_table(bytes(b for b in range(256) if b >= 128 or chr(b).isalnum()))


def sentence_words(
    rolling: Rolling, data: np.ndarray, bounds: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of all words: a row of hashes per word (0 where it has none); start, sentence and text of each.

    The features of a word are the word and its first four, five and six bytes. Sentences end at
    full stops, marks and line ends, and are numbered through all texts.
    """
    lowered = lower_table()[data]
    starts, ends, row = runs(lowered, bounds, word_bytes())
    sums = rolling.sums(rolling.bytes[lowered])
    features = np.zeros((len(starts), 1 + len(PREFIXES)), dtype=np.uint64)
    if len(starts):
        features[:, 0] = rolling.stretches(sums, starts, ends)
        for i, n in enumerate(PREFIXES, 1):
            longer = np.flatnonzero(ends - starts > n)
            part = rolling.stretches(sums, starts[longer], starts[longer] + n)
            features[longer, i] = part ^ np.uint64(0x5BF03635 + i)  # a prefix is not the word of its letters
    closed = np.cumsum(member_table(ENDS)[data])
    sentence = closed[starts] + row if len(starts) else starts
    return features, starts, sentence, row


@dataclass
class Model:
    hashes: np.ndarray  # ascending
    weights: np.ndarray
    bias: float


def _log_none(z: np.ndarray) -> np.ndarray:
    """Logarithm of one minus the probability."""
    return -np.logaddexp(0.0, z)


def train(
    features: np.ndarray, sentence: np.ndarray, doc: np.ndarray, empty: np.ndarray, labels: np.ndarray, n_features: int
) -> tuple[np.ndarray, float]:
    """Weights and bias that make document labels likely, by gradient steps over all documents.

    ``features`` and ``sentence`` say which feature occurs in which sentence, ``doc`` the document of each
    sentence; ``empty`` are sentences without any feature, by document. A document is positive
    unless none of its sentences is.
    """
    weights, bias = np.zeros(n_features), -4.0
    params = np.zeros(n_features + 1)
    params[-1] = bias
    first, second = np.zeros_like(params), np.zeros_like(params)
    n_docs = len(labels)
    for step in range(1, STEPS + 1):
        weights, bias = params[:-1], params[-1]
        z = bias + np.bincount(sentence, weights=weights[features], minlength=len(doc))
        none = np.bincount(doc, weights=_log_none(z), minlength=n_docs) + empty * _log_none(np.array(bias))
        none = np.minimum(none, -1e-9)
        # The loss falls with log P(none) for clean documents and rises with P(none) / P(some) for the
        # others; log P(none) falls with a sentence's score by the sentence's chance.
        slope = np.where(labels == 1, -np.exp(none) / -np.expm1(none), 1.0)
        chance = 1.0 / (1.0 + np.exp(-z))
        by_sentence = slope[doc] * chance
        gradient = np.empty_like(params)
        gradient[:-1] = np.bincount(features, weights=by_sentence[sentence], minlength=n_features)
        gradient[-1] = by_sentence.sum() + (slope * empty).sum() / (1.0 + np.exp(-bias))
        gradient = gradient / max(n_docs, 1) + DECAY * np.append(weights, 0.0)
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        params = params - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return params[:-1], float(params[-1])


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    training_docs: int = TRAINING_DOCS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_features: int = FEATURES,
) -> Model:
    """Learn from the labels of at most ``training_docs`` documents, those with the smallest hash of their id.

    An id has one label, 1 if any of its rows has, and may have several texts: each different text of a sampled id
    is learned once, however often it is repeated, at most ``training_docs`` of them by their hash. These texts are
    stored, as they are read twice. Features are counted by a distributed aggregate; those that occur in
    ``LEAST_DOCS`` documents and depend on the label by a chi-squared of ``LEAST_CHI2`` are kept, the
    ``max_features`` most dependent at most; what is left out scores nothing. The driver
    gets those features of the sampled sentences only. Rows without id or label are not used.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.filter("id IS NOT NULL AND label IN (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(training_docs)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    labelled = texts.join(F.broadcast(sample), "id").withColumn("place", F.xxhash64("id", "text"))
    once = stored(labelled.select("label", "place", "text").dropDuplicates(["place"]), "toxicity-sample")
    first = once.select("place").orderBy("place").limit(training_docs)
    chosen = once.join(F.broadcast(first), "place").select("label", "text", "place")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for rows, data, bounds in text_batches(batches, "text", 1 << 20):
            features, _, _, row = sentence_words(rolling, data, bounds)
            label = rows.column(0).to_numpy()
            flat, of = features.reshape(-1), np.repeat(row, features.shape[1])
            by = np.lexsort((of, flat))
            flat, of = flat[by], of[by]
            fresh = np.ones(len(flat), dtype=bool)
            fresh[1:] = (flat[1:] != flat[:-1]) | (of[1:] != of[:-1])
            flat, of = flat[fresh & (flat != 0)], of[fresh & (flat != 0)]
            value, at = np.unique(flat, return_inverse=True)
            bad = np.bincount(at, weights=label[of], minlength=len(value)).astype(np.int64)
            every = np.bincount(at, minlength=len(value))
            yield pa.RecordBatch.from_arrays(
                [pa.array(value.view(np.int64)), pa.array(every), pa.array(bad)], names=["feature", "n", "bad"]
            )
            totals = [np.array([0]), np.array([len(label)]), np.array([int(label.sum())])]
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.int64()) for t in totals], names=["feature", "n", "bad"])

    counted = (
        chosen.mapInArrow(count, "feature long, n long, bad long")
        .groupBy("feature")
        .agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        .filter(F.col("n") >= LEAST_DOCS)
    )
    total = counted.filter("feature = 0").first()
    if total is None or total.bad in (0, total.n):  # one label only: its share is all there is to say
        share = (total.bad / total.n) if total else 0.0
        return Model(np.zeros(0, np.uint64), np.zeros(0), 30.0 if share else -30.0)
    n, bad = float(total.n), float(total.bad)
    a, here = F.col("bad"), F.col("n")
    off = a * n - here * bad
    chi2 = off * off * n / (here * (n - here) * bad * (n - bad))
    kept = (
        counted.filter(f"feature <> 0 AND n < {total.n}")
        .withColumn("chi2", chi2)
        .filter(F.col("chi2") >= LEAST_CHI2)
        .orderBy(F.desc("chi2"), "feature")
        .limit(max_features)
        .toArrow()
    )
    hashes = np.sort(kept["feature"].to_numpy().view(np.uint64))
    held = spark.sparkContext.broadcast(hashes)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, lookup = Rolling(), Lookup(held.value)
        for rows, data, bounds in text_batches(batches, "text", 1 << 20):
            features, _, sentence, row = sentence_words(rolling, data, bounds)
            word, index = lookup.find(features)
            label = rows.column(0).to_pylist()
            parts, lists, empty = [], [], []
            first = np.searchsorted(row, np.arange(len(label) + 1))
            for r in range(len(label)):
                own = slice(*np.searchsorted(word, [first[r], first[r + 1]]))
                numbers, place = np.unique(sentence[word[own]], return_inverse=True)
                every = len(np.unique(sentence[first[r] : first[r + 1]]))
                parts.append(place.astype(np.int32))
                lists.append(index[own].astype(np.int32))
                empty.append(every - len(numbers))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(label, pa.int32()),
                    pa.array(empty, pa.int32()),
                    pa.array(parts, pa.list_(pa.int32())),
                    pa.array(lists, pa.list_(pa.int32())),
                    rows.column(2),
                ],
                names=["label", "empty", "sentence", "feature", "place"],
            )

    schema = "label int, empty int, sentence array<int>, feature array<int>, place long"
    rows = chosen.mapInArrow(found, schema).toArrow().sort_by("place")  # the same sums in each run
    label = rows["label"].to_numpy().astype(np.int64)
    empty = rows["empty"].to_numpy().astype(np.float64)
    feature, sentence, doc, at = [], [], [], 0
    for i, (s, f) in enumerate(zip(rows["sentence"].to_pylist(), rows["feature"].to_pylist())):
        if s:
            sentence.extend(x + at for x in s)
            feature.extend(f)
            doc.extend([i] * (max(s) + 1))
            at += max(s) + 1
    weights, bias = train(
        np.array(feature, np.int64), np.array(sentence, np.int64), np.array(doc, np.int64), empty, label, len(hashes)
    )
    return Model(hashes, weights, bias)


class Lookup:
    """Which words have which of some features."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = hashes
        self.near = np.zeros(1 << 20, dtype=bool)
        self.near[hashes >> np.uint64(44)] = True

    def find(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word and feature number of each occurrence, by word."""
        word, column = np.nonzero(self.near[features >> np.uint64(44)])
        value = features[word, column]
        at = np.minimum(np.searchsorted(self.hashes, value), max(len(self.hashes) - 1, 0))
        hit = self.hashes[at] == value if len(self.hashes) else np.zeros(len(value), dtype=bool)
        return word[hit], at[hit]


def _scored(
    model: Model, lookup: Lookup, rolling: Rolling, data: np.ndarray, bounds: np.ndarray
) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None]:
    """Score of each text; start of the first and last word, text and chance of each sentence."""
    n = len(bounds) - 1
    features, starts, sentence, row = sentence_words(rolling, data, bounds)
    if not len(starts):
        return np.zeros(n), None
    word, index = lookup.find(features)
    changes = sentence[1:] != sentence[:-1]
    begin = np.flatnonzero(np.concatenate([[True], changes]))
    of_word = np.cumsum(np.concatenate([[0], changes.astype(np.int64)]))
    z = model.bias + np.bincount(of_word[word], weights=model.weights[index], minlength=len(begin))
    none = np.bincount(row[begin], weights=_log_none(z), minlength=n)
    last = np.append(begin[1:], len(starts)) - 1
    return -np.expm1(none), (starts[begin], starts[last], row[begin], 1.0 / (1.0 + np.exp(-z)))


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``score`` of every text and ``offending`` sentences, one row per input row with its id.

    The score is the chance that any sentence is toxic, taking sentences as independent. Offending
    sentences have a chance of ``OFFENDING`` at least: first and last word by byte offset into the
    text's UTF-8, and the chance. Text that is null, empty or has no word scores 0. Ids may repeat or
    be null; an empty table gives an empty result. Other columns are not read and may have any name.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        rolling, lookup = Rolling(), Lookup(model.hashes)
        for rows, data, bounds in text_batches(batches, "text"):
            n = rows.num_rows
            scores, words = _scored(model, lookup, rolling, data, bounds)
            spans: list[list[dict]] = [[] for _ in range(n)]
            if words is not None:
                first, last, row, chance = words
                for s in np.flatnonzero(chance >= OFFENDING).tolist():
                    r = int(row[s])
                    spans[r].append(
                        {"start": int(first[s] - bounds[r]), "last": int(last[s] - bounds[r]), "score": float(chance[s])}
                    )
            kind = pa.list_(pa.struct([("start", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(scores), pa.array(spans, kind)], names=["id", "score", "offending"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, score double, offending array<struct<start: long, last: long, score: double>>"
    return rows.mapInArrow(score, schema).withColumnRenamed("id", id_col)


def not_toxic(docs: DataFrame, model: Model, limit: float = OFFENDING, text_col: str = "text") -> DataFrame:
    """The rows whose text scores below ``limit``, with all their columns as they are."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        rolling, lookup = Rolling(), Lookup(model.hashes)
        for rows, data, bounds in text_batches(batches, text_col):
            yield rows.filter(pa.array(_scored(model, lookup, rolling, data, bounds)[0] < limit))

    return docs.mapInArrow(keep, docs.schema)
