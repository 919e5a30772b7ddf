"""What the language and toxicity models learn from repeated rows, what no language fits, and scores one by one."""

from __future__ import annotations

import base64
import math
import random
import re

import numpy as np
import pytest

from fleetlens.llm.language import fit_languages, held_out, in_known_language
from fleetlens.llm.textbytes import Rolling
from fleetlens.llm.toxicity import PREFIXES, fit_toxicity, score_toxicity, sentence_words

SF_DIR = "/root/testdata/sf0.001"


def bytes_learned(trees, language):
    return trees.levels[trees.languages.index(language)][0][1].sum()


@pytest.mark.parametrize("ids", [1, 2, 3, 400])
def test_no_language_is_lost_where_ids_repeat(spark, ids):
    rows = [(i % ids, "x", f"aaa {i:04d}") for i in range(2000)] + [(i, "y", f"b {i:04d}") for i in range(2000, 2030)]
    trees = fit_languages(spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(5), 100)
    assert trees.languages == ["x", "y"]
    assert bytes_learned(trees, "x") == 100 * 8
    assert bytes_learned(trees, "y") == 30 * 6


def test_a_repeated_document_is_learned_once(spark):
    rows = [(7, "x", "ten bytes.")] * 400 + [(7, "x", "others"), (8, "x", "ten bytes.")]
    rows += [(7, None, "no"), (None, "x", "no"), (9, "x", ""), (9, "x", None)]
    trees = fit_languages(spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(7))
    assert bytes_learned(trees, "x") == 10 + 6 + 10


def test_many_languages_are_all_learned(spark):
    rows = [(i, f"l{i:04d}", f"text {i}") for i in range(1100)]
    trees = fit_languages(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert len(trees.languages) == 1100


def test_text_in_no_learned_language_goes(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    trees = fit_languages(docs.filter(~held_out("doc_id", 3, 1)))
    rng = random.Random(3)
    noise = [base64.b64encode(rng.randbytes(n)).decode() for n in (60, 600)]
    noise += ["".join(rng.choices(keys, k=n)) for keys in ("asdfghjkl;", "qwertyuiop asdf") for n in (60, 900)]
    noise += ["这是一个没有学过的语言的文本。" * 4, "12 34 !", "", None]
    short = ["x", "OK", "A.", "qz"]  # too short to be told from a language
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(noise + short)], "doc_id long, text string")
    kept = {r.doc_id for r in in_known_language(frame, trees, margin=128.0).collect()}
    assert kept == set(range(len(noise), len(noise) + len(short)))
    assert in_known_language(docs, trees, margin=128.0).count() == in_known_language(docs, trees).count()
    assert in_known_language(frame, None, margin=128.0).count() == len(noise) - 3 + len(short)


def training_rows():
    rng = random.Random(5)
    rows = []
    for i in range(120):
        words = [rng.choice(["sun", "tree", "river", "stone", "cloud"]) for _ in range(12)]
        if i % 3 == 0:
            words[i % 12] = "scoundrels"
        rows.append((i, " ".join(words[:6]) + ". " + " ".join(words[6:]), int(i % 3 == 0)))
    return rows


def test_repeated_rows_and_labels_change_no_model(spark):
    rows = training_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    plain = fit_toxicity(docs, docs.select("doc_id", "toxic"))
    many = spark.createDataFrame(rows + rows[:1] * 500 + rows[:40] * 3, "doc_id long, text string, toxic int")
    again = fit_toxicity(many.repartition(6), many.select("doc_id", "toxic"))
    assert np.array_equal(plain.hashes, again.hashes)
    assert np.array_equal(plain.weights, again.weights) and plain.bias == again.bias


def test_an_id_with_many_texts_is_within_the_bound(spark):
    rows = [(1, f"scoundrels {i}", 1) for i in range(300)] + [(2, f"tree {i}", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = fit_toxicity(docs, docs.select("doc_id", "toxic"), training_docs=50)
    scores = {r.doc_id: r.score for r in score_toxicity(docs, model).collect()}
    assert scores[1] > 0.5 > scores[2]
    assert len(fit_toxicity(docs, docs.select("doc_id", "toxic"), max_features=1).hashes) == 1


def test_scores_are_the_plain_noisy_or(spark):
    rows = training_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = fit_toxicity(docs, docs.select("doc_id", "toxic"))
    weight = dict(zip(model.hashes.tolist(), model.weights.tolist()))
    rolling = Rolling()

    def word_weight(word: bytes) -> float:
        data = np.frombuffer(word, dtype=np.uint8)
        features, *_ = sentence_words(rolling, data, np.array([0, len(data)]))
        assert (features[0] != 0).sum() == 1 + sum(len(word) > n for n in PREFIXES)
        return sum(weight.get(f, 0.0) for f in features[0].tolist() if f)

    texts = [t for _, t, _ in rows] + ["", None, "...", "Scoundrels! SCOUNDRELS\nscoundrelly sun? é tree", "scoun drels"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in score_toxicity(frame, model).collect():
        none = 1.0
        for sentence in re.split(rb"[.!?\n]", (texts[r.doc_id] or "").encode().lower()):
            words = re.findall(rb"[0-9a-z\x80-\xff]+", sentence)
            if words:
                none *= 1 - 1 / (1 + math.exp(-model.bias - sum(map(word_weight, words))))
        assert r.score == pytest.approx(1 - none, abs=1e-9)
