"""Tokens, languages, toxicity and licences."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fleetlens.llm.bpe import Encoder, decode_ids, encode_texts, read_vocabulary
from fleetlens.llm.language import ORDER, fit_languages, have_letters, held_out, in_known_language, predict_languages
from fleetlens.llm.license_texts import TEMPLATES
from fleetlens.llm.licenses import align, find_licenses, longest_increasing
from fleetlens.llm.packing import WordEncoder, plain_table
from fleetlens.llm.pretokens import class_table
from fleetlens.llm.textbytes import text_batches
from fleetlens.llm.toxicity import fit_toxicity, not_toxic, score_toxicity

SF_DIR = "/root/testdata/sf0.01"
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = [
    "'s", "'", "''", "'re", "'Rex", "'ll", "'S", " ", "  ", "\n", "\n\n", " \n", "\t", "a", "abc", "The", "é", "É", "ß",
    "1", "12", "²", "½", "...", "!", "<|endoftext|>", "<|endo", "日本語", " ", "\u0085", "👍🏽", "aaaaaaaa", "\x1c",
    "é", "İ", "Σ", "don't", "_", "-", "　",
]


@pytest.fixture(scope="module")
def byte_side():
    return Encoder(read_vocabulary(BYTES)), Tokenizer.from_file(BYTES)


@pytest.fixture(scope="module")
def word_side():
    with open(WORDS, "rb") as f:
        held = f.read()
    return WordEncoder(held, class_table(), plain_table()), Tokenizer.from_file(WORDS)


def encoded(encoder, texts, limit=1 << 20):
    out = []
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    for _, data, bounds in text_batches(iter([batch]), "text", limit):
        ids, counts = encoder.encode(data, bounds)
        ends = np.cumsum(counts)
        out += [ids[e - n : e].tolist() for e, n in zip(ends, counts)]
    return out


@pytest.mark.parametrize("side", ["byte_side", "word_side"])
def test_encoding_is_the_librarys(side, request):
    encoder, library = request.getfixturevalue(side)
    rng = random.Random(3)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 14))) for _ in range(4000)] + ["", None]
    wanted = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert encoded(encoder, texts) == wanted
    assert encoded(encoder, texts, limit=1) == wanted


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", max_codepoint=0x2FFF)), max_size=6))
def test_any_text_round_trips(byte_side, texts):
    encoder, library = byte_side
    got = encoded(encoder, texts)
    assert [library.decode(ids, skip_special_tokens=False) for ids in got] == texts


def test_encode_and_decode_edges(spark, edge_docs, edge_texts, no_docs):
    rows = encode_texts(edge_docs, BYTES)
    assert rows.columns == ["doc_id", "n_tokens", "ids"]
    got = decode_ids(rows, BYTES).collect()
    assert sorted(((r.doc_id, r.decoded) for r in got), key=str) == sorted(edge_texts, key=str)
    library = Tokenizer.from_file(BYTES)
    counts = sorted(((i, len(library.encode(t, add_special_tokens=False).ids)) for i, t in edge_texts), key=str)
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == counts
    assert encode_texts(no_docs, BYTES).count() == 0
    odd = spark.createDataFrame([(1, None), (2, bytearray((4_000_000_000).to_bytes(4, "little")))], "doc_id long, ids binary")
    assert {r.doc_id: r.decoded for r in decode_ids(odd, BYTES).collect()} == {1: None, 2: ""}


# --- language -------------------------------------------------------------------------------------


def slow_bits(text, grams):
    """Code length under the counts of one language, symbol by symbol."""
    total = 0.0
    data = b"\n" * ORDER + text.encode().lower()
    for at in range(ORDER, len(data)):
        p = 1.0
        for order in range(ORDER, -1, -1):
            seen = grams.get(data[at - order : at], {})
            if not seen:
                continue
            whole = sum(seen.values()) + len(seen)
            if data[at] in seen:
                p *= seen[data[at]] / whole
                break
            p *= len(seen) / whole
        else:
            p /= 256
        total -= math.log2(p)
    return total


def test_code_lengths_are_those_of_a_plain_tree(spark):
    rows = [(1, "x", "abracadabra. Cab! bad"), (2, "x", "dab"), (3, "y", "ça va bien là-bas"), (4, "y", "oui, ça va")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    trees = fit_languages(docs)
    assert trees.languages == ["x", "y"]
    tests = ["abra", "ça", "zebra Z", "b" * 2000, "oui oui abba"]
    frame = spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string")
    got = {r.doc_id: r for r in predict_languages(frame, trees).collect()}
    for i, text in enumerate(tests):
        bits = {}
        for lang in trees.languages:
            grams = defaultdict(Counter)
            for _, own, learned in rows:
                data = b"\n" * ORDER + learned.encode().lower()
                for at in range(ORDER, len(data)):
                    for order in range(ORDER + 1):
                        if own == lang:
                            grams[data[at - order : at]][data[at]] += 1
            bits[lang] = slow_bits(text, grams)
        best = min(bits, key=bits.get)
        assert got[i].lang_pred == best
        assert got[i].bits * len(text.encode()) == pytest.approx(bits[best])
        assert got[i].score == pytest.approx(1 / sum(2.0 ** max(bits[best] - b, -1000) for b in bits.values()))


def test_held_out_accuracy_of_languages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    trees = fit_languages(docs.filter(~held_out("doc_id", 3, 1)))
    rows = predict_languages(docs, trees).join(docs.select("doc_id", "lang"), "doc_id").filter(held_out("doc_id", 3, 1))
    right = [r.lang == r.lang_pred for r in rows.collect()]
    assert len(right) > 250 and sum(right) >= 0.98 * len(right)


def test_language_edges(spark, edge_docs, edge_texts, no_docs):
    trees = fit_languages(spark.read.parquet(f"{SF_DIR}/documents.parquet"), docs_per_language=20)
    got = sorted(((r.doc_id, r.lang_pred == "und", 0 <= r.score <= 1) for r in predict_languages(edge_docs, trees).collect()), key=str)
    assert got == sorted(((i, not any(c.isalpha() for c in t), True) for i, t in edge_texts), key=str)
    kept = in_known_language(edge_docs, trees)
    assert kept.columns == edge_docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        ((i, t) for i, t in edge_texts if any(c.isalpha() for c in t)), key=str
    )
    assert predict_languages(no_docs, trees).count() == 0
    nothing = fit_languages(no_docs.withColumnRenamed("body", "lang"))
    assert nothing is None
    assert {r.lang_pred for r in predict_languages(edge_docs, nothing).collect()} == {"und"}


def test_the_stage_keeps_letters_if_nothing_was_learned(edge_docs, edge_texts):
    kept = in_known_language(edge_docs, None)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        ((i, t) for i, t in edge_texts if any(c.isalpha() for c in t)), key=str
    )


def test_letters_of_any_script():
    texts = ["", "12", "é", "日", "٣", "1a", "ª", "👍"]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    bounds = np.cumsum([0] + [len(t.encode()) for t in texts])
    assert have_letters(data, bounds).tolist() == [any(c.isalpha() for c in t) for t in texts]


# --- toxicity -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def toxic_model(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    return fit_toxicity(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet").filter(~held_out("doc_id", 4, 2)))


def test_sentences_are_found_from_document_labels(spark):
    rng = random.Random(2)
    clean = lambda: " ".join(rng.choice(["sun", "tree", "river", "stone", "cloud", "bird"]) for _ in range(6))
    rows = []
    for i in range(400):
        sentences = [clean() for _ in range(5)]
        if i % 4 == 0:
            sentences[i % 5] += " vermin scoundrels"
        rows.append((i, ". ".join(sentences), int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = fit_toxicity(docs.filter("doc_id < 300"), docs.select("doc_id", "toxic"))
    got = {r.doc_id: r for r in score_toxicity(docs, model).collect()}
    for i, text, label in rows:
        assert (got[i].score >= 0.3) == bool(label)
        assert len(got[i].offending) == label
        for span in got[i].offending:
            assert "vermin" in text[span.start : span.last] and text[span.last :].startswith("scoundrels")


def test_held_out_accuracy_of_toxicity(spark, toxic_model):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").filter(held_out("doc_id", 4, 2))
    rows = score_toxicity(docs, toxic_model).join(labels, "doc_id").collect()
    bad = [r.score for r in rows if r.toxic == 1]
    good = [r.score for r in rows if r.toxic == 0]
    assert np.mean([[b > g for g in good] for b in bad]) > 0.8


def test_toxicity_edges(spark, edge_docs, edge_texts, no_docs, toxic_model):
    got = score_toxicity(edge_docs, toxic_model).collect()
    assert len(got) == len(edge_texts) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if r.doc_id in (1, 2, 3)} == {0.0}
    kept = not_toxic(edge_docs, toxic_model, limit=0.3)
    assert kept.columns == edge_docs.columns
    assert sorted((str(r.doc_id) for r in kept.collect())) == sorted(str(r.doc_id) for r in got if r.score < 0.3)
    assert score_toxicity(no_docs, toxic_model).count() == 0
    labels = spark.createDataFrame([(4, 0), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    assert all(r.score < 0.01 for r in score_toxicity(edge_docs, fit_toxicity(edge_docs, labels)).collect())


# --- licences -------------------------------------------------------------------------------------


def test_alignment():
    assert longest_increasing([3, 1, 2, 5, 4, 6]) == [1, 2, 4, 5]
    assert longest_increasing([]) == []
    text, template = list("xaybzcwd"), list("abcd")
    assert align(text, template) == [(1, 0), (3, 1), (5, 2), (7, 3)]
    assert align(list("aab"), list("ab")) == [(0, 0), (2, 1)]
    assert align([], [1]) == [] == align([1], [])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=12), st.lists(st.integers(0, 6), max_size=12))
def test_alignments_are_in_order(text, template):
    pairs = align(text, template)
    assert all(text[i] == template[j] for i, j in pairs)
    assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))


def test_licenses_are_found_where_they_are(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice(["the", "of", "and", "under", "plum", "version", "work", "is"]) for _ in range(n))
    rows, wanted = [], {}
    for i, (name, text) in enumerate(sorted(TEMPLATES.items())):
        before = prose(400) + "\n"
        rows.append((i, before + text.strip() + "\n" + prose(300)))
        wanted[i] = (name, len(before.encode()))
    twice = "Released under the MIT License.\n"
    rows += [(100, twice * 3), (101, prose(5000)), (102, "released beneath the mit license")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.found for r in find_licenses(frame, TEMPLATES).collect()}
    for i, (name, start) in wanted.items():
        best = max(got[i], key=lambda f: (f.coverage, f.words))
        text = rows[i][1].encode()[best.start : best.end].decode().lower()
        assert best.license == name and best.coverage == 1.0 and best.start >= start
        assert text.split()[0].strip('"1. ') in TEMPLATES[name].lower()
    assert [f.license for f in got[100]] == ["MIT (line)"] * 3
    assert got[101] == []
    assert [(f.license, f.coverage) for f in got[102]] == [("MIT (line)", 0.8)]


def test_an_altered_notice_before_a_whole_one_is_found(spark):
    words = [f"t{i}" for i in range(1, 11)]
    whole, short = " ".join(words), " ".join(words[:8])
    rows = [(1, f"{short} x y {whole}"), (2, f"{short} {short} {whole}"), (3, f"{whole} {short} x {whole} {short}")]
    rows += [(4, f"{' '.join(words[:7])} x y {whole}")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(f.start, f.coverage) for f in r.found] for r in find_licenses(frame, {"t": whole}).collect()}
    n, m = len(short) + 1, len(whole) + 1
    assert got[1] == [(0, 0.8), (n + 4, 1.0)]
    assert got[2] == [(0, 0.8), (n, 0.8), (2 * n, 1.0)]
    assert got[3] == [(0, 1.0), (m, 0.8), (m + n + 2, 1.0), (2 * m + n + 2, 0.8)]
    assert got[4] == [(len(short) - 3 + 5, 1.0)]


def test_license_edges(spark, edge_docs, edge_texts, no_docs):
    got = find_licenses(edge_docs, TEMPLATES).collect()
    assert len(got) == len(edge_texts) and all(r.found == [] for r in got)
    assert find_licenses(no_docs, TEMPLATES).count() == 0
    assert all(r.found == [] for r in find_licenses(edge_docs, {"none": ""}).collect())
