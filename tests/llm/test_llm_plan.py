"""Packing, sharding and the pipeline."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from fleetlens.llm.language import fit_languages, held_out, predict_languages
from fleetlens.llm.packing import Counts, packed_documents, places, plan, reduce_by_dominance, token_pieces
from fleetlens.llm.sharding import Cuts, contiguous_shards
from fleetlens.llm.toxicity import fit_toxicity, score_toxicity

WORDS = public_tokenizers.path("word_bpe_49k.json")
SF_DIR = "/root/testdata/sf0.001"


def optimum(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for room in {r for r in rooms if r >= items[i]}:
            rest = list(rooms)
            rest[rest.index(room)] -= items[i]
            go(i + 1, rest)
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best[0]


sizes = st.integers(5, 30).flatmap(
    lambda c: st.tuples(st.just(c), st.lists(st.integers(max(1, c // 6), c), min_size=1, max_size=8))
)


@settings(max_examples=300, deadline=None)
@given(sizes)
def test_reduction_keeps_an_optimum(case):
    capacity, items = case
    left = Counts(dict(Counter(items)))
    fixed = sum(n for _, n in reduce_by_dominance(left, capacity))
    rest = [k for k, n in left.n.items() for _ in range(n)]
    assert fixed + (optimum(rest, capacity) if rest else 0) == optimum(items, capacity)


@settings(max_examples=300, deadline=None)
@given(sizes)
def test_plan_places_every_piece_once(case):
    capacity, items = case
    patterns = plan(dict(Counter(items)), capacity)
    used = Counter()
    for pattern, n in patterns:
        assert sum(k * m for k, m in pattern) <= capacity
        for k, m in pattern:
            used[k] += m * n
    assert used == Counter(items)
    assert all((np.diff(rows[:, 0]) > 0).all() for rows in places(patterns).values())
    full = sum(items)
    assert sum(n for _, n in patterns) <= max(-(-full * 2 // capacity), 1) + 1


def check_packing(got, texts, capacity):
    library = Tokenizer.from_file(WORDS)
    pieces = defaultdict(list)
    for i, t in texts:
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        for at in range(0, len(ids), capacity):
            part = np.array(ids[at : at + capacity], dtype="<u4")
            pieces[i].append((at // capacity, at, len(part), zlib.crc32(part.tobytes())))
    found = defaultdict(list)
    sequences = defaultdict(list)
    for r in got:
        found[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in pieces.items()}
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences), sum(p[2] for v in pieces.values() for p in v)


def test_packing_edges(spark, edge_docs, edge_texts, no_docs):
    for capacity in (7, 2048):
        check_packing(packed_documents(edge_docs, WORDS, capacity).collect(), edge_texts, capacity)
    assert packed_documents(no_docs, WORDS).count() == 0
    ids = {r.doc_id: bytes(r.ids) for r in token_pieces(edge_docs, WORDS).filter("doc_id IN (1, 2, 3)").collect()}
    assert ids == {1: b"\0\0\0\0", 2: b"\0\0\0\0", 3: b"\0\0\0\0"}


def test_packing_is_close_to_the_least_possible(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").repartition(3)
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    n, tokens = check_packing(packed_documents(docs, WORDS, 2048).collect(), texts, 2048)
    assert n <= -(-tokens // 2048) * 1.02 + 1


# --- sharding -------------------------------------------------------------------------------------


def least_capacity(groups, shards):
    low, high = max(groups, default=0), sum(groups)
    while low < high:
        middle, used, room = (low + high) // 2, 1, None
        room = middle
        for g in groups:
            if g > room:
                used, room = used + 1, middle
            room -= g
        low, high = (low, middle) if used <= shards else (middle + 1, high)
    return low


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(1, 50), min_size=1, max_size=6), min_size=1, max_size=20), st.integers(1, 6))
def test_cuts_have_the_least_capacity(blocks, shards):
    groups = [g for block in blocks for g in block]
    asked = []

    def fetch(numbers):
        asked.extend(numbers)
        return {n: blocks[n] for n in numbers}

    cuts = Cuts([sum(b) for b in blocks], max(groups), shards, fetch).solve()
    assert len(asked) == len(set(asked)) and cuts[-1] == sum(groups) and cuts == sorted(cuts)
    ends = set(np.cumsum([0, *groups]).tolist())
    assert set(cuts) <= ends
    assert max(np.diff([0, *cuts])) == least_capacity(groups, shards)


def test_beside_a_group_larger_than_a_shard_the_others_are_small_too():
    blocks = [[3, 4, 5] * 20, [400], [2, 6] * 30]
    cuts = Cuts([sum(b) for b in blocks], 400, 8, lambda numbers: {n: blocks[n] for n in numbers}).solve()
    sizes = np.diff([0, *cuts]).tolist()
    assert sum(sizes) == 880 and sorted(sizes)[-2:] == [80, 400]  # 240 on either side, in seven shards


def check_shards(got, texts, shards):
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in texts)
    by_text = defaultdict(list)
    for i, t in texts:
        by_text[t].append(i)
    real = [x for x in by_text.values()]
    order = sorted(by_text, key=lambda t: min((-1 if i is None else i) for i in by_text[t]))
    groups = [sum(len(t.encode()) + 1 for _ in by_text[t]) for t in order]
    size = defaultdict(int)
    slots = defaultdict(list)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(shards))
    assert sum(size.values()) == sum(groups) and len(real) == len(groups)
    return max(size.values()), least_capacity(groups, shards)


def test_shards(spark, edge_docs, edge_texts, no_docs):
    check_shards(contiguous_shards(edge_docs, 3).collect(), edge_texts, 3)
    assert contiguous_shards(no_docs, 3).count() == 0
    rows = [(i, "hot" * 40 if i % 3 == 0 else f"text {i % 70}" * (i % 7)) for i in range(500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = contiguous_shards(frame, 5).collect()
    largest, least = check_shards(got, rows, 5)
    assert largest == least
    where = defaultdict(set)
    for r in got:
        where[dict(rows)[r.doc_id]].add(r.shard)
        assert r.text_crc32 == zlib.crc32(dict(rows)[r.doc_id].encode())
    assert all(len(s) == 1 for s in where.values())


# --- pipeline -------------------------------------------------------------------------------------


def test_pipeline_against_stages_done_one_by_one(spark):
    from test_llm_dedup import expected_exact, expected_near

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").filter(~held_out("doc_id", 4, 2))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    trees = fit_languages(docs.filter(~held_out("doc_id", 3, 1)))
    texts = {r.doc_id: texts[r.doc_id] for r in predict_languages(docs, trees).collect() if r.lang_pred != "und"}
    known = docs.filter(docs.doc_id.isin(list(texts)))
    scores = score_toxicity(known, fit_toxicity(known, labels)).collect()
    texts = {r.doc_id: texts[r.doc_id] for r in scores if r.score < 0.3}
    texts = {r[0]: texts[r[0]] for r in expected_exact(list(texts.items())) if r[3]}
    texts = {r[0]: texts[r[0]] for r in expected_near(list(texts.items())) if r[3]}
    got = corpus_pipeline.run(spark, SF_DIR).collect()
    check_packing(got, list(texts.items()), 2048)


def test_stages_keep_the_columns(spark, edge_docs):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF_DIR).schema.simpleString() == docs.schema.simpleString()
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0


def test_dedup_stages_on_edge_rows(spark, edge_docs):
    docs = edge_docs.withColumnRenamed("body", "lang")
    exact = corpus_pipeline.exact_dedup(spark, docs, SF_DIR)
    assert sorted(str(r.doc_id) for r in exact.collect()) == sorted(["2", "3", "5", "6", "8", "9", "9", "10"])
    near = corpus_pipeline.near_dedup(spark, docs, SF_DIR)
    assert sorted(str(r.doc_id) for r in near.collect()) == sorted(
        ["1", "2", "3", "4", "7", "9", "9", "10", "None", "None"]
    )
