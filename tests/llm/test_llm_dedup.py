"""Exact and near duplicates, components, and vectors against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict
from math import comb

import numpy as np
import pytest

from fleetlens.llm import exact_dedup
from fleetlens.llm.components import components
from fleetlens.llm.exact_dedup import exact_duplicates
from fleetlens.llm.hnsw import Shard, near_vectors
from fleetlens.llm.minhash import Index, near_duplicates
from fleetlens.llm.shingles import shingle_sets
from fleetlens.llm.textbytes import Rolling


def rooted(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# --- exact ----------------------------------------------------------------------------------------


def expected_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t] if x is not None]
        top = max(ids) if ids else None
        out.append((i, top, len(groups[t]), i == top, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_edges(edge_docs, edge_texts, no_docs):
    got = sorted((tuple(r) for r in exact_duplicates(edge_docs).collect()), key=str)
    assert got == expected_exact(edge_texts)
    assert exact_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("salts", [1, 3])
def test_exact_large_group(spark, salts):
    rows = [(i, "hot" if i % 3 else f"t{i % 50}") for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sorted((tuple(r) for r in exact_duplicates(frame, salts=salts).collect()), key=str)
    assert got == expected_exact(rows)


def test_texts_that_share_a_digest_stay_apart(spark, monkeypatch):
    """With a digest of one letter, only the comparison of whole texts tells them apart."""

    class Short:
        def __getattr__(self, name):
            return getattr(real, name)

        @staticmethod
        def sha2(column, bits):
            return real.substring(real.sha2(column, bits), 1, 1)

    real = exact_dedup.F
    rows = [(i, f"text {i % 40}") for i in range(100)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(exact_dedup, "F", Short())
    got = sorted(tuple(r)[:4] for r in exact_duplicates(frame).collect())
    assert got == sorted(r[:4] for r in expected_exact(rows))


# --- near -----------------------------------------------------------------------------------------


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", text.encode().lower())
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return set(zip(words, words[1:], words[2:], words[3:], words[4:]))


def expected_near(rows, percent=85):
    sets = defaultdict(set)
    size = {}
    for i, t in rows:
        sets[i] |= {frozenset(shingles(t))} - {frozenset()}
        size[(i, t)] = len(shingles(t))
    ids = sorted(i for i in sets if i is not None)
    links = [
        (a, b)
        for n, a in enumerate(ids)
        for b in ids[n + 1 :]
        if any(100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b])
    ]
    root = rooted(ids, links)
    return sorted(((i, size[(i, t)], root.get(i), i == root.get(i)) for i, t in rows), key=str)


def test_shingle_sets_are_as_counted_one_by_one():
    texts = ["", "a", "a b c d", "a b c d e", "A b  c\td\ne f a b c d e", "x\x0b y \x0c z é É", "end"]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    bounds = np.cumsum([0] + [len(t.encode()) for t in texts])
    values, first, _ = shingle_sets(Rolling(), data, bounds)
    assert np.diff(first).tolist() == [len(shingles(t)) for t in texts]


def test_near_edges(edge_docs, edge_texts, no_docs):
    got = sorted((tuple(r) for r in near_duplicates(edge_docs).collect()), key=str)
    assert got == expected_near(edge_texts)
    assert near_duplicates(no_docs).count() == 0


def test_near_groups(spark):
    """A chain of edits, a large group around one text, and texts that share a passage only."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(150)]
    rows = []
    for i in range(120):
        own = list(base)
        for _ in range(rng.randrange(0, 5)):
            own[rng.randrange(150)] = word()
        rows.append((i, " ".join(own)))
    passage = [word() for _ in range(60)]
    rows += [(200 + i, " ".join(passage + [word() for _ in range(rng.randrange(5, 60))])) for i in range(60)]
    chain = [word() for _ in range(100)]
    for i in range(20):
        chain[i * 5] = word()
        rows.append((300 + i, " ".join(chain)))
    rows += [(400 + i, "short text") for i in range(3)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((tuple(r) for r in near_duplicates(frame).collect()), key=str)
    assert got == expected_near(rows)


def test_hot_keys_are_searched_in_blocks(spark, monkeypatch):
    from fleetlens.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(60)]
    rows = []
    for i in range(90):
        own = list(base)
        for _ in range(rng.randrange(1, 4)):
            own[rng.randrange(60)] = word()
        rows.append((i, " ".join(own)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in near_duplicates(frame).collect()), key=str)
    assert got == expected_near(rows)


@pytest.mark.parametrize("index", [Index(), Index(64, 20, 16), Index(64, 10, 8)])
def test_no_pair_within_the_distance_is_lost(index):
    rng = np.random.default_rng(2)
    one = rng.integers(0, 1 << 16, (400, index.hashes)).astype(np.uint16)
    two = one.copy()
    for row in two:
        at = rng.choice(index.hashes, index.distance, replace=False)
        row[at] ^= 1
    assert ((one != two).sum(axis=1) == index.distance).all()
    shared = index.keys(one) == index.keys(two)
    assert shared.any(axis=1).all()
    assert (index.first_slot(one == two) == np.argmax(shared, axis=1)).all()


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    links += [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(200)] + [(5, 5), (7, None)]
    frame = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in components(frame, "test").collect()}
    real = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    assert got == rooted({x for pair in real for x in pair}, real)
    assert components(frame.limit(0), "none").count() == 0


@pytest.mark.parametrize("percent", [97, 85, 80, 75, 70, 60])
def test_the_distance_follows_from_the_percent(percent):
    index = Index.for_percent(percent)
    q = 1 - percent / 100
    lost = sum(comb(64, k) * q**k * (1 - q) ** (64 - k) for k in range(index.distance + 1, 65))
    assert lost <= 3e-5
    test_no_pair_within_the_distance_is_lost(index)


def test_the_index_at_85_is_as_documented():
    assert Index.for_percent(85) == Index()
    with pytest.raises(ValueError):
        Index.for_percent(1)


@pytest.mark.parametrize("percent, changed", [(70, 176), (80, 111)])
def test_pairs_just_similar_enough(spark, percent, changed):
    """Pairs whose last words differ, at the similarity that is asked for."""
    rows = []
    for i in range(60):
        same = [f"s{i}x{k}" for k in range(1004 - changed)]
        for j in (0, 1):
            rows.append((2 * i + j, " ".join(same + [f"o{i}y{j}z{k}" for k in range(changed)])))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in near_duplicates(frame, percent=percent).collect()), key=str)
    assert [r[2] for r in sorted(got)] == [i // 2 * 2 for i in range(120)]


CHAINS = [
    [1, 2, 3, 4],
    [1, 3, 4, 5, 2],
    [2, 5, 6, 7, 4, 1, 3, 8],
    [10, 9, 4, 8, 6, 7, 3, 1, 5, 2],
    [6, 11, 9, 3, 7, 8, 10, 4, 5, 13, 14, 12, 1, 15, 2],
]
STARS = [(16, x) for x in (13, 4, 5, 2, 8, 15, 9, 19, 7)] + [(11, x) for x in (14, 6, 17, 10, 18, 3, 12, 1, 7)]


@pytest.mark.parametrize("links", [*(list(zip(c, c[1:])) for c in CHAINS), STARS], ids=len)
def test_components_give_each_node_once(spark, links):
    """Rows, not a dict, of graphs on their own: chains in shuffled order, and two stars joined through one node."""
    frame = spark.createDataFrame(links, "a long, b long")
    got = sorted(tuple(r) for r in components(frame, "once").collect())
    assert got == sorted(rooted({x for pair in links for x in pair}, links).items())


@pytest.mark.parametrize("order", [(1, 3, 4, 5, 2), (4, 1, 6, 3, 5, 2)])
def test_vectors_in_a_chain_are_one_component(spark, order):
    """Each is near to its neighbours in the chain only."""
    rows = [(i, [float(np.cos(0.3 * k)), float(np.sin(0.3 * k))], 0) for k, i in enumerate(order)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.component_id) for r in near_vectors(frame, threshold=0.93).collect())
    assert got == [(i, 1) for i in sorted(order)]


# --- vectors --------------------------------------------------------------------------------------


def clustered(n, seed=0, dims=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(n // 20, 1), dims))
    return (centres[rng.integers(0, len(centres), n)] + 0.12 * rng.normal(size=(n, dims))).astype(np.float32)


def test_recall_of_a_shard():
    rows = np.concatenate([clustered(3000), clustered(1, 9).repeat(300, axis=0) + clustered(300, 3) * 1e-3]).astype(float)
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    left, right = Shard(rows, 0.93).links(rows)
    found = set(zip(left.tolist(), right.tolist()))
    wanted = set(zip(*(x.tolist() for x in np.nonzero(rows @ rows.T >= 0.93))))
    assert found <= {(a, b) for a, b in wanted} | {(a, a) for a in range(len(rows))}
    assert len(found & wanted) >= 0.98 * len(wanted)


@pytest.mark.parametrize("shard", [100, 10_000])
def test_vectors_against_brute_force(spark, shard):
    rows = clustered(400, 4)
    labels = [i % 3 if i % 11 else None for i in range(len(rows))]
    data = [(i, [float(x) for x in v], lab) for i, (v, lab) in enumerate(zip(rows, labels))]
    data += [(1000 + i, data[i][1], data[i][2]) for i in range(30)]  # copies
    frame = spark.createDataFrame([(*d, "x", 1) for d in data], "vec_id long, embedding array<float>, label int, rep string, n int")
    got = {r.vec_id: tuple(r)[1:] for r in near_vectors(frame, shard=shard).collect()}
    unit = np.array([d[1] for d in data], dtype=np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    links = [
        (data[a][0], data[b][0])
        for a, b in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.93, 1)))
        if data[a][2] is not None and data[a][2] == data[b][2]
    ]
    root = rooted([d[0] for d in data], links)
    count = defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    assert got == {d[0]: (count[d[0]], root[d[0]], root[d[0]] == d[0]) for d in data}


def test_vectors_without_direction(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 0),
        (2, [], 0),
        (3, [0.0, 0.0], 0),
        (4, [nan, 1.0], 0),
        (5, [1.0, inf], 0),
        (6, [1.0, None], 0),
        (7, [1.0, 0.0], None),
        (None, [1.0, 0.0], 0),
        (8, [1.0, 0.0], 0),
        (9, [2.0, 0.0], 0),
        (10, [1.0, 0.0, 0.0], 0),
        (11, [1e-30, 0.0], 0),
        (8, [1.0, 0.0], 0),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((tuple(r) for r in near_vectors(frame).collect()), key=str)
    alone = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 7, 10, None)]
    assert got == sorted([*alone, (8, 3, 8, True), (8, 3, 8, True), (9, 3, 8, False), (11, 3, 8, False)], key=str)
    assert near_vectors(frame.limit(0)).count() == 0
