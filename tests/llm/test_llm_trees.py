"""Merkle manifest, list ranking, conversation trie and mixing, against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm.list_ranking import list_ranks
from fleetlens.llm.merkle import folded, merkle_manifest, proof_digest
from fleetlens.llm.mixing import entropy_mix, rounded_copies, source_targets, word_count
from fleetlens.llm.trie import numbered_turns, prefix_digests, prefix_trie

DOCS = "doc_id long, source string, lang string, n_chars long, text string, g string, pos int, n int, digest string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree_of(leaves):
    """Levels of one tree, and per leaf its siblings from the bottom."""
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[i : i + 3])) for i in range(0, len(now), 3)])
    paths = []
    for i in range(len(leaves)):
        path = []
        for level in levels[:-1]:
            run = i // 3 * 3
            path.append(("".join(level[run:i]), "".join(level[i + 1 : run + 3])))
            i //= 3
        paths.append(path)
    return levels[-1][0], paths


def expected_manifest(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        ranked = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        leaves = [leaf_of(r) for r in ranked]
        trees[s] = (ranked, leaves, *tree_of(leaves))
    root, above = tree_of([trees[s][2] for s in order])
    out = []
    for s, up in zip(order, above):
        ranked, leaves, subroot, paths = trees[s]
        for row, leaf, path in zip(ranked, leaves, paths):
            changed = leaf_of([*row[:4], row[4].replace("\n", "")]) if row[4] is not None else leaf
            node = changed
            for left, right in path + up:
                node = sha(left + node + right)
            proof = sha("".join(left + right for left, right in path + up))
            out.append((row[0], leaf, subroot, root, proof, node))
    return sorted(out, key=str)


def manifest(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], DOCS)
    tree = merkle_manifest(docs, altered={"text": F.replace("text", F.lit("\n"), F.lit(""))})
    found = tree.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")), folded(F.col("path"), F.col("altered_leaf"))
    )
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_manifest_of_odd_rows(spark):
    rows = [
        (1, "a", "en", 3, "x\ny"),
        (1, "a", "en", 3, "x\ny"),
        (2, "a", None, None, None),
        (3, "a", "", 0, ""),
        (None, "a", "en", 5, "none"),
        (None, None, None, None, None),
        (-7, None, "de", 9, "ä\nö"),
        (10, "", "en", 1, "\n"),
        (11, "Z", "en", 1, "long " * 50_000),
        (12, "é", "en", 1, "t"),
    ]
    assert manifest(spark, rows) == expected_manifest(rows)


def test_manifest_of_a_group_beyond_one_block(spark):
    rows = [(i * 3 % 2003, "hot" if i % 10 else f"s{i % 7}", "en", i, f"t{i}\n") for i in range(2000)]
    assert manifest(spark, rows) == expected_manifest(rows)


def test_manifest_of_nothing(spark):
    assert manifest(spark, []) == []


@pytest.mark.parametrize("n", [0, 1, 2, 700])
def test_ranks(spark, n):
    order = random.Random(n).sample(range(10 * n + 10), n)
    links = spark.createDataFrame(list(zip(order, [*order[1:], None]))[:n], "id long, next long")
    ranks = list_ranks(links, "test-ranks", finish=20)
    assert sorted((r.rank, r.id) for r in ranks.collect()) == list(enumerate(order))


def sequences_of(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: tuple(t[2:] for t in sorted(ts)) for c, ts in turns.items()}


def expected_trie(convs):
    members = defaultdict(list)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = []
    for p, ms in members.items():
        leaves = saved = 0
        todo = [p]
        while todo:
            q = todo.pop()
            leaves += not kids[q]
            saved += (len(members[q]) - 1) * len(q[-1][1]) if q else 0
            todo += kids[q]
        ends = ",".join(str(c) for c in sorted(ms) if convs[c] == p)
        parent = min(members[p[:-1]]) if p else None
        out.append((min(ms), len(p), parent, len(ms), len(kids[p]), leaves, saved, sha(ends)))
    return sorted(out, key=str)


def conversation_rows():
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", None]), rng.choice(["a", "bb", "", None, "ä€"])) for c in range(60) for t in range(c % 6)]
    rows += [(c, t, "user", f"same {t}") for c in range(100, 140) for t in range(4)]  # a large group
    rows += [(-5, None, "user", "first"), (-5, 2, "b", "tie"), (-5, 2, "a", "tie"), (-5, 2, "a", "tie")]
    rows += [(500, t, "user", "x" * (t % 3)) for t in range(40)] + [(501, t, "user", "x" * (t % 3)) for t in range(39)]
    rows += [(None, 1, "user", "nobody"), (900, 0, "user", "word " * 40_000)]
    rng.shuffle(rows)
    return rows


def test_trie(spark):
    rows = conversation_rows()
    table = spark.createDataFrame(
        [(*r, "x", 1, "y") for r in rows], "conv_id long, turn long, role string, text string, prefix string, node int, up string"
    )
    found = prefix_trie(table, finish=40, span=3)
    assert sorted((tuple(r) for r in found.collect()), key=str) == expected_trie(sequences_of(rows))


def test_trie_of_nothing(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie(table).collect() == []


def test_prefixes_do_not_depend_on_where_spans_end(spark):
    rows = [(c, t, "u", "same" if t < 30 else f"{c}") for c in (1, 2) for t in range(33)]
    turns = numbered_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for span in (2, 5, 64):
        by_depth = defaultdict(set)
        for r in prefix_digests(turns, span).collect():
            by_depth[r.depth].add(r.prefix)
        assert [len(by_depth[d]) for d in range(1, 34)] == [1] * 30 + [2] * 3
        assert len(set().union(*by_depth.values())) == 36


def expected_targets(sizes, weights=(1, 2, 3), cap=3):
    """Reshare the excess until no source is above its cap; sizes in order of the sources."""
    total, target = sum(sizes), [0.0] * len(sizes)
    free, left = list(range(len(sizes))), float(total)
    while free:
        share = left / sum(weights[i % 3] for i in free)
        over = [i for i in free if share * weights[i % 3] > cap * sizes[i]]
        if not over:
            for i in free:
                target[i] = share * weights[i % 3]
            break
        for i in over:
            target[i] = cap * sizes[i]
            left -= target[i]
        free = [i for i in free if i not in over]
    return target


@pytest.mark.parametrize("sizes", [[5], [10, 1, 1, 50, 0, 3, 1000], [0, 0], [1] * 9, [1, 10**6, 7, 3]])
def test_targets(spark, sizes):
    table = spark.createDataFrame([(f"={i}", s) for i, s in enumerate(sizes)], "g string, source_size long")
    found = {r.g: r.target for r in source_targets(table).collect()}
    wanted = expected_targets(sizes)
    assert all(math.isclose(found[f"={i}"], w, rel_tol=1e-9) for i, w in enumerate(wanted))


def solved_rates(sizes, target, cap=3.0):
    """Rates by bisection over the tilt."""
    sizes = np.array(sizes, dtype=float)
    if target <= 0 or not sizes.sum():
        return np.zeros(len(sizes))
    if target >= cap * sizes.sum() * (1 - 1e-7):
        return np.full(len(sizes), cap)
    low, high = -200.0, 200.0
    for _ in range(200):
        tilt = (low + high) / 2
        rates = np.minimum(np.exp(np.minimum(tilt * sizes / sizes.mean(), 100)), cap)
        low, high = (tilt, high) if (rates * sizes).sum() < target else (low, tilt)
    return rates


def test_mix(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        source = rng.choice(["hot"] * 4 + ["b", "c", "d", None, "é"])
        words = 40 if rng.random() < 0.3 else int(rng.paretovariate(1.2) * 5) % 3000
        rows.append((i, " ".join(["w"] * words), source))
    rows += [(9000 + i, "tiny text", "tiny") for i in range(5)] + [(9100, None, "silent"), (9101, " \n", "silent"), (None, "x", "b")]
    docs = spark.createDataFrame(
        [(*r, 1, "x", 2.0) for r in rows], "doc_id long, text string, source string, size int, g string, tilt double"
    )
    found = [tuple(r) for r in entropy_mix(docs).select("doc_id", "size", "source_size", "target", "rate", "copies", "taken").collect()]
    again = [tuple(r) for r in entropy_mix(docs.repartition(7)).select("doc_id", "size", "source_size", "target", "rate", "copies", "taken").collect()]
    assert sorted(found, key=str) == sorted(again, key=str)
    sources = {i: s for i, _, s in rows}
    by_source = defaultdict(list)
    for row in found:
        by_source[sources[row[0]]].append(row)
    assert len(found) == len(rows)
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    sizes = [sum(r[1] for r in by_source[s]) for s in order]
    assert [by_source[s][0][2] for s in order] == sizes
    for s, target in zip(order, expected_targets(sizes)):
        mine = by_source[s]
        assert all(math.isclose(r[3], target, rel_tol=1e-9) for r in mine)
        rates = solved_rates([r[1] for r in mine if r[1]], target) if sum(r[1] for r in mine) else []
        # The mean size counts documents without words too, which only rescales the tilt.
        assert np.allclose([r[4] for r in mine if r[1]], rates, rtol=1e-4, atol=1e-5), s
        assert all(r[5] in (math.floor(r[4]), math.ceil(r[4])) and r[6] == r[5] * r[1] for r in mine)
        assert abs(sum(r[6] for r in mine) - target) <= max(5, 0.01 * target), s


def test_mix_of_odd_rows(spark, edge_docs, no_docs, edge_texts):
    found = entropy_mix(edge_docs.withColumn("source", F.lit(None).cast("string"))).collect()
    assert sorted((r.doc_id or 0, r.size) for r in found) == sorted((i or 0, len(t.split())) for i, t in edge_texts)
    assert all(r.taken == r.copies * r.size <= 3 * r.size and r.target == r.source_size for r in found)
    assert entropy_mix(no_docs.withColumn("source", F.lit("a"))).collect() == []


def test_carry_reaches_smaller_classes():
    sizes, n, rates = np.array([1000, 7, 3]), np.array([1, 500, 2]), np.array([0.5, 1.5, 2.5])
    base, extra = rounded_copies(sizes, n, rates)
    assert abs(((base * n + extra) * sizes).sum() - (rates * n * sizes).sum()) <= 1.5
    assert (extra <= n).all() and (base + 1 <= 3).all()


def test_words_are_split_at_the_six_blanks_only(spark):
    text = "a\xa0b\tc\x0bd e\x1cf\x85g\rh\n"
    assert spark.createDataFrame([(text,), (None,), ("",)], "t string").select(word_count(F.col("t"))).collect() == [(5,), (0,), (0,)]


