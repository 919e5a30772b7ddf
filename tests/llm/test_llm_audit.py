"""Audits of a shard: links to other vectors count, not hits on itself, and other shards' vectors are audited too."""

from __future__ import annotations

import numpy as np

from fleetlens.llm.hnsw import BEAM, Shard


def sparse(n, pairs, seed=1, dims=24):
    """Vectors without near ones, but for so many near pairs."""
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(n, dims))
    rows[n - pairs :] = rows[:pairs] + rng.normal(size=(pairs, dims)) * 0.02
    return rows / np.linalg.norm(rows, axis=1)[:, None]


def links_of(queries, rows):
    return set(zip(*(x.tolist() for x in np.nonzero(queries @ rows.T >= 0.93))))


def cut(shard):
    """Take all links out of the graph, so that a search finds little more than its entry."""
    for near in shard.graph.near:
        near[:] = -1


def test_one_link_in_a_shard_is_audited():
    rows = sparse(1500, 1)
    shard = Shard(rows, 0.93)
    assert links_of(rows, rows) <= set(zip(*(x.tolist() for x in shard.links(rows, inside=True))))
    cut(shard)
    shard.beam = BEAM
    shard.audit()
    assert shard.beam > BEAM
    assert links_of(rows, rows) <= set(zip(*(x.tolist() for x in shard.links(rows, inside=True))))


def test_no_link_in_a_shard_widens_nothing():
    shard = Shard(sparse(1500, 0), 0.93)
    assert shard.beam == BEAM


def test_queries_of_other_shards_are_audited():
    rows = sparse(1500, 0)
    queries = rows[::5] + np.random.default_rng(4).normal(size=(300, rows.shape[1])) * 0.02
    queries /= np.linalg.norm(queries, axis=1)[:, None]
    shard = Shard(rows, 0.93)
    wanted = links_of(queries, rows)
    assert wanted == set(zip(*(x.tolist() for x in shard.links(queries))))
    cut(shard)
    assert wanted == set(zip(*(x.tolist() for x in shard.links(queries))))
    assert shard.beam >= len(rows)


def test_tiny_shards_and_batches():
    for n in (1, 2, 49):
        rows = sparse(n, n // 2)
        shard = Shard(rows, 0.93)
        for queries in (rows, rows[:1]):
            assert links_of(queries, rows) == set(zip(*(x.tolist() for x in shard.links(queries))))


def test_a_dense_group_does_not_hide_single_links():
    rows = sparse(1200, 100)
    rows[200:500] = rows[200] + np.random.default_rng(6).normal(size=(300, rows.shape[1])) * 0.01
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    shard = Shard(rows, 0.93)
    everything = links_of(rows, rows)
    single = {(a, b) for a, b in everything if not (200 <= a < 500) and a != b}
    got = set(zip(*(x.tolist() for x in shard.links(rows, inside=True))))
    assert single and len(single & got) >= 0.98 * len(single)
    left, right = (np.array(x) for x in zip(*sorted(everything)))
    dense = (left >= 200) & (left < 500)
    assert shard.misses(left, right, left[dense], right[dense])
    assert not shard.misses(left, right, left, right)
