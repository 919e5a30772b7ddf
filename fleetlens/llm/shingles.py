"""Sets of five-word shingles, as 64-bit hashes."""

from __future__ import annotations

import numpy as np

from fleetlens.llm.textbytes import BLANK, Rolling, lower_table, member_table, mixed, runs

WORDS = 5


def shingle_sets(
    rolling: Rolling, data: np.ndarray, bounds: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending within a text.

    Returns the hashes of all texts in order, where each text begins among them, and for each text
    a hash over its whole sequence of words. Words are runs of bytes other than blanks, A to Z
    lowered. A text of fewer than five words has its whole sequence as its only shingle; one
    without words has none.
    """
    n = len(bounds) - 1
    lowered = lower_table()[data]
    starts, ends, row = runs(lowered, bounds, ~member_table(BLANK))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64), np.zeros(n, np.uint64)
    hashes = rolling.words(rolling.bytes[lowered], starts, ends)
    counts = np.bincount(row, minlength=n)
    first = np.concatenate([[0], np.cumsum(counts)])
    sums = rolling.sums(hashes)
    whole = rolling.stretches(sums, first[:-1], first[1:])
    at = np.arange(len(hashes))
    place = at - first[row]
    begin = at[(place + WORDS <= counts[row]) | ((place == 0) & (counts[row] < WORDS))]
    owner = row[begin]
    value = rolling.stretches(sums, begin, np.minimum(begin + WORDS, first[owner + 1]))
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), dtype=bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[fresh], owner[fresh]
    return value, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]), whole


def signatures(values: np.ndarray, first: np.ndarray, hashes: int, seed: int = 7) -> np.ndarray:
    """For each set, 16 bits of the minimum under each hash function; zeros for an empty set."""
    rng = np.random.default_rng(seed)
    factor = rng.integers(1, 1 << 63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    offset = rng.integers(0, 1 << 63, hashes, dtype=np.uint64)
    out = np.zeros((len(first) - 1, hashes), dtype=np.uint16)
    filled = np.flatnonzero(first[1:] > first[:-1])
    if len(filled):
        at = first[:-1][filled]
        for k in range(hashes):
            least = np.minimum.reduceat(values * factor[k] + offset[k], at)
            out[filled, k] = (mixed(least) >> np.uint64(48)).astype(np.uint16)
    return out
