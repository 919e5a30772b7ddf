"""Splitting of many texts into the units that byte-pair merges stay inside, on arrays of code points."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
# The code points with Unicode's White_Space property.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Endings that stay with their apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def class_table() -> np.ndarray:
    """Letter, number, white space or other, for each code point."""
    table = np.zeros(0x110000, dtype=np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for point in range(0x110000):
        if 0xD800 <= point < 0xE000:
            continue
        kind = kinds.get(unicodedata.category(chr(point))[0])
        if kind:
            table[point] = kind
    table[WHITE] = SPACE
    return table


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the byte at which each begins, the end included."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    return points, np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))


def split_special(data: np.ndarray, bounds: np.ndarray, special: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bounds with every occurrence of ``special`` as a part of its own, and which parts those are.

    An occurrence that would span two texts is none.
    """
    starts = []
    for found in re.finditer(re.escape(special), data.tobytes()):
        row = int(np.searchsorted(bounds, found.start(), side="right")) - 1
        if found.end() <= bounds[row + 1]:
            starts.append(found.start())
    at = np.array(starts, dtype=np.int64)
    parts = np.sort(np.concatenate([bounds, at, at + len(special)]))
    if len(at):  # texts that begin or end with the special token get no empty parts beside it
        parts = np.unique(parts)
    return parts, np.isin(parts[:-1], at)


def _endings(points: np.ndarray, candidates: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of apostrophes, those with an ending after them before their text stops; and the ending's length."""
    length = np.zeros(len(candidates), dtype=np.int64)
    padded = np.concatenate([points, np.zeros(3, np.uint32)])
    for ending in ENDINGS:
        fits = candidates + 1 + len(ending) <= stops
        for i, letter in enumerate(ending):
            fits &= padded[candidates + 1 + i] == ord(letter)
        length[fits & (length == 0)] = len(ending)
    return candidates[length > 0], length[length > 0]


def _run_starts(kinds: np.ndarray, first: np.ndarray) -> np.ndarray:
    starts = np.empty(len(kinds), dtype=bool)
    starts[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=starts[1:])
    starts[first[first < len(kinds)]] = True
    return starts


def byte_level_units(points: np.ndarray, kinds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where units begin: words, numbers and other runs with one blank before them, and white space.

    ``first`` are the code points at which texts begin. This is the split of byte-level vocabularies:
    an apostrophe with one of a few endings is a unit; of several white-space characters before a
    unit the last one is left over, and joins that unit if it is a blank.
    """
    if not len(points):
        return np.zeros(0, dtype=bool)
    runs = _run_starts(kinds, first)
    units = runs.copy()
    begins = np.zeros(len(points) + 1, dtype=bool)
    begins[first] = True
    after_space = np.flatnonzero(runs[1:] & (kinds[1:] != SPACE) & (kinds[:-1] == SPACE) & ~begins[1:-1]) + 1
    units[after_space - 1] = True
    units[after_space] = points[after_space - 1] != 0x20
    marks = np.flatnonzero(units & runs & (points == 0x27))
    stops = np.append(first, len(points))[np.searchsorted(first, marks, side="right")]
    marks, length = _endings(points, marks, stops)
    units[marks + 1] = False
    after = marks + 1 + length
    units[after[after < len(points)]] = True
    return units


def word_units(points: np.ndarray, kinds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where units begin that drop white space: words, single numerals, other runs, white-space runs."""
    if not len(points):
        return np.zeros(0, dtype=bool)
    runs = _run_starts(kinds, first)
    units = runs | (kinds == NUMBER)
    marks = np.flatnonzero(runs & (points == 0x27))
    stops = np.append(first, len(points))[np.searchsorted(first, marks, side="right")]
    marks, length = _endings(points, marks, stops)
    units[marks + 1] = False
    after = marks + 1 + length
    units[after[after < len(points)]] = True
    return units
