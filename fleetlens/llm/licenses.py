"""Licence notices in texts, by patience alignment with templates."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.textbytes import Rolling, lower_table, member_table, runs, text_batches

COVERAGE = 0.8
STRETCH = 1.5
FOUND = [
    ("license", pa.string()),
    ("coverage", pa.float64()),
    ("matched", pa.int32()),
    ("words", pa.int32()),
    ("start", pa.int64()),
    ("end", pa.int64()),
]


def longest_increasing(values: list[int]) -> list[int]:
    """Positions of a longest strictly increasing subsequence, by dealing the values onto piles."""
    tops: list[int] = []
    piles: list[int] = []
    before = [-1] * len(values)
    for i, value in enumerate(values):
        pile = bisect_left(tops, value)
        if pile == len(tops):
            tops.append(value)
            piles.append(i)
        else:
            tops[pile], piles[pile] = value, i
        before[i] = piles[pile - 1] if pile else -1
    out = []
    at = piles[-1] if piles else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def align(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Pairs of places in text and template with the same word, ascending in both.

    Equal words at both ends are paired first. Of what is between, words that occur once in the
    text and once in the template are anchors; the longest run of them that is in order in both
    is kept, and the gaps between are aligned in the same way. A gap without anchors stays open.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        once = {template[j]: j for j in range(c, d) if there[template[j]] == 1}
        anchors = [(i, once[text[i]]) for i in range(a, b) if here[text[i]] == 1 and text[i] in once]
        if not anchors:
            continue
        kept = [anchors[k] for k in longest_increasing([j for _, j in anchors])]
        out += kept
        edges = [(a - 1, c - 1), *kept, (b, d)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(out)


class Template:
    def __init__(self, name: str, words: list[int], coverage: float, stretch: float) -> None:
        self.name, self.words = name, words
        self.least = ceil(coverage * len(words) - 1e-9)
        self.reach = ceil(stretch * len(words))
        self.counts = Counter(words)

    def stretches(self, places: list[int], words: list[int]) -> tuple[list[int], list[int]]:
        """For the stretch that begins at each word: where it ends, and how many words it could pair at most."""
        have: Counter[int] = Counter()
        ends, most = [], []
        covered = end = 0
        for begin, place in enumerate(places):
            while end < len(places) and places[end] < place + self.reach:
                have[words[end]] += 1
                covered += have[words[end]] <= self.counts[words[end]]
                end += 1
            ends.append(end)
            most.append(covered)
            covered -= have[words[begin]] <= self.counts[words[begin]]
            have[words[begin]] -= 1
        return ends, most

    def windows(self, places: list[int], words: list[int]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """Aligned stretches of a text, of which the template's words are given with their places.

        A stretch is as long as the template and half as much. Where one could pair enough words, the
        one that could pair most of those that begin inside it is aligned, and if that fails the
        stretch itself. What lies before the first word that was paired is searched in the same way, up to
        that word. The next one begins after the last word that was paired.
        """
        ends, most = self.stretches(places, words)
        begin, failed = 0, -1
        while begin < len(places):
            step = begin + 1
            if most[begin] >= self.least:
                inside = most[begin : ends[begin]]
                for at in dict.fromkeys((begin + inside.index(max(inside)), begin)):
                    if at == failed:
                        continue
                    pairs = align(words[at : ends[at]], self.words)
                    if len(pairs) >= self.least:
                        cut = at + pairs[0][0]
                        if cut - begin >= self.least:
                            for early, own in self.windows(places[begin:cut], words[begin:cut]):
                                yield begin + early, own
                        yield at, pairs
                        step = at + pairs[-1][0] + 1
                        break
                    failed = max(failed, at)
            begin = step


def words_of(rolling: Rolling, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end and row of each word: runs of letters and digits, and of all bytes beyond ASCII, lowered."""
    lowered = lower_table()[data]
    inside = member_table(bytes(b for b in range(256) if b >= 128 or chr(b).isalnum()))
    starts, ends, row = runs(lowered, bounds, inside)
    return rolling.words(rolling.bytes[lowered], starts, ends), starts, ends, row


def find_licenses(
    docs: DataFrame,
    templates: dict[str, str],
    coverage: float = COVERAGE,
    stretch: float = STRETCH,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``found`` of every text: the templates of which a stretch of it covers ``coverage`` of the words.

    One row per input row with its id; ``found`` has the template's name, the covered share, paired
    words, the template's words, and the bytes from the first to after the last paired word, by
    place and name. A notice that occurs several times is found each time.

    Only the words of the templates matter, so all texts are first searched for those in arrays; a
    text and a template are aligned if enough of the template's words occur in the text. Null and
    empty texts, and empty templates, have no finds. Ids may repeat or be null; an empty table gives
    an empty result. Other columns are not read and may have any name.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        each = []
        for name, text in sorted(templates.items()):
            raw = np.frombuffer(text.encode(), dtype=np.uint8)
            hashes = words_of(rolling, raw, np.array([0, len(raw)]))[0]
            if len(hashes):
                each.append((name, hashes))
        vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *(h for _, h in each)]))
        known = [Template(n, np.searchsorted(vocabulary, h).tolist(), coverage, stretch) for n, h in each]
        counts = np.zeros((len(vocabulary), len(known)), dtype=np.float32)
        for i, template in enumerate(known):
            for word, n in template.counts.items():
                counts[word, i] = n
        least = np.array([t.least for t in known])
        near = np.zeros(1 << 20, dtype=bool)
        near[vocabulary >> np.uint64(44)] = True
        kind = pa.list_(pa.struct(FOUND))
        for rows, data, bounds in text_batches(batches, "text"):
            found: list[list[tuple]] = [[] for _ in range(rows.num_rows)]
            hashes, starts, ends, row = words_of(rolling, data, bounds)
            at = np.flatnonzero(near[hashes >> np.uint64(44)])
            word = np.searchsorted(vocabulary, hashes[at])
            sure = word < len(vocabulary)
            sure[sure] = vocabulary[word[sure]] == hashes[at[sure]]
            at, word = at[sure], word[sure]
            present = np.zeros((rows.num_rows, len(vocabulary)), dtype=np.float32)
            present[row[at], word] = 1
            first = np.searchsorted(row[at], np.arange(rows.num_rows + 1))
            for r, t in zip(*np.nonzero(present @ counts >= least)):
                template = known[t]
                own = slice(first[r], first[r + 1])
                mine = counts[word[own], t] > 0
                places, words = at[own][mine], word[own][mine]
                for begin, pairs in template.windows(places.tolist(), words.tolist()):
                    low, high = places[begin + pairs[0][0]], places[begin + pairs[-1][0]]
                    found[r].append(
                        (
                            int(starts[low] - bounds[r]),
                            template.name,
                            len(pairs),
                            len(template.words),
                            int(ends[high] - bounds[r]),
                        )
                    )
            lists = [
                [
                    {"license": n, "coverage": m / w, "matched": m, "words": w, "start": s, "end": e}
                    for s, n, m, w, e in sorted(f)
                ]
                for f in found
            ]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(lists, kind)], names=["id", "found"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    one = "struct<license: string, coverage: double, matched: int, words: int, start: long, end: long>"
    return rows.mapInArrow(scan, f"id {kind}, found array<{one}>").withColumnRenamed("id", id_col)
