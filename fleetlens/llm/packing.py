"""Packing of tokenised documents into sequences: dominance reduction, then best fit."""

from __future__ import annotations

import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetlens.llm.bpe import Known, gathered
from fleetlens.llm.pretokens import SPACE, class_table, code_points, word_units
from fleetlens.llm.textbytes import Rolling, mixed, text_batches
from fleetlens.session import stored

CAPACITY = 2048
WORDS_AT_ONCE = 20_000
PLAIN_RANGES = ((0x00, 0x250), (0x2010, 0x2028), (0x2030, 0x205F))

Pattern = tuple[tuple[int, int], ...]  # lengths and how often each, longest first


# --- the plan, on counts by length --------------------------------------------------------------


class Counts:
    """How many pieces of each length are left."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.order = sorted(self.n)

    def take(self, length: int, n: int) -> None:
        self.n[length] -= n
        if not self.n[length]:
            del self.n[length]
            self.order.pop(bisect_left(self.order, length))

    def largest(self, limit: int, used: tuple[int, ...] = ()) -> int:
        """Largest length up to ``limit`` of which a piece is left beside those used; 0 for none."""
        at = bisect_left(self.order, limit + 1) - 1
        while at >= 0 and self.n[self.order[at]] <= used.count(self.order[at]):
            at -= 1
        return self.order[at] if at >= 0 else 0

    def smallest(self, over: int, how_many: int, used: tuple[int, ...]) -> list[int]:
        """The smallest pieces longer than ``over``, beside those used."""
        found: list[int] = []
        for length in self.order[bisect_left(self.order, over + 1) :]:
            found += [length] * min(how_many - len(found), self.n[length] - used.count(length))
            if len(found) >= how_many:
                break
        return found


def dominating(left: Counts, longest: int, capacity: int) -> tuple[int, ...] | None:
    """A set with ``longest`` of at most three pieces that dominates all its other sets, if one is known.

    A set dominates another if the pieces of the other can take the places of its own: then some
    best packing has the set as one of its sequences.
    """
    rest = capacity - longest
    best = left.largest(rest, (longest,))
    if not best:
        return (longest,)
    if best == rest:  # whatever else goes with the longest piece fits where this one was
        return (longest, best)
    smallest = left.smallest(0, 3, (longest,))
    if len(smallest) < 2 or smallest[0] + smallest[1] > rest:
        return (longest, best)
    if len(smallest) == 3 and sum(smallest) <= rest:
        return None
    second = left.largest(rest - best, (longest, best))
    if second:
        # Any pair has its longer piece at most as long as best; is the shorter one at most second?
        larger = left.smallest(second, 2, (longest,))
        if len(larger) < 2 or larger[0] + larger[1] > rest:
            return (longest, best, second)
    return None


def reduce_by_dominance(left: Counts, capacity: int) -> list[tuple[Pattern, int]]:
    """Fix dominating sets, from the longest pieces on, and take their pieces away."""
    fixed = []
    longest = left.largest(capacity)
    while longest:
        chosen = dominating(left, longest, capacity)
        if chosen is None:
            longest = left.largest(longest - 1)
            continue
        pattern = tuple((k, chosen.count(k)) for k in sorted(set(chosen), reverse=True))
        # The set dominates while its pieces last, as there are only fewer others to compare it with.
        n = min(left.n[k] // m for k, m in pattern)
        for length, m in pattern:
            left.take(length, n * m)
        fixed.append((pattern, n))
        if longest not in left.n:
            longest = left.largest(longest)
    return fixed


def best_fit(left: Counts, capacity: int) -> list[tuple[Pattern, int]]:
    """Longest pieces first, each into the fullest sequence that has room; equal sequences go together."""
    rooms: list[int] = []
    bins: dict[int, list[tuple[Pattern, int]]] = {}

    def put(room: int, pattern: Pattern, n: int) -> None:
        if room not in bins:
            insort(rooms, room)
            bins[room] = []
        bins[room].append((pattern, n))

    for length in reversed(left.order):
        n = left.n[length]
        while n:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                pattern, bins_n = bins[room].pop()
                if not bins[room]:
                    del bins[room]
                    rooms.pop(at)
            else:
                room, pattern, bins_n = capacity, (), n
            each = room // length  # a sequence stays the fullest one that has room until it has none
            full = min(bins_n, n // each)
            if full:
                put(room - each * length, (*pattern, (length, each)), full)
                n -= full * each
            if full < bins_n and n and n < each:
                put(room - n * length, (*pattern, (length, n)), 1)
                full, n = full + 1, 0
            if full < bins_n and pattern:
                put(room, pattern, bins_n - full)
    return [entry for group in bins.values() for entry in group]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Sequences for so many pieces of each length: what goes into one, and how many are alike."""
    if any(not 0 < k <= capacity for k in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    left = Counts(counts)
    return reduce_by_dominance(left, capacity) + best_fit(left, capacity)


def places(patterns: list[tuple[Pattern, int]]) -> dict[int, np.ndarray]:
    """For each length, rows of: first rank, first sequence, pieces of the length in one, offset of the first."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for pattern, n in patterns:
        offset = 0
        for length, each in pattern:
            rank = ranks.get(length, 0)
            found.setdefault(length, []).append((rank, sequence, each, offset))
            ranks[length] = rank + n * each
            offset += length * each
        sequence += n
    return {length: np.array(rows, dtype=np.int64) for length, rows in found.items()}


# --- tokens ---------------------------------------------------------------------------------------


def plain_table() -> np.ndarray:
    """Code points that normalise to themselves, combine with nothing and have one lower-case letter."""
    table = np.zeros(0x110000, dtype=bool)
    for low, high in PLAIN_RANGES:
        for point in range(low, high):
            c = chr(point)
            table[point] = (
                unicodedata.normalize("NFC", c) == c and not unicodedata.combining(c) and len(c.lower()) == 1
            )
    return table


def lower_points() -> np.ndarray:
    table = np.arange(0x2060, dtype=np.uint32)
    for low, high in PLAIN_RANGES:
        for point in range(low, high):
            if len(chr(point).lower()) == 1:
                table[point] = ord(chr(point).lower())
    return table


class WordEncoder:
    """Encodes texts with a lower-casing vocabulary of words; each different word is encoded once a task.

    Texts with letters that normalisation may change, or with a special token, go to the tokenizer whole.
    """

    def __init__(self, vocabulary: bytes, classes: np.ndarray, plain: np.ndarray) -> None:
        self.tokenizer = Tokenizer.from_buffer(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.classes, self.plain, self.lower = classes, plain, lower_points()
        self.values = mixed(np.arange(1, 0x10000, dtype=np.uint64))
        self.known, self.rolling = Known(), Rolling()

    def learn(self, hashes: np.ndarray, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        for at in range(0, len(hashes), WORDS_AT_ONCE):
            some = slice(at, at + WORDS_AT_ONCE)
            joined = np.full(int((lengths[some] + 1).sum()), 0x20, dtype=np.uint32)
            ends = np.cumsum(lengths[some] + 1) - 1
            inside = np.ones(len(joined), dtype=bool)
            inside[ends] = False
            joined[inside] = gathered(points, starts[some], lengths[some])
            found = self.tokenizer.encode(joined.tobytes().decode("utf-32-le"), add_special_tokens=False)
            counts = np.bincount(np.array(found.word_ids, dtype=np.int64), minlength=len(ends))
            self.known.learn(hashes[some], np.array(found.ids, dtype=np.uint32), counts)

    def simple(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(bounds) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        raw, offsets = code_points(data)
        points = self.lower[raw]
        kinds = self.classes[raw]
        first = np.searchsorted(offsets, bounds[:-1])
        starts = np.flatnonzero(word_units(points, kinds, first))
        ends = np.append(starts[1:], len(points))
        words = kinds[starts] != SPACE
        starts, ends = starts[words], ends[words]
        hashes = self.rolling.words(self.values[points], starts, ends)
        unique, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        new = self.known.missing(unique)
        if len(new):
            at = index[new]
            self.learn(unique[new], points, starts[at], ends[at] - starts[at])
        at, lengths = self.known.get(unique)
        counts = lengths[inverse]
        row = np.searchsorted(first, starts, side="right") - 1
        return gathered(self.known.ids, at[inverse], counts), np.bincount(row, weights=counts, minlength=n).astype(np.int64)

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has."""
        n = len(bounds) - 1
        points, offsets = code_points(data)
        odd = np.zeros(n, dtype=bool)
        at = offsets[:-1][~self.plain[points]]
        odd[np.searchsorted(bounds, at, side="right") - 1] = True
        whole = data.tobytes()
        if any(token in whole for token in self.special):
            for row in range(n):
                odd[row] |= any(token in whole[bounds[row] : bounds[row + 1]] for token in self.special)
        if not odd.any():
            return self.simple(data, bounds)
        sizes = np.diff(bounds)
        kept = gathered(data, bounds[:-1][~odd], sizes[~odd])
        ids, some = self.simple(kept, np.concatenate([[0], np.cumsum(sizes[~odd])]))
        texts = [whole[bounds[r] : bounds[r + 1]].decode() for r in np.flatnonzero(odd)]
        others = [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        counts = np.zeros(n, dtype=np.int64)
        counts[~odd], counts[odd] = some, [len(x) for x in others]
        both = np.concatenate([ids, *others])
        starts = np.zeros(n, dtype=np.int64)
        starts[~odd] = np.cumsum(some) - some
        starts[odd] = len(ids) + np.cumsum(counts[odd]) - counts[odd]
        return gathered(both, starts, counts), counts


def token_pieces(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Tokenise texts, add ``end_id``, and cut those longer than ``capacity`` into pieces of that length.

    One row per piece: the id, ``piece``, ``start``, ``length``, ``ids`` (unsigned 32-bit
    little-endian numbers in a binary), ``ids_crc32``, and ``task`` and ``rank``: the piece is
    the ``rank``-th of its length in its task, from 0. A null text counts as empty and has one id.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((Path(path).read_bytes(), class_table(), plain_table()))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(*held.value)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for rows, data, bounds in text_batches(batches, "text"):
            ids, counts = encoder.encode(data, bounds)
            sizes = counts + 1
            ends = np.cumsum(sizes)
            full = np.full(int(ends[-1]), end_id, dtype="<u4")
            inside = np.ones(len(full), dtype=bool)
            inside[ends - 1] = False
            full[inside] = ids
            per_row = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), per_row)
            number = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
            start = number * capacity
            length = np.minimum(sizes[row] - start, capacity)
            begin = (ends - sizes)[row] + start
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
            group_start = np.maximum.accumulate(np.where(fresh, np.arange(len(ordered)), 0))
            rank = np.empty(len(length), dtype=np.int64)
            rank[order] = np.arange(len(ordered)) - group_start + seen[ordered]
            seen += np.bincount(length, minlength=capacity + 1)
            raw = full.tobytes()
            parts = [raw[4 * b : 4 * (b + n)] for b, n in zip(begin.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0).take(pa.array(row)),
                    pa.array(number.astype(np.int32)),
                    pa.array(start),
                    pa.array(length),
                    pa.array(parts, pa.binary()),
                    pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                    pa.array(np.full(len(row), task, dtype=np.int32)),
                    pa.array(rank),
                ],
                names=["id", "piece", "start", "length", "ids", "ids_crc32", "task", "rank"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    schema = f"id {kind}, piece int, start long, length long, ids binary, ids_crc32 long, task int, rank long"
    return rows.mapInArrow(pieces, schema).withColumnRenamed("id", id_col)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every piece a ``sequence_id`` and an ``offset``, with as few sequences as the method finds.

    ``pieces`` has ``length`` (1 to ``capacity``) and ``task`` and ``rank`` as ``token_pieces`` numbers
    them; it must be a stored table, as the numbers are read twice. Pieces of one length are
    interchangeable, so the plan is made on counts by length: the driver gets one row per length,
    ``capacity`` rows at most, whatever the number of pieces. Sequences have no gaps.

    Sets of one to three pieces that provably dominate all other sets with the same longest piece
    are fixed first and their pieces taken away; the others are packed by best fit, longest first.
    """
    spark = pieces.sparkSession
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    held = spark.sparkContext.broadcast(places(plan(counts, capacity)))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    columns = [c for c in pieces.columns if c not in ("task", "rank")]
    ranked = pieces.join(before, ["length", "task"]).select(*columns, (F.col("before") + F.col("rank")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = held.value
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.num_columns - 1).to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for one in np.unique(length).tolist():
                at = np.flatnonzero(length == one)
                rows = found[one][np.searchsorted(found[one][:, 0], rank[at], side="right") - 1]
                after = rank[at] - rows[:, 0]
                sequence[at] = rows[:, 1] + after // rows[:, 2]
                offset[at] = rows[:, 3] + after % rows[:, 2] * one
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence), pa.array(offset)],
                names=[*columns, "sequence_id", "offset"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields[:-1])
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def packed_documents(
    docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pack whole documents, tokenised with the vocabulary file at ``path``, into sequences.

    One row per piece: the id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``,
    ``offset``. Only documents longer than ``capacity`` are cut. Null and empty texts are one end
    token; ids may repeat or be null; an empty table gives an empty result; other columns are not
    read. The ids themselves are not kept here; ``token_pieces`` returns them.
    """
    pieces = stored(token_pieces(docs, path, capacity, 0, id_col, text_col).drop("ids"), "packing-pieces")
    return pack(pieces, capacity)
