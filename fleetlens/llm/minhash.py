"""Near duplicates by a multi-index Hamming join of b-bit MinHash signatures."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.components import components
from fleetlens.llm.shingles import shingle_sets, signatures
from fleetlens.llm.textbytes import Rolling, mixed, text_batches
from fleetlens.session import stored

BLOCK = 512
SYMBOL_BITS = 16
LOSS = 3e-5  # the highest probability that a pair of just the wanted similarity is lost


@dataclass(frozen=True)
class Index:
    """How signatures of ``hashes`` 16-bit symbols are cut for pairs that differ in ``distance`` at most.

    Of ``chunks`` chunks, with ``distance = chunks * e + rest``, one of the first ``rest + 1`` has at
    most ``e`` differing symbols or one of the others at most ``e - 1``: else more than ``distance``
    would differ. So a chunk of the first kind is indexed once for each way to leave out ``e`` of
    its symbols, here one, and a chunk of the second kind with none left out. 64 hashes and a
    distance of 22 lose a pair of similarity 0.85 with a probability of 3 in 100,000, and more
    similar pairs with a lower one. ``for_percent`` has a distance for other similarities.
    """

    hashes: int = 64
    distance: int = 22
    chunks: int = 16

    def __post_init__(self) -> None:
        if self.hashes % 4 or self.hashes % self.chunks or not self.chunks <= self.distance < 2 * self.chunks:
            raise ValueError("hashes must fill words, and chunks divide them and allow one error in some of them")
        if self.width < 2:
            raise ValueError("a chunk that may leave out one symbol must have another")

    @classmethod
    def for_percent(cls, percent: int, hashes: int = 64) -> Index:
        """The index that loses a pair of this similarity with a probability of ``LOSS`` at most.

        Symbols differ independently with the chance of ``1 - percent / 100``. From a distance of half
        the hashes on, chunks have two symbols instead of four: their keys, of one or two symbols, are
        shared by many dissimilar documents, so the result is whole but slow. Raises ``ValueError`` where
        a pair may differ in all symbols.
        """
        q = 1 - percent / 100
        chance = [comb(hashes, k) * q**k * (1 - q) ** (hashes - k) for k in range(hashes + 1)]
        distance = next((d for d in range(hashes) if sum(chance[d + 1 :]) <= LOSS), hashes)
        for width in (4, 2):
            if distance < 2 * (hashes // width):
                return cls(hashes, max(distance, hashes // width), hashes // width)
        raise ValueError(f"{hashes} hashes cannot find pairs of a similarity of {percent} percent")

    @property
    def width(self) -> int:
        return self.hashes // self.chunks

    @property
    def loose(self) -> int:
        """Chunks with one allowed error."""
        return self.distance - self.chunks + 1

    def slots(self) -> list[tuple[int, int | None]]:
        """Chunk and left-out symbol of each key of a signature."""
        return [(c, p) for c in range(self.loose) for p in range(self.width)] + [
            (c, None) for c in range(self.loose, self.chunks)
        ]

    def keys(self, signature: np.ndarray) -> np.ndarray:
        """A key for each signature and slot."""
        parts = signature.reshape(len(signature), self.chunks, self.width).astype(np.uint64)
        out = np.empty((len(signature), len(self.slots())), dtype=np.uint64)
        for slot, (chunk, dropped) in enumerate(self.slots()):
            key = np.full(len(signature), slot + 1, dtype=np.uint64)
            for place in range(self.width):
                if place != dropped:
                    key = mixed((key << np.uint64(1)) ^ (parts[:, chunk, place] + np.uint64(0x632BE59BD9B4E019)))
            out[:, slot] = key
        return out

    def first_slot(self, same: np.ndarray) -> np.ndarray:
        """The first slot in which a pair has one key, from which of its symbols are the same."""
        wrong = ~same.reshape(len(same), self.chunks, self.width)
        errors = wrong.sum(axis=2)
        allowed = np.where(np.arange(self.chunks) < self.loose, 1, 0)
        chunk = np.argmax(errors <= allowed, axis=1)
        place = np.argmax(wrong[np.arange(len(same)), chunk], axis=1)
        return np.where(chunk < self.loose, chunk * self.width + place, self.loose * self.width + chunk - self.loose)


def differing(left: Column, right: Column, words: int) -> Column:
    """How many 16-bit symbols differ between two signatures held as arrays of longs."""
    total = F.lit(0)
    for i in range(words):
        x = F.get(left, F.lit(i)).bitwiseXOR(F.get(right, F.lit(i)))
        for shift in (8, 4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x0001000100010001)))
    return total


def _similar_sizes(a: str, b: str, percent: int) -> Column:
    """Whether sets of these sizes can reach the similarity at all."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _longs(flat: np.ndarray, per_row: int) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(flat.view(np.int64)), per_row).cast(pa.list_(pa.int64()))


def set_signatures(docs: DataFrame, index: Index) -> DataFrame:
    """Of each row (``id``, ``text``): size of its shingle set, two hashes of the set, and its signature."""
    words = index.hashes * SYMBOL_BITS // 64

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for rows, data, bounds in text_batches(batches, "text"):
            values, first, _ = shingle_sets(rolling, data, bounds)
            sums = []
            for salt in (0x9E6C63D0676A9A99, 0xC2B2AE3D27D4EB4F):
                total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(values ^ np.uint64(salt)))])
                sums.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
            signature = signatures(values, first, index.hashes)
            columns = [rows.column(0), pa.array(np.diff(first)), pa.array(sums[0]), pa.array(sums[1])]
            yield pa.RecordBatch.from_arrays(
                [*columns, _longs(np.ascontiguousarray(signature).reshape(-1).view(np.uint64), words)],
                names=["id", "n", "set_a", "set_b", "signature"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(sign, f"id {kind}, n long, set_a long, set_b long, signature array<long>")


def index_keys(sets: DataFrame, index: Index) -> DataFrame:
    """Rows of key, slot and id for each signature."""

    def enumerate_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = len(index.slots())
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                flat = part.column(1).flatten().to_numpy().view(np.uint16)
                keys = index.keys(flat.reshape(part.num_rows, index.hashes))
                rows = np.repeat(np.arange(part.num_rows), slots)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys.reshape(-1).view(np.int64)),
                        pa.array(np.tile(np.arange(slots, dtype=np.int8), part.num_rows)),
                        part.column(0).take(pa.array(rows)),
                    ],
                    names=["key", "slot", "id"],
                )

    kind = sets.schema["id"].dataType.simpleString()
    return sets.select("id", "signature").mapInArrow(enumerate_keys, f"key long, slot byte, id {kind}")


def full_sets(docs: DataFrame) -> DataFrame:
    """Of each row (``id``, ``text``): all shingle hashes, and 16 bits of each as a sketch."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for rows, data, bounds in text_batches(batches, "text"):
            values, first, _ = shingle_sets(rolling, data, bounds)
            sketch = np.ascontiguousarray((values >> np.uint64(48)).astype("<u2"))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.LargeListArray.from_arrays(pa.array(first), pa.array(values.view(np.int64))).cast(
                        pa.list_(pa.int64())
                    ),
                    pa.LargeBinaryArray.from_buffers(
                        pa.large_binary(), len(first) - 1, [None, pa.py_buffer(first * 2), pa.py_buffer(sketch)]
                    ).cast(pa.binary()),
                ],
                names=["id", "shingles", "sketch"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(collect, f"id {kind}, shingles array<long>, sketch binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (``a``, ``b``), those whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("right"))
    met = pairs.join(right, "b").join(left, "a")
    common = F.size(F.array_intersect("left", "right"))
    return met.filter(common * 100 >= (F.size("left") + F.size("right") - common) * percent).select("a", "b")


class Group:
    """Pairs of one key's rows that may be linked and are not yet connected, found once among the key's blocks.

    ``main`` marks members of the key's largest component, which are in their own block only. All others, the strays,
    are in every block: a stray meets a member there, and another stray in the lower of their own blocks.
    """

    def __init__(self, index: Index, percent: int) -> None:
        self.index, self.percent = index, percent

    def pairs(self, rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        n = rows.num_rows
        column = {name: rows.column(i) for i, name in enumerate(rows.schema.names)}
        size, component = column["n"].to_numpy(), column["component"].to_numpy()
        own, slot = column["own"].to_numpy(), int(column["slot"][0].as_py())
        main, block = column["main"].to_numpy(zero_copy_only=False), column["block"][0].as_py()
        signature = column["signature"].flatten().to_numpy().view(np.uint16).reshape(n, self.index.hashes)
        sketches = [np.frombuffer(s.as_buffer(), dtype="<u2") for s in column["sketch"]]
        lefts, rights = [], []
        for i in range(n - 1):
            after = np.arange(i + 1, n)
            fits = component[after] != component[i]
            fits &= main[after] | main[i] | (np.minimum(own[after], own[i]) == block)
            small, large = np.minimum(size[after], size[i]), np.maximum(size[after], size[i])
            after = after[fits & (small * 100 >= large * self.percent)]
            if not len(after):
                continue
            same = signature[after] == signature[i]
            near = same.sum(axis=1) >= self.index.hashes - self.index.distance
            after, same = after[near], same[near]
            if not len(after):
                continue
            after = after[self.index.first_slot(same) == slot]  # once a pair, not once a key
            if not len(after):
                continue
            inside = np.zeros(1 << SYMBOL_BITS, dtype=bool)
            inside[sketches[i]] = True
            lengths = np.array([len(sketches[j]) for j in after])
            hits = inside[np.concatenate([sketches[j] for j in after])]
            # Every common shingle is a hit, so this bounds the overlap from above.
            most = np.minimum(np.add.reduceat(hits.astype(np.int64), np.cumsum(lengths) - lengths), size[i])
            after = after[most * 100 >= (size[after] + size[i] - most) * self.percent]
            lefts.append(np.full(len(after), i))
            rights.append(after)
        none = np.zeros(0, dtype=np.int64)
        return np.concatenate([none, *lefts]), np.concatenate([none, *rights])


def cross_pairs(rows: DataFrame, index: Index, percent: int) -> DataFrame:
    """Pairs between components, from rows sorted by key and block within partitions."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = Group(index, percent), []

        def flush() -> pa.RecordBatch | None:
            together = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            left, right = group.pairs(together)
            ids = together.column(together.schema.get_field_index("id"))
            if not len(left):
                return None
            return pa.RecordBatch.from_arrays([ids.take(pa.array(left)), ids.take(pa.array(right))], names=["a", "b"])

        last = None
        for batch in batches:
            marks = np.stack([batch.column(i).to_numpy() for i in range(2)])
            cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            edges = [0, *cuts.tolist(), batch.num_rows]
            for begin, end in zip(edges, edges[1:]):
                if begin == end:
                    continue
                mark = tuple(marks[:, begin].tolist())
                if last is not None and mark != last:
                    found = flush()
                    held.clear()
                    if found is not None:
                        yield found
                last = mark
                held.append(batch.slice(begin, end - begin))
        if held:
            found = flush()
            if found is not None:
                yield found

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(find, f"a {kind}, b {kind}")


def near_duplicates(
    docs: DataFrame, percent: int = 85, index: Index | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Connect documents whose sets of five-word shingles overlap by ``percent`` of their union.

    One row per input row: the id, ``n_shingles``, ``component_id`` (smallest id reachable by links),
    ``kept`` (the id is the component's).

    Documents with one set are one class, known by the set's size and two 64-bit hashes of it, and
    take part through the class's smallest id. Candidates are pairs whose signatures differ in
    ``index.distance`` symbols at most; ``Index`` says why none is lost, and without an ``index`` the
    distance follows from ``percent``. They are met in two steps,
    because the members of a large group need not be met in all pairs to be connected: first each
    member of a key meets the smallest id under that key; then, under keys whose members are not all
    connected by what was confirmed, the unconnected pairs are searched inside tasks, block by
    block, and only pairs that pass a lossless bound on their overlap leave the task. There the members of a key's largest
    component have one row each and only the others are repeated over the blocks. Every link is
    confirmed on the full sets of 64-bit shingle hashes.

    Null and empty texts and texts of blanks have no shingles and are linked with nothing. Rows that
    repeat an id are one node, which has the links of each; a null id is linked with nothing and its ``component_id`` is null. An
    empty table gives an empty result. Other columns are not read and may have any name.
    """
    index = index or Index.for_percent(percent)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sets = stored(set_signatures(source, index), "near-sets")
    usable = sets.filter("n > 0 AND id IS NOT NULL")
    # Stored, so that a class of very many copies meets its rows in a join of its own, which can be split.
    classes = stored(usable.groupBy("n", "set_a", "set_b").agg(F.min("id").alias("rep")), "near-classes")
    classed = usable.select("id", "n", "set_a", "set_b").join(classes, ["n", "set_a", "set_b"])
    members = stored(classed.select("id", "n", "rep"), "near-members")
    chosen = usable.join(classes.select(F.col("rep").alias("id")), "id", "left_semi")
    reps = stored(chosen.select("id", "n", "signature"), "near-reps")

    keys = index_keys(reps, index)
    shared = keys.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("top")).filter("pivot < top")
    shared = stored(shared.drop("top"), "near-shared")  # few, and so a very frequent key's rows can be split
    rows = stored(keys.join(shared, "key"), "near-keys")

    words = index.hashes * SYMBOL_BITS // 64
    first = rows.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    left = reps.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("signature").alias("signature_a"))
    right = reps.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("signature").alias("signature_b"))
    near = (
        first.join(right, "b")
        .join(left, "a")
        .filter(_similar_sizes("n_a", "n_b", percent))
        .filter(differing(F.col("signature_a"), F.col("signature_b"), words) <= index.distance)
        .select("a", "b")
    )
    wanted = rows.select("id").distinct()
    full = full_sets(source.join(wanted, "id", "left_semi")).join(reps, "id")
    full = stored(full, "near-full")
    links = stored(confirmed(near, full, percent), "near-links")
    linked = components(links, "near-first")

    others = (
        rows.filter("id <> pivot")
        .join(linked.withColumnRenamed("node", "id"), "id", "left")
        .select("key", "slot", "id", F.coalesce("component", "id").alias("component"))
    )
    parts = others.groupBy("key", "component").agg(F.count(F.lit(1)).alias("rows"))
    mixed_keys = (
        parts.groupBy("key")
        .agg(
            F.max_by("component", "rows").alias("largest"),
            F.sum("rows").alias("members"),
            F.count(F.lit(1)).alias("components"),
        )
        .filter("components > 1")
        .select("key", "largest", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    )
    mixed_keys = stored(mixed_keys, "near-mixed")
    placed = (
        others.join(mixed_keys, "key")
        .withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("main", F.col("component") == F.col("largest"))
        .join(full.select("id", "n", "signature", "sketch"), "id")
    )
    everywhere = F.when(F.col("main"), F.array("own")).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    searched = (
        placed.withColumn("block", F.explode(everywhere))
        .select("key", "block", "slot", "own", "main", "id", "component", "n", "signature", "sketch")
        .repartition("key", "block")
        .sortWithinPartitions("key", "block")
    )
    later = cross_pairs(searched, index, percent).distinct()
    more = confirmed(later, full, percent)
    stars = linked.select(F.col("node").alias("a"), F.col("component").alias("b"))
    connected = components(stars.unionByName(more), "near-second")

    found = members.join(connected.withColumnRenamed("node", "rep"), "rep", "left")
    result = found.select("id", "n", F.coalesce("component", "rep").alias("component_id"))
    alone = sets.filter("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("component_id"))
    return result.unionByName(alone).select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
