"""Byte-level BPE: encoding in batched merge rounds, and decoding."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fleetlens.llm.pretokens import byte_level_units, class_table, code_points, split_special
from fleetlens.llm.textbytes import Rolling, text_batches

NO_RANK = np.int64(1) << 40
KNOWN_WORDS = 1_000_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones stand for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def read_vocabulary(path: str) -> dict:
    """Arrays of a byte-level BPE vocabulary file; small and of a fixed size, so it can be broadcast."""
    held = json.loads(Path(path).read_text(encoding="utf-8"))
    ids: dict[str, int] = held["model"]["vocab"]
    letters = byte_letters()
    of_letter = {letter: byte for byte, letter in enumerate(letters)}
    pairs = {}
    for rank, merge in enumerate(held["model"]["merges"]):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        pairs.setdefault((ids[left] << 32) | ids[right], (rank, ids[left + right]))
    keys = np.array(sorted(pairs), dtype=np.int64)
    special = {t["content"]: t["id"] for t in held["added_tokens"]}
    if len(special) != 1:
        raise ValueError("a vocabulary with one special token is expected")
    texts: dict[int, bytes] = {i: bytes(of_letter[c] for c in token) for token, i in ids.items() if token not in special}
    texts |= {i: token.encode() for token, i in special.items()}
    pieces = [texts.get(i, b"") for i in range(max(texts) + 1)]
    return {
        "bytes": np.array([ids[letter] for letter in letters], dtype=np.int64),
        "keys": keys,
        "ranks": np.array([pairs[k][0] for k in keys.tolist()], dtype=np.int64),
        "made": np.array([pairs[k][1] for k in keys.tolist()], dtype=np.int64),
        "special": next(iter(special)).encode(),
        "special_id": next(iter(special.values())),
        "pieces": np.frombuffer(b"".join(pieces), dtype=np.uint8),
        "piece_ends": np.cumsum([0] + [len(p) for p in pieces]),
        "classes": class_table(),
    }


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


class Merger:
    """Merge rounds over the symbols of many words in one flat array."""

    def __init__(self, vocabulary: dict) -> None:
        self.keys, self.ranks, self.made = vocabulary["keys"], vocabulary["ranks"], vocabulary["made"]

    def ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair, found by binary search over the sorted pair keys, and the symbol it makes."""
        key = (left << np.int64(32)) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NO_RANK), self.made[at]

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each word has. No word is empty.

        Each round merges, in every word, all places of the pair of lowest rank, from the left where
        they overlap. A merge makes pairs of higher rank only, so this is the order of one merge at a time.
        """
        word = np.repeat(np.arange(len(lengths)), lengths)
        rank = np.full(len(symbols), NO_RANK)
        made = np.zeros(len(symbols), dtype=np.int64)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner], made[inner] = self.ranked(symbols[inner], symbols[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.append(starts, len(word)))
            least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            open_ = least < NO_RANK
            if not open_.all():
                done.append((word[~open_], symbols[~open_]))
                word, symbols, rank, made, least = (x[open_] for x in (word, symbols, rank, made, least))
                if not len(symbols):
                    break
            chosen = rank == least
            at = np.flatnonzero(chosen)
            chained = np.concatenate([[False], at[1:] == at[:-1] + 1])
            if chained.any():  # a run of one symbol: every second pair overlaps the one before it
                begin = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - begin) % 2 == 0]
            symbols[at] = made[at]
            stay = np.ones(len(symbols), dtype=bool)
            stay[at + 1] = False
            place = np.cumsum(stay) - 1
            at = place[at]
            word, symbols, rank, made = word[stay], symbols[stay], rank[stay], made[stay]
            changed = np.unique(np.concatenate([at, at[at > 0] - 1]))
            rank[changed] = NO_RANK
            changed = changed[changed + 1 < len(word)]
            changed = changed[word[changed] == word[changed + 1]]
            rank[changed], made[changed] = self.ranked(symbols[changed], symbols[changed + 1])
        words = np.concatenate([w for w, _ in done]) if done else np.zeros(0, np.int64)
        ids = np.concatenate([s for _, s in done]) if done else np.zeros(0, np.int64)
        order = np.argsort(words, kind="stable")
        return ids[order], np.bincount(words, minlength=len(lengths))


class Known:
    """Ids of the words a task has met, by hash. Forgotten as a whole when there are many."""

    def __init__(self, limit: int = KNOWN_WORDS) -> None:
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.starts = self.lengths = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def missing(self, hashes: np.ndarray) -> np.ndarray:
        if len(self.hashes) > self.limit:
            self.clear()
        at = np.searchsorted(self.hashes, hashes)
        found = np.zeros(len(hashes), dtype=bool)
        inside = at < len(self.hashes)
        found[inside] = self.hashes[at[inside]] == hashes[inside]
        return np.flatnonzero(~found)

    def learn(self, hashes: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        starts = len(self.ids) + np.cumsum(lengths) - lengths
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
        merged = np.concatenate([self.hashes, hashes])
        order = np.argsort(merged, kind="stable")
        self.hashes = merged[order]
        self.starts = np.concatenate([self.starts, starts])[order]
        self.lengths = np.concatenate([self.lengths, lengths])[order]

    def get(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.hashes, hashes)
        return self.starts[at], self.lengths[at]


class Encoder:
    """Encodes texts of one task; each different word is merged once."""

    def __init__(self, vocabulary: dict) -> None:
        self.vocabulary, self.merger, self.known, self.rolling = vocabulary, Merger(vocabulary), Known(), Rolling()

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has."""
        n = len(bounds) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        parts, special = split_special(data, bounds, self.vocabulary["special"])
        points, places = code_points(data)
        first = np.searchsorted(places, parts[:-1])
        units = byte_level_units(points, self.vocabulary["classes"][points], first)
        starts = places[np.flatnonzero(units)]
        if special.any():
            part = np.searchsorted(parts, starts, side="right") - 1
            starts = starts[~special[part] | (starts == parts[part])]
            fixed = special[np.searchsorted(parts, starts, side="right") - 1]
        else:
            fixed = None
        ends = np.append(starts[1:], len(data))
        hashes = self.rolling.words(self.rolling.bytes[data], starts, ends)
        unique, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        new = self.known.missing(unique)
        if len(new):
            at = index[new]
            lengths = ends[at] - starts[at]
            symbols = self.vocabulary["bytes"][gathered(data, starts[at], lengths)]
            self.known.learn(unique[new], *self.merger.merge(symbols, lengths))
        at, lengths = self.known.get(unique)
        counts = lengths[inverse]
        ids = gathered(self.known.ids, at[inverse], counts)
        if fixed is not None:
            last = np.cumsum(counts)
            keep = np.repeat(~fixed, counts)
            keep[(last - counts)[fixed]] = True
            ids[(last - counts)[fixed]] = self.vocabulary["special_id"]
            ids = ids[keep]
            counts = np.where(fixed, 1, counts)
        row = np.searchsorted(bounds, starts, side="right") - 1
        return ids, np.bincount(row, weights=counts, minlength=n).astype(np.int64)


def with_vocabulary(docs: DataFrame, path: str):
    return docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of each text under the byte-level BPE vocabulary in the file at ``path``.

    One row per input row: the id, ``n_tokens``, and ``ids`` as unsigned 32-bit little-endian numbers
    in a binary. No special tokens are added; the text of the special token is encoded as that token.
    A null text counts as empty and has no ids. Ids may repeat or be null. Other columns are not
    read. The file is read by the driver and broadcast; its size does not depend on the data.
    """
    vocabulary = with_vocabulary(docs, path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for rows, data, bounds in text_batches(batches, "text"):
            ids, counts = encoder.encode(data, bounds)
            ends = np.concatenate([[0], np.cumsum(counts)])
            binary = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(counts), [None, pa.py_buffer(ends * 4), pa.py_buffer(ids.astype("<u4"))]
            )
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(counts), binary.cast(pa.binary())], names=["id", "n_tokens", "ids"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    return rows.mapInArrow(encode, f"id {kind}, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def decode_ids(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Replace the ids of each row by their text; special tokens are shown, bytes that are no UTF-8 replaced.

    Null ids give a null text. Ids outside the vocabulary are left out. All other columns stay.
    """
    vocabulary = with_vocabulary(rows, path)
    kept = [f"`{c}`" for c in rows.columns if c != ids_col]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, ends = vocabulary.value["pieces"], vocabulary.value["piece_ends"]
        for batch in batches:
            texts = []
            for held in batch.column(batch.num_columns - 1):
                if not held.is_valid:
                    texts.append(None)
                    continue
                ids = np.frombuffer(held.as_buffer(), dtype="<u4").astype(np.int64)
                ids = ids[ids < len(ends) - 1]
                found = gathered(pieces, ends[ids], ends[ids + 1] - ends[ids])
                texts.append(found.tobytes().decode("utf-8", errors="replace"))
            columns = [*batch.columns[:-1], pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], text_col])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != ids_col), f"`{text_col}` string"])
    return rows.selectExpr(*kept, f"`{ids_col}`").mapInArrow(decode, schema)
