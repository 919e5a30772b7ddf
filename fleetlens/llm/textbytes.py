"""Words of many texts at once, as numpy arrays over one buffer of UTF-8 bytes.

Word hashes are 64 bits of a polynomial over random byte values, followed by a mixing step. All
arithmetic is modulo 2**64, so numpy's wrapping unsigned integers are what is meant. Such polynomials of some
long words agree whatever the base, so words of more than ``LONG`` values have a BLAKE2 digest instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

BATCH_BYTES = 1 << 20
BLANK = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
BASE = 0x9E3779B97F4A7C15
LONG = 64


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread all input bits over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def member_table(members: bytes) -> np.ndarray:
    """Which of the 256 byte values are among ``members``."""
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(members, dtype=np.uint8)] = True
    return table


def lower_table() -> np.ndarray:
    """A to Z become a to z; every other byte stays."""
    return np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)


class Rolling:
    """Hashes of any stretch of a sequence, from running sums of values times powers of a base."""

    def __init__(self) -> None:
        self.bytes = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def sums(self, values: np.ndarray) -> np.ndarray:
        n = len(values) + 1
        if n > len(self.up):
            size = 1 << int(n - 1).bit_length()
            self.up = np.full(size, BASE, dtype=np.uint64)
            self.down = np.full(size, pow(BASE, -1, 1 << 64), dtype=np.uint64)
            self.up[0] = self.down[0] = 1
            np.multiply.accumulate(self.up, out=self.up)
            np.multiply.accumulate(self.down, out=self.down)
        out = np.zeros(n, dtype=np.uint64)
        np.cumsum(values * self.up[: n - 1], out=out[1:])
        return out

    def stretches(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (sums[ends] - sums[starts]) * self.down[starts]
        return mixed(raw ^ ((ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))

    def words(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of stretches of the values, of any length."""
        hashes = self.stretches(self.sums(values), starts, ends)
        for at in np.flatnonzero(ends - starts > LONG):
            digest = blake2b(values[starts[at] : ends[at]].tobytes(), digest_size=8).digest()
            hashes[at] = np.uint64(int.from_bytes(digest, "little"))
        return hashes


def text_batches(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of at most ``limit`` bytes of text, or one row: rows, bytes, and where each text begins.

    A null text counts as empty; the last number is the length of the buffer.
    """
    for batch in batches:
        text = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()).fill_null("")
        if not len(text):
            continue
        ends = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
        held = text.buffers()[2]
        whole = np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, np.uint8)
        first = 0
        while first < len(text):
            last = int(np.searchsorted(ends, ends[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), len(text))
            part = ends[first : last + 1]
            yield batch.slice(first, last - first), whole[part[0] : part[-1]], part - part[0]
            first = last


def runs(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of bytes that ``inside`` names, and the row it belongs to.

    A run ends where its text ends, although the next text may go on with such bytes.
    """
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    here = inside[data]
    edges = np.empty(len(data) + 1, dtype=bool)
    edges[0], edges[-1] = here[0], here[-1]
    np.not_equal(here[1:], here[:-1], out=edges[1:-1])
    cuts = bounds[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    joined = cuts[here[cuts] & here[cuts - 1]]
    at = np.flatnonzero(edges)
    if len(joined):
        at = np.sort(np.concatenate([at, joined, joined]))
    starts, ends = at[0::2], at[1::2]
    return starts, ends, np.searchsorted(bounds, starts, side="right") - 1
