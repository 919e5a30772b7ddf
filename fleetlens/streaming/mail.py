"""Mail sessions as a stream: the client address of a message id, kept as keyed state."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from fleetlens.operators.mail import UNKNOWN_ADDRESS

DAY_MS = 24 * 3600 * 1000
HELD_ROWS = 20_000
_ORDER = ["file_path", "block_start", "seq"]


class Starts:
    """Places of one id's ``msg_start`` rows in a micro-batch and their addresses: some 40 bytes a row."""

    def __init__(self) -> None:
        self.places: list[np.ndarray] = []
        self.codes: list[np.ndarray] = []
        self.files: dict[str, int] = {}
        self.addresses: dict[str, int] = {}

    def add(self, rows: pd.DataFrame) -> None:
        starts = rows[(rows["kind"] == "msg_start") & rows["ipaddr"].notna()]
        file = [self.files.setdefault(f, len(self.files)) for f in starts["file_path"]]
        numbers = starts[_ORDER[1:]].to_numpy(dtype=np.int64)
        self.places.append(np.column_stack([np.array(file, dtype=np.int64), numbers]))
        self.codes.append(np.array([self.addresses.setdefault(a, len(self.addresses)) for a in starts["ipaddr"]], dtype=np.int64))

    def sort(self) -> None:
        """Order the places; file numbers follow the order of the names from here on."""
        names = sorted(self.files)
        rank = np.empty(len(names), dtype=np.int64)
        for i, name in enumerate(names):
            rank[self.files[name]] = i
        self.names = np.array(names, dtype=object)
        places = np.concatenate(self.places)
        places[:, 0] = rank[places[:, 0]] if len(places) else places[:, 0]
        order = np.lexsort(places.T[::-1])
        self.codes = [np.concatenate(self.codes)[order]]
        fields = [("file", np.int64), ("block", np.int64), ("seq", np.int64)]
        self.places = [np.array([tuple(p) for p in places[order].tolist()], dtype=fields)]
        self.texts = np.array([*self.addresses, None], dtype=object)

    def addresses_of(self, rows: pd.DataFrame, known: str) -> np.ndarray:
        """The address of the latest start up to each row, or what was known before."""
        # A file without starts lies between those with some.
        at = np.searchsorted(self.names, rows["file_path"].to_numpy(dtype=object)) if len(self.names) else np.zeros(len(rows), int)
        inside = np.minimum(at, max(len(self.names) - 1, 0))
        same = self.names[inside] == rows["file_path"].to_numpy(dtype=object) if len(self.names) else np.zeros(len(rows), bool)
        wanted = np.empty(len(rows), dtype=self.places[0].dtype)
        wanted["file"] = np.where(same, at, at - 1)
        last = np.iinfo(np.int64).max
        wanted["block"] = np.where(same, rows["block_start"].to_numpy(dtype=np.int64), last)
        wanted["seq"] = np.where(same, rows["seq"].to_numpy(dtype=np.int64), last)
        place = np.searchsorted(self.places[0], wanted, side="right") - 1
        codes = self.codes[0][np.maximum(place, 0)] if len(self.codes[0]) else np.full(len(rows), -1)
        return np.where(place >= 0, self.texts[codes], known)

    def latest(self) -> str | None:
        return self.texts[self.codes[0][-1]] if len(self.codes[0]) else None


class Sessions(StatefulProcessor):
    """Give rows of a message id the address of its latest ``msg_start`` row, over all micro-batches.

    Rows of a key arrive in no order. Up to ``held_rows`` of them are ordered at once. Of more, the
    ``msg_start`` rows leave their place and address here and all rows wait, batch by batch, in a map state on disk
    until the last one was seen; then they pass again, one batch at a time. So no task holds a key's rows.
    """

    def __init__(self, ttl_ms: int, held_rows: int) -> None:
        self.ttl_ms, self.held_rows = ttl_ms, held_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.client = handle.getValueState("client", "ipaddr string", self.ttl_ms or None)
        self.waiting = handle.getMapState("waiting", "place int", "rows binary")

    def handleInputRows(
        self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues
    ) -> Iterator[pd.DataFrame]:
        known = self.client.get()[0] if self.client.exists() else UNKNOWN_ADDRESS
        starts, held, n, waiting = Starts(), [], 0, 0
        for chunk in rows:
            starts.add(chunk)
            held.append(chunk)
            n += len(chunk)
            if n > self.held_rows:
                waiting = self._wait(held, waiting)
                held, n = [], 0
        if waiting and held:
            waiting, held = self._wait(held, waiting), []
        starts.sort()
        for chunk in held:
            yield chunk.assign(ipaddr=starts.addresses_of(chunk, known))
        for place in range(waiting):
            (packed,) = self.waiting.getValue((place,))
            self.waiting.removeKey((place,))
            with pa.ipc.open_stream(packed) as stream:
                for batch in stream:
                    chunk = batch.to_pandas()
                    yield chunk.assign(ipaddr=starts.addresses_of(chunk, known))
        latest = starts.latest()
        if latest is not None or (self.ttl_ms and known != UNKNOWN_ADDRESS):  # rows of an id keep its state alive
            self.client.update((latest if latest is not None else known,))

    def _wait(self, held: list[pd.DataFrame], place: int) -> int:
        table = pa.Table.from_pandas(pd.concat(held, ignore_index=True), preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table)
        self.waiting.updateValue((place,), (sink.getvalue().to_pybytes(),))
        return place + 1

    def close(self) -> None:
        pass


def stream_enrich(
    records: DataFrame, ttl_ms: int = DAY_MS, scope: Sequence[str] = (), held_rows: int = HELD_ROWS
) -> DataFrame:
    """Streaming form of ``enrich_msgid`` over classified mail records.

    ``scope`` narrows the state, as in the batch form. The state of an id is dropped ``ttl_ms`` after its
    last row; with ``0`` it is kept forever. Rows without a message id bypass the state. The rows of
    one id in a micro-batch pass through one task, which holds ``held_rows`` of them at most, and 40 bytes for each that
    starts a message; see :class:`Sessions`.

    Start the query inside ``state_on_disk``, which the state needs, and, with a time limit, ``only_with_data``.
    """
    with_id = records.where(F.col("msgid") != "")
    enriched = with_id.groupBy(*scope, "msgid").transformWithStateInPandas(
        Sessions(ttl_ms, held_rows),
        outputStructType=records.schema,
        outputMode="append",
        timeMode="processingTime" if ttl_ms else "none",
    )
    return enriched.unionByName(records.where(F.col("msgid") == ""))
