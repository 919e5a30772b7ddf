"""Following many growing files for a long time: the offset of the stream is a number.

What was seen of each file lies in a manifest in a shared folder, one for each offset. A manifest is
written whole under another name and then renamed, so a reader finds it complete or not at all.
Those before the last finished micro-batch are deleted.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple
from uuid import uuid4

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from fleetlens.sources.ranges import lines_ending_between

FORMAT = "logged_text"
PIECE = 64 * 1024 * 1024
RANGES_AT_ONCE = 1000  # a task opens no more files than that


class Seen(NamedTuple):
    """How far a file was read, and how often it was cut off and written anew."""

    end: int
    life: int


def located(folder: str) -> tuple[pafs.FileSystem, str]:
    if "://" in folder:
        return pafs.FileSystem.from_uri(folder)
    return pafs.LocalFileSystem(), folder.removeprefix("file:")


class SizeLog:
    """Numbered manifests in a folder. Number 0 needs no file: nothing was seen."""

    def __init__(self, folder: str):
        self.filesystem, inner = located(folder)
        self.inner = inner.rstrip("/")

    def _path(self, number: int) -> str:
        return f"{self.inner}/{number:019d}.parquet"

    def numbers(self) -> list[int]:
        listed = self.filesystem.get_file_info(pafs.FileSelector(self.inner, allow_not_found=True))
        return sorted(int(i.base_name.removesuffix(".parquet")) for i in listed if i.base_name[0] not in "._")

    def read(self, number: int) -> dict[str, Seen]:
        if number == 0:
            return {}
        try:
            rows = pq.read_table(self._path(number), filesystem=self.filesystem)
        except FileNotFoundError as missing:
            raise ValueError(f"{self.inner} lacks manifest {number}, which the checkpoint of the query names") from missing
        columns = (rows[name].to_pylist() for name in ("name", "end", "life"))
        return {name: Seen(end, life) for name, end, life in zip(*columns)}

    def write(self, number: int, files: dict[str, Seen]) -> None:
        columns = {
            "name": pa.array(files, pa.string()),
            "end": pa.array([seen.end for seen in files.values()], pa.int64()),
            "life": pa.array([seen.life for seen in files.values()], pa.int64()),
        }
        self.filesystem.create_dir(self.inner)
        unfinished = f"{self.inner}/_{number}-{uuid4().hex}"
        pq.write_table(pa.table(columns), unfinished, filesystem=self.filesystem)
        self.filesystem.move(unfinished, self._path(number))

    def drop_before(self, number: int) -> None:
        for old in self.numbers():
            if old < number:
                self.filesystem.delete_file(self._path(old))


def fair_shares(growth: dict[str, int], most: int) -> dict[str, int]:
    """Bytes to read of each file, ``most`` in all: small growth whole, large growth in equal parts.

    So a file that grows without end does not keep the others waiting. 0 sets no bound.
    """
    if not most:
        return growth
    shares, left = {}, most
    waiting = sorted(growth.items(), key=lambda item: (item[1], item[0]))
    for place, (name, more) in enumerate(waiting):
        shares[name] = min(more, -(-left // (len(waiting) - place)))
        left -= shares[name]
    return shares


def next_seen(known: dict[str, Seen], sizes: dict[str, int], most: int) -> dict[str, Seen]:
    """What will have been seen of the files there are now, at most ``most`` bytes more.

    A file shorter than what was seen of it was cut off, and is read from its start. A file that is
    gone is forgotten; one that comes under its name later is new.
    """
    begin = {}
    for name, size in sizes.items():
        seen = known.get(name, Seen(0, 0))
        begin[name] = seen if size >= seen.end else Seen(0, seen.life + 1)
    growth = {name: size - begin[name].end for name, size in sizes.items() if size > begin[name].end}
    shares = fair_shares(growth, most)
    return {name: Seen(seen.end + shares.get(name, 0), seen.life) for name, seen in begin.items()}


def new_ranges(before: dict[str, Seen], after: dict[str, Seen], piece: int) -> Iterator[tuple[str, int, int]]:
    """``(name, start, end)`` of what was seen in between, in stretches of at most ``piece`` bytes."""
    for name in sorted(after):
        seen, then = after[name], before.get(name)
        position = then.end if then and then.life == seen.life else 0
        while position < seen.end:
            stop = min(position + piece, seen.end)
            yield name, position, stop
            position = stop


class Ranges(InputPartition):
    """Stretches of one or more files that one task reads."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


def packed(ranges: Iterable[tuple[str, int, int]], piece: int) -> list[Ranges]:
    """Tasks of about ``piece`` bytes each; a task takes many small files."""
    tasks, some, held = [], [], 0
    for name, start, end in ranges:
        if some and (held + end - start > piece or len(some) == RANGES_AT_ONCE):
            tasks.append(Ranges(some))
            some, held = [], 0
        some.append((name, start, end))
        held += end - start
    return [*tasks, Ranges(some)] if some else tasks


class LoggedTextReader(DataSourceStreamReader):
    """Lists sizes and opens no file; a micro-batch is what two manifests differ in."""

    def __init__(self, options: dict[str, str]):
        self.folder = options["path"].rstrip("/")
        self.log = SizeLog(options["log"])
        self.from_start = options.get("from_start", "true").lower() == "true"
        self.piece = int(options.get("piece_bytes", PIECE))
        self.most = int(options.get("max_bytes", 0))
        self._newest: tuple[int, dict[str, Seen]] | None = None

    def _sizes(self) -> dict[str, int]:
        filesystem, inner = located(self.folder)
        listed = filesystem.get_file_info(pafs.FileSelector(inner))
        # As for Spark's own readers, a dot or an underscore marks what is no data.
        return {i.base_name: i.size for i in listed if i.is_file and i.base_name[0] not in "._"}

    def _last(self) -> tuple[int, dict[str, Seen]]:
        if self._newest is None:
            number = max(self.log.numbers(), default=0)
            self._newest = number, self.log.read(number)
        return self._newest

    def _add(self, number: int, files: dict[str, Seen]) -> dict:
        self.log.write(number, files)
        self._newest = number, files
        return {"manifest": number}

    def initialOffset(self) -> dict:
        if self.from_start:
            return {"manifest": 0}
        number, known = self._last()
        # An earlier start may have ended between this manifest and the query's own note of it.
        return {"manifest": number} if number else self._add(1, next_seen(known, self._sizes(), 0))

    def latestOffset(self) -> dict:
        number, known = self._last()
        files = next_seen(known, self._sizes(), self.most)
        if all(seen == known.get(name, Seen(0, 0)) for name, seen in files.items()):
            return {"manifest": number}
        return self._add(number + 1, files)

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        before, after = self.log.read(start["manifest"]), self.log.read(end["manifest"])
        return packed(new_ranges(before, after, self.piece), self.piece)

    def read(self, partition: Ranges) -> Iterator[tuple]:
        for name, start, end in partition.ranges:
            path = f"{self.folder}/{name}"
            try:
                for offset, line in lines_ending_between(path, start, end):
                    text = line.decode("utf-8", "replace").rstrip("\r\n")
                    yield path, start, offset, len(line) + 1, text
            except FileNotFoundError:
                continue  # deleted since it was listed

    def commit(self, end: dict) -> None:
        self.log.drop_before(end["manifest"])


class LoggedText(DataSource):
    """``spark.readStream.format("logged_text")``: appended lines of all files in a folder.

    Only complete lines are emitted, each by the task that reads its newline; ``seq`` is the byte
    offset of a line. Options: ``path``; ``log``, a folder that the driver can write at every start,
    for this query alone and kept as long as its checkpoint; ``from_start`` (``false`` skips what is
    there already); ``piece_bytes``, read by a task; and ``max_bytes``, which bounds a micro-batch
    where the query goes on. A query that ends with its input reads one bound.

    Empty files and a folder without files give no rows. A last line without newline waits for it.
    A file deleted before it was read gives none of its lines.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file_path string, block_start bigint, seq bigint, n_bytes bigint, value string"

    def streamReader(self, schema) -> LoggedTextReader:
        return LoggedTextReader(self.options)


def follow_many(spark, folder: str, log: str, from_start: bool = True, **options: str):
    """Register the source and open a stream on ``folder``, its manifests below ``log``."""
    spark.dataSource.register(LoggedText)
    reader = spark.readStream.format(FORMAT).option("log", log).option("from_start", str(from_start).lower())
    return reader.options(**options).load(folder)
