"""Following files that grow: a streaming source with a byte position per file."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from fleetlens.sources.ranges import lines_ending_between

FORMAT = "growing_text"
PIECE = 64 * 1024 * 1024


class ByteRange(InputPartition):
    """Lines of one file whose newline lies in ``[start, end)``."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class GrowingTextReader(DataSourceStreamReader):
    """Offsets map each file to how much of it was seen; the driver lists sizes and opens no file."""

    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.from_start = options.get("from_start", "true").lower() == "true"
        self.piece = int(options.get("piece_bytes", PIECE))
        self.most = int(options.get("max_bytes", 0))

    def _sizes(self) -> dict[str, int]:
        filesystem, inner = pafs.FileSystem.from_uri(self.folder) if "://" in self.folder else (
            pafs.LocalFileSystem(),
            self.folder.removeprefix("file:"),
        )
        listed = filesystem.get_file_info(pafs.FileSelector(inner, recursive=False))
        prefix = self.folder.rstrip("/")
        names = {info.base_name: info.size for info in listed if info.is_file}
        # As for Spark's own readers, a dot or an underscore marks what is no data.
        return {f"{prefix}/{name}": size for name, size in names.items() if name[0] not in "._"}

    def _grown(self, known: dict[str, int], most: int) -> dict[str, int]:
        """Sizes now, but no more than ``most`` bytes beyond those known."""
        ends, left = dict(known), most or float("inf")
        for path, size in sorted(self._sizes().items()):
            seen = known.get(path, 0)
            if size < seen:  # truncated and written anew
                ends[path] = 0
            elif left > 0 and size > seen:
                ends[path] = int(min(size, seen + left))
                left -= ends[path] - seen
        return ends

    def initialOffset(self) -> dict:
        return {} if self.from_start else {"files": json.dumps(self._grown({}, 0))}

    def latestOffset(self) -> dict:
        self._known = self._grown(getattr(self, "_known", {}), self.most)
        return {"files": json.dumps(self._known, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        begin = json.loads(start.get("files", "{}"))
        ranges = []
        for path, stop in json.loads(end.get("files", "{}")).items():
            position = min(begin.get(path, 0), stop)
            while position < stop:
                ranges.append(ByteRange(path, position, min(position + self.piece, stop)))
                position += self.piece
        return ranges

    def read(self, partition: ByteRange) -> Iterator[tuple]:
        for offset, line in lines_ending_between(partition.path, partition.start, partition.end):
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            yield partition.path, partition.start, offset, len(line) + 1, text


class GrowingText(DataSource):
    """``spark.readStream.format("growing_text")``: appended lines of all files in a folder.

    Only complete lines are emitted: a line belongs to the bytes that hold its newline, and the task
    that reads them finds its beginning. ``seq`` is the byte offset of a line. Options: ``path``,
    ``from_start`` (``false`` skips what is there already), ``piece_bytes``, and ``max_bytes``, which
    bounds a micro-batch where the query goes on; a query that ends with its input reads one bound.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file_path string, block_start bigint, seq bigint, n_bytes bigint, value string"

    def streamReader(self, schema) -> GrowingTextReader:
        return GrowingTextReader(self.options)


def follow_lines(spark, folder: str, from_start: bool = True):
    """Register the source and open a stream on ``folder``."""
    spark.dataSource.register(GrowingText)
    return spark.readStream.format(FORMAT).option("from_start", str(from_start).lower()).load(folder)
