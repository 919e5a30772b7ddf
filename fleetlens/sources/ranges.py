"""Byte ranges of files, read by tasks through the file system the path names.

Spark's text source reads whole files. Following a growing file, tailing it, and hashing the files
of a candidate list read only some bytes, so tasks open those files themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow.fs as pafs

CHUNK = 4 * 1024 * 1024
TAIL_CHUNK = 64 * 1024


def open_file(path: str):
    """A random-access file for a path or URI, as Spark writes it."""
    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        return pafs.LocalFileSystem().open_input_file(unquote(parsed.path) if parsed.scheme else path)
    filesystem, inner = pafs.FileSystem.from_uri(path)
    return filesystem.open_input_file(inner)


def create_file(path: str):
    """A file to write at a path or URI; its folder is made where the file system has folders."""
    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        filesystem, inner = pafs.LocalFileSystem(), unquote(parsed.path) if parsed.scheme else path
    else:
        filesystem, inner = pafs.FileSystem.from_uri(path)
    filesystem.create_dir(inner.rpartition("/")[0])
    return filesystem.open_output_stream(inner)


def move_file(path: str, target: str) -> None:
    """Give a whole file its final name; what had that name is replaced."""
    parsed, wanted = urlparse(path), urlparse(target)
    if parsed.scheme in ("", "file"):
        filesystem, inner = pafs.LocalFileSystem(), unquote(parsed.path) if parsed.scheme else path
        final = unquote(wanted.path) if wanted.scheme else target
    else:
        filesystem, inner = pafs.FileSystem.from_uri(path)
        final = pafs.FileSystem.from_uri(target)[1]
    filesystem.create_dir(final.rpartition("/")[0])
    filesystem.move(inner, final)


def _next_line_start(source, position: int, size: int) -> int:
    """The first line start at or after ``position``."""
    if position <= 0:
        return 0
    at = position - 1
    while at < size:
        chunk = source.read_at(min(CHUNK, size - at), at)
        found = chunk.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(chunk)
    return size


class _Lines:
    """Puts lines together from chunks; the chunks of a long line are joined once, at its end."""

    def __init__(self) -> None:
        self.open: list[bytes] = []

    def closed_by(self, chunk: bytes) -> list[bytes]:
        """The lines that end in ``chunk``, without newline."""
        pieces = chunk.split(b"\n")
        if len(pieces) > 1:
            pieces[0] = b"".join([*self.open, pieces[0]])
            self.open.clear()
        self.open.append(pieces.pop())
        return pieces

    def rest(self) -> bytes:
        return b"".join(self.open)


def lines_between(path: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """``(offset, line)`` of the lines that start in ``[start, end)``; a line may reach past ``end``."""
    with open_file(path) as source:
        size = source.size()
        position = _next_line_start(source, start, size)
        lines = _Lines()
        at = position
        while position < end and at < size:
            chunk = source.read_at(min(CHUNK, size - at), at)
            at += len(chunk)
            for piece in lines.closed_by(chunk):
                if position >= end:
                    return
                yield position, piece
                position += len(piece) + 1
        rest = lines.rest()
        if rest and position < end:
            yield position, rest


def _line_start(source, position: int) -> int:
    """Where the line that ``position`` lies in begins."""
    at = position
    while at > 0:
        begin = max(0, at - TAIL_CHUNK)
        found = source.read_at(at - begin, begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        at = begin
    return 0


def lines_ending_between(path: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """``(offset, line)`` of the lines whose newline lies in ``[start, end)``; a line may begin before."""
    with open_file(path) as source:
        position = at = _line_start(source, start)
        lines = _Lines()
        while at < end:
            chunk = source.read_at(min(CHUNK, end - at), at)
            if not chunk:
                return  # cut off since it was listed
            at += len(chunk)
            for piece in lines.closed_by(chunk):
                yield position, piece
                position += len(piece) + 1


def last_lines_start(path: str, n: int) -> int:
    """Where the last ``n`` lines of a file begin, found from its end."""
    with open_file(path) as source:
        at = end = source.size()
        left = n
        while at > 0:
            begin = max(0, at - TAIL_CHUNK)
            chunk = source.read_at(at - begin, begin)
            found = len(chunk)
            while True:
                found = chunk.rfind(b"\n", 0, found)
                if found < 0:
                    break
                if begin + found + 1 == end:
                    continue  # the last line's own end
                left -= 1
                if left == 0:
                    return begin + found + 1
            at = begin
    return 0


def md5_of(path: str) -> str:
    digest = hashlib.md5(usedforsecurity=False)
    with open_file(path) as source:
        size, at = source.size(), 0
        while at < size:
            chunk = source.read_at(min(CHUNK, size - at), at)
            digest.update(chunk)
            at += len(chunk)
    return digest.hexdigest()
