"""Width and height of image files from their headers."""

from __future__ import annotations

import struct
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from fleetlens.session import task_count
from fleetlens.sources.ranges import open_file

HEAD = 64  # bytes read first; those of all formats but JPEG hold the size
SEGMENTS = 500  # JPEG segments looked at before the size
SIZE_SCHEMA = StructType([StructField("width", IntegerType()), StructField("height", IntegerType())])

Reader = Callable[[int, int], bytes]  # bytes of a length at an offset
Size = tuple[int, int]


def _png(head: bytes, read: Reader) -> Size | None:
    return struct.unpack(">II", head[16:24]) if head[12:16] == b"IHDR" else None


def _gif(head: bytes, read: Reader) -> Size | None:
    return struct.unpack("<HH", head[6:10])


def _bmp(head: bytes, read: Reader) -> Size | None:
    (kind,) = struct.unpack("<I", head[14:18])
    if kind == 12:
        return struct.unpack("<HH", head[18:22])
    width, height = struct.unpack("<ii", head[18:26])
    return width, abs(height)  # rows may run from the top, which is a negative height


def _webp(head: bytes, read: Reader) -> Size | None:
    kind = head[12:16]
    if kind == b"VP8X":
        return 1 + int.from_bytes(head[24:27], "little"), 1 + int.from_bytes(head[27:30], "little")
    if kind == b"VP8L" and head[20] == 0x2F:
        bits = int.from_bytes(head[21:25], "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    if kind == b"VP8 " and head[23:26] == b"\x9d\x01\x2a":
        width, height = struct.unpack("<HH", head[26:30])
        return width & 0x3FFF, height & 0x3FFF
    return None


def _jpeg(head: bytes, read: Reader) -> Size | None:
    """Go from segment to segment, reading ten bytes of each, up to the frame header."""
    at = 2
    for _ in range(SEGMENTS):
        segment = read(10, at)
        if len(segment) < 4 or segment[0] != 0xFF:
            return None
        kind = segment[1]
        if kind == 0xFF:  # filling before a marker
            at += 1
        elif kind in (0x01, *range(0xD0, 0xD9)):  # markers without a length
            at += 2
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", segment[5:9])
            return width, height
        elif kind in (0xD9, 0xDA):  # the end, or image data, without a frame before
            return None
        else:
            at += 2 + struct.unpack(">H", segment[2:4])[0]
    return None


# The first bytes of a format.
FORMATS: tuple[tuple[bytes, Callable[[bytes, Reader], Size | None]], ...] = (
    (b"\x89PNG\r\n\x1a\n", _png),
    (b"\xff\xd8\xff", _jpeg),
    (b"GIF87a", _gif),
    (b"GIF89a", _gif),
    (b"BM", _bmp),
    (b"RIFF", _webp),
)


def image_size(read: Reader) -> Size | None:
    """Width and height from the header, or nothing where the file is no image of a known format or is cut off."""
    head = read(HEAD, 0)
    for start, parse in FORMATS:
        if head.startswith(start):
            if parse is _webp and head[8:12] != b"WEBP":
                return None
            try:
                size = parse(head, read)
            except (struct.error, IndexError):
                return None
            return size if size and min(size) > 0 else None
    return None


def file_image_size(path: str) -> Size | None:
    with open_file(path) as source:
        length = source.size()
        return image_size(lambda n, at: source.read_at(min(n, length - at), at) if at < length else b"")


@F.pandas_udf(SIZE_SCHEMA)
def _sizes(paths: pd.Series) -> pd.DataFrame:
    found = [file_image_size(p) or (None, None) for p in paths]
    return pd.DataFrame(found, columns=["width", "height"]).astype("Int32")


def with_image_sizes(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """Add ``image`` (width, height) to files with a ``path``; both null where the file is no image.

    At most ``HEAD`` bytes and ten for each JPEG segment are read of a file, whatever its size.
    """
    spread = files.repartition(tasks or task_count(files.sparkSession), "path")
    return spread.withColumn("image", _sizes("path"))


def list_images(spark: SparkSession, path: str) -> DataFrame:
    """The files in a folder as encoded URIs, by Spark's own listing, without their content."""
    return spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"))
