"""Listing of file trees with hidden names: names by folder first, then sizes by file."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence
from itertools import islice
from uuid import uuid4

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.session import shared_folder, task_count

# Folders that hold copies by design.
VERSION_CONTROL = (".git", ".svn")

ROWS_AT_ONCE = 10_000  # a folder may hold any number of files
_COLUMNS = ["root", "subpath", "size", "seconds", "is_dir"]
_SCHEMA = "root string, subpath string, size bigint, seconds bigint, is_dir boolean"


def _entries(folder: str) -> Iterator[tuple[str, int | None, int | None, bool]]:
    """``(name, size, seconds, is_dir)`` of the directories and files in a folder, links left out.

    Where a listing holds names only, size and time are null.
    """
    if "://" not in folder:
        for entry in os.scandir(folder.removeprefix("file:")):
            is_dir = entry.is_dir(follow_symlinks=False)
            if is_dir or entry.is_file(follow_symlinks=False):
                yield entry.name, None, None, is_dir
        return
    filesystem, inner = pafs.FileSystem.from_uri(folder)
    for info in filesystem.get_file_info(pafs.FileSelector(inner)):
        seconds = int(info.mtime.timestamp()) if info.mtime else 0
        yield info.base_name, info.size or 0, seconds, info.type == pafs.FileType.Directory


def _below(root: str, folder: str, budget: int) -> Iterator[tuple]:
    """Files in and below a folder, until ``budget`` entries were met; then folders, for other tasks."""
    own = [folder]
    while own:
        subpath = own.pop()
        if budget <= 0:
            yield root, subpath, None, None, True
            continue
        for name, size, seconds, is_dir in _entries(f"{root}/{subpath}" if subpath else root):
            budget -= 1
            path = f"{subpath}/{name}" if subpath else name
            if not is_dir:
                yield root, path, size, seconds, False
            elif name not in VERSION_CONTROL:
                if budget > 0:
                    own.append(path)
                else:
                    yield root, path, None, None, True


def _in_frames(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    while some := list(islice(rows, ROWS_AT_ONCE)):
        frame = pd.DataFrame(some, columns=_COLUMNS)
        yield frame.astype({"size": "Int64", "seconds": "Int64"})


def _list_folders(budget: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for root, subpath in zip(batch["root"], batch["subpath"]):
                yield from _in_frames(_below(root, subpath, budget))

    return listed


def _look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Size and time of files listed by name; a file deleted since then is left out."""

    def rows(batch: pd.DataFrame) -> Iterator[tuple]:
        for root, subpath in zip(batch["root"], batch["subpath"]):
            try:
                status = os.lstat(f"{root}/{subpath}".removeprefix("file:"))
            except FileNotFoundError:
                continue
            yield root, subpath, status.st_size, int(status.st_mtime), False

    for batch in batches:
        yield from _in_frames(rows(batch))


def walk_files(spark: SparkSession, roots: Sequence[str], budget: int = ROWS_AT_ONCE) -> DataFrame:
    """``(root, subpath, size, mtime, path)`` of all files below the roots, hidden ones too.

    Empty files, links, and version-control folders are left out. A task goes down from a folder
    until it has met ``budget`` entries and leaves the folders it did not open to the next job, which
    spreads them again. So small trees take one job, however deep, and no task has more than ``budget``
    entries beyond those of the folders it is in. Names are listed first; sizes and times, which
    take a call for each file, are then looked up by all tasks alike, also for the files of one folder.

    What a job found is stored in the shared folder and the next starts from it, so a lost executor
    costs a part of one job.
    """
    folder = f"{shared_folder(spark)}/manifests/{uuid4().hex}"
    names, files = f"{folder}/names", f"{folder}/files"
    pending = spark.createDataFrame([(root.rstrip("/") or "/", "") for root in roots], "root string, subpath string")
    step = 0
    while step == 0 or not pending.isEmpty():
        listed = pending.repartition(task_count(spark), "root", "subpath").mapInPandas(_list_folders(budget), _SCHEMA)
        listed.write.parquet(f"{names}/step={step}")
        pending = spark.read.schema(_SCHEMA).parquet(f"{names}/step={step}").where("is_dir")
        step += 1
    found = spark.read.schema(_SCHEMA).parquet(names).select(*_COLUMNS).where("NOT is_dir")
    by_name = found.where("size IS NULL").repartition(task_count(spark))
    known = by_name.mapInPandas(_look_up, _SCHEMA).unionByName(found.where("size IS NOT NULL"))
    known.where("size > 0").write.parquet(files)
    return spark.read.schema(_SCHEMA).parquet(files).select(
        "root",
        "subpath",
        "size",
        F.timestamp_seconds("seconds").alias("mtime"),
        F.concat_ws("/", "root", "subpath").alias("path"),
    )
