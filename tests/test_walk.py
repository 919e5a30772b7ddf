"""Listing of file trees: every file once, whatever the shape of the tree and the budget of a task."""

from __future__ import annotations

import os
import random

import pytest

from fleetlens.sources import walk
from fleetlens.sources.walk import walk_files


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    """A deep chain, a wide folder, a folder of folders, and what is left out."""
    root = tmp_path_factory.mktemp("tree")
    rng = random.Random(2)
    wanted = {}

    def put(path, size):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(b"x" * size)
        os.utime(root / path, (1_600_000_000 + size, 1_600_000_000 + size))
        if size and ".git/" not in path and ".svn/" not in path:
            wanted[path] = size

    for depth in range(12):
        put("/".join(["deep"] * (depth + 1)) + "/f", depth)
    for i in range(300):
        put(f"wide/f{i}", rng.randint(0, 3))
    for i in range(40):
        put(f"folders/d{i}/.hidden/f é", i)
    put(".git/config", 5)
    put("deep/.svn/x", 5)
    (root / "empty").mkdir()
    (root / "link").symlink_to(root / "wide")
    (root / "file link").symlink_to(root / "wide/f1")
    return root, wanted


@pytest.mark.parametrize("budget", [1, 7, 10_000])
def test_every_file_once(spark, tree, budget):
    root, wanted = tree
    rows = walk_files(spark, [str(root)], budget).collect()
    assert len(rows) == len(wanted)
    assert {r["subpath"]: r["size"] for r in rows} == wanted
    assert all(r["mtime"].timestamp() == 1_600_000_000 + r["size"] for r in rows)
    assert all(r["path"] == f"{root}/{r['subpath']}" for r in rows)


def test_no_roots_and_an_empty_root(spark, tmp_path):
    assert walk_files(spark, [str(tmp_path)]).count() == 0
    assert walk_files(spark, []).count() == 0


def test_a_task_leaves_folders_beyond_its_budget(tree):
    root, wanted = tree
    rows = list(walk._below(str(root), "", 20))
    opened = [r for r in rows if not r[4]]
    left = [r[1] for r in rows if r[4]]
    assert left and len(opened) < len(wanted)
    below = [r for folder in left for r in walk._below(str(root), folder, 10**6)]
    names = sorted(r[1] for r in opened + below)
    assert len(names) == len(set(names)) and set(wanted) <= set(names)
    assert list(walk._below(str(root), "", 10**6)) and not any(r[4] for r in walk._below(str(root), "", 10**6))


def test_files_deleted_after_they_were_listed(tree):
    root, wanted = tree
    frame = next(walk._in_frames(iter([(str(root), name, None, None, False) for name in ("wide/gone", "wide/f0")])))
    (found,) = walk._look_up(iter([frame]))
    assert list(found["subpath"]) == ["wide/f0"]


def test_a_wide_folder_is_looked_up_by_many_tasks(spark, tree):
    root, _ = tree
    plan_rows = walk_files(spark, [str(root / "wide")])
    files = {p.rpartition("/")[2] for p in plan_rows.inputFiles()}
    assert len(files) > 1
