"""Following by manifests: the offset is a number, a restart neither loses nor repeats lines."""

from __future__ import annotations

import json
import random

import pytest

from fleetlens.sources.follow_log import LoggedTextReader, Seen, SizeLog, fair_shares, follow_many, new_ranges, next_seen
from fleetlens.sources.ranges import lines_between, lines_ending_between


def reader(folder, log, **options):
    return LoggedTextReader({"path": str(folder), "log": str(log), **options})


def read(at, start, end):
    return [row for task in at.partitions(start, end) for row in at.read(task)]


def run(spark, df, folder):
    writer = df.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    writer.format("parquet").start(f"{folder}/rows").awaitTermination(90)


def test_stream_restarts_without_loss_or_repeat(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    written = []
    for step in range(4):
        # A new frame each time, as after a restart of the application.
        for name in ("a", "b", f"new{step}"):
            with open(logs / f"{name}.log", "ab") as log:
                texts = [f"{name} {step} {i}" for i in range(5)]
                log.write("".join(f"{t}\n" for t in texts).encode() + b"cut")
                written += [texts[0] if step == 0 or name[0] == "n" else f"cut{texts[0]}", *texts[1:]]
        run(spark, follow_many(spark, str(logs), str(tmp_path / "log")), tmp_path / "out")
    run(spark, follow_many(spark, str(logs), str(tmp_path / "log")), tmp_path / "out")
    got = [r["value"] for r in spark.read.parquet(str(tmp_path / "out/rows")).collect()]
    assert sorted(got) == sorted(written)
    offsets = [p.read_text().splitlines()[-1] for p in (tmp_path / "out/checkpoint/offsets").iterdir() if p.name[0] != "."]
    assert {json.dumps(json.loads(o)) for o in offsets} == {f'{{"manifest": {n}}}' for n in (1, 2, 3, 4)}
    assert len(SizeLog(str(tmp_path / "log")).numbers()) <= 2


def test_from_the_end(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a").write_text("old\n")
    stream = follow_many(spark, str(logs), str(tmp_path / "log"), from_start=False)
    run(spark, stream, tmp_path / "out")
    with open(logs / "a", "a") as log:
        log.write("new\n")
    run(spark, stream, tmp_path / "out")
    assert [r["value"] for r in spark.read.parquet(str(tmp_path / "out/rows")).collect()] == ["new"]


def test_a_replayed_batch_reads_the_same(tmp_path):
    logs, log = tmp_path / "logs", tmp_path / "log"
    logs.mkdir()
    (logs / "a").write_bytes(b"one\ntwo\n")
    first = reader(logs, log)
    start = first.initialOffset()
    end = first.latestOffset()
    (logs / "a").write_bytes(b"one\ntwo\nthree\n")
    again = reader(logs, log)  # the batch was planned, then the driver was lost
    assert [r[4] for r in read(again, start, end)] == ["one", "two"]
    later = again.latestOffset()
    assert [r[4] for r in read(again, end, later)] == ["three"]
    again.commit(later)
    assert SizeLog(str(log)).numbers() == [later["manifest"]]
    with pytest.raises(ValueError, match="lacks manifest 1"):
        again.partitions(end, later)


def test_unfinished_manifests_do_not_count(tmp_path):
    logs, log = tmp_path / "logs", tmp_path / "log"
    logs.mkdir()
    log.mkdir()
    (log / "_7-unfinished").write_bytes(b"half")
    at = reader(logs, log)
    assert at.initialOffset() == at.latestOffset() == {"manifest": 0}
    assert at.partitions({"manifest": 0}, {"manifest": 0}) == []


def test_cut_off_and_deleted_files(tmp_path):
    logs, log = tmp_path / "logs", tmp_path / "log"
    logs.mkdir()
    (logs / "a").write_bytes(b"one\ntwo\n")
    (logs / "b").write_bytes(b"gone\n")
    at = reader(logs, log)
    start = at.latestOffset()
    (logs / "a").write_bytes(b"new\n")
    (logs / "b").unlink()
    end = at.latestOffset()
    assert [(r[2], r[4]) for r in read(at, start, end)] == [(0, "new")]
    assert set(SizeLog(str(log)).read(end["manifest"])) == {"a"}
    (logs / "b").write_bytes(b"back again\n")
    last = at.latestOffset()
    assert [r[4] for r in read(at, end, last)] == ["back again"]
    (logs / "b").unlink()
    assert read(at, end, last) == []


def test_shares_are_bounded_and_fair():
    assert fair_shares({"a": 10**9, "b": 5, "c": 7}, 100) == {"b": 5, "c": 7, "a": 88}
    assert fair_shares({"a": 9, "b": 9}, 0) == {"a": 9, "b": 9}
    rng = random.Random(3)
    for _ in range(200):
        growth = {str(i): rng.randint(1, 50) for i in range(rng.randint(1, 20))}
        most = rng.randint(1, 400)
        shares = fair_shares(growth, most)
        assert sum(shares.values()) == min(most, sum(growth.values()))
        assert all(0 <= shares[name] <= growth[name] for name in growth)
        cut = [shares[name] for name in growth if shares[name] < growth[name]]
        assert not cut or max(cut) - min(cut) <= 1


def test_bounded_batches_come_to_the_end(tmp_path):
    logs, log = tmp_path / "logs", tmp_path / "log"
    logs.mkdir()
    wanted = []
    for name in "abc":
        texts = [f"{name}{i}" * (i % 5) for i in range(40)]
        (logs / name).write_text("".join(t + "\n" for t in texts))
        wanted += texts
    got, at, start = [], reader(logs, log, max_bytes="100", piece_bytes="30"), {"manifest": 0}
    while (end := at.latestOffset()) != start:
        seen = [SizeLog(str(log)).read(o["manifest"]) for o in (start, end)]
        assert sum(s.end for s in seen[1].values()) - sum(s.end for s in seen[0].values()) <= 100
        got += [r[4] for r in read(at, start, end)]
        at.commit(start)
        at, start = reader(logs, log, max_bytes="100", piece_bytes="30"), end
    assert sorted(got) == sorted(wanted)


def test_a_hundred_thousand_files(tmp_path, monkeypatch):
    sizes = {f"{i:06d}.log": 1000 + i % 7 for i in range(100_000)}
    at = reader(tmp_path, tmp_path / "log")
    monkeypatch.setattr(at, "_sizes", lambda: sizes)
    first = at.latestOffset()
    assert len(json.dumps(first)) < 100
    tasks = at.partitions({"manifest": 0}, first)
    assert len(tasks) == 100 and sum(len(t.ranges) for t in tasks) == 100_000
    sizes["000500.log"] += 10
    second = at.latestOffset()
    assert [t.ranges for t in at.partitions(first, second)] == [[("000500.log", 1003, 1013)]]
    assert at.latestOffset() == second


def test_ranges_of_a_new_life_begin_at_the_start():
    known = {"a": Seen(50, 0), "b": Seen(5, 2)}
    after = next_seen(known, {"a": 20, "b": 9, "c": 0}, 0)
    assert after == {"a": Seen(20, 1), "b": Seen(9, 2), "c": Seen(0, 0)}
    assert list(new_ranges(known, after, 15)) == [("a", 0, 15), ("a", 15, 20), ("b", 5, 9)]


def test_lines_over_many_chunks(tmp_path, monkeypatch):
    monkeypatch.setattr("fleetlens.sources.ranges.CHUNK", 7)
    rng = random.Random(11)
    for case in range(60):
        lines = [b"x" * rng.choice([0, 1, 6, 7, 8, 40]) for _ in range(rng.randint(0, 8))]
        data = b"\n".join(lines) + rng.choice([b"", b"\n"])
        path = tmp_path / str(case)
        path.write_bytes(data)
        cut = rng.randint(0, len(data))
        starts, at = [], 0
        for line in data.split(b"\n"):
            starts.append((at, line))
            at += len(line) + 1
        whole = starts if starts[-1][1] else starts[:-1]
        assert [*lines_between(str(path), 0, cut), *lines_between(str(path), cut, len(data))] == whole
        ended = [*lines_ending_between(str(path), 0, cut), *lines_ending_between(str(path), cut, len(data))]
        assert ended == starts[:-1]
