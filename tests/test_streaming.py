"""Streams give what the batch operators give."""

from __future__ import annotations

import json
import time
from pathlib import Path
from uuid import uuid4

import pytest
from pyspark.sql import functions as F

from fleetlens.operators.access import apply_filters, label_access, parse_access
from fleetlens.operators.lines import mark_sections, route_lines
from fleetlens.operators.mail import classify_mail, enrich_msgid, parse_syslog
from fleetlens.operators.purify import purified
from fleetlens.plans.pipelines import error_log, mail_log
from fleetlens.sources.follow import GrowingTextReader, follow_lines
from fleetlens.sources.lines import read_lines, stream_lines
from fleetlens.sources.ranges import lines_ending_between
from fleetlens.streaming.access import stream_access
from fleetlens.streaming.mail import stream_enrich
from fleetlens.streaming.options import only_with_data, state_on_disk
from fleetlens.streaming.purify import stream_purify, stream_purify_within
from fleetlens.streaming.reports import error_reports, mail_reports, stream_error, stream_mail
from fleetlens.streaming.sections import section_marker


DATA = Path(__file__).parent / "data"


class Stream:
    """A stream into a folder, run to the end of its input as often as wanted."""

    def __init__(self, spark, df, folder):
        self.spark, self.df, self.folder = spark, df, str(folder)

    def run(self, write=None):
        writer = self.df.writeStream.option("checkpointLocation", f"{self.folder}/checkpoint")
        writer = writer.trigger(availableNow=True)
        with state_on_disk(self.spark), only_with_data(self.spark):
            if write:
                writer.foreachBatch(write).start().awaitTermination(90)
            else:
                writer.format("parquet").start(f"{self.folder}/rows").awaitTermination(90)

    def rows(self):
        return self.spark.read.parquet(f"{self.folder}/rows")


def access_line(i, status=200, day=1):
    return f'192.0.2.{i % 9} - - [0{day}/Mar/2023:00:00:{i % 60:02d} +0000] "GET /{i} HTTP/1.1" {status} {i * 100}'


def test_access(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    stream = Stream(spark, stream_access(stream_lines(spark, str(logs)), ["status=404"]), tmp_path / "out")
    for part in range(3):
        texts = [access_line(i, 404 if i % 3 else 200) for i in range(part * 20, part * 20 + 20)]
        (logs / f"{part}.log").write_text("# head\n" + "\n".join(texts) + "\n")
        stream.run()
    records = parse_access(route_lines(read_lines(spark, str(logs)))[0])[0]
    batch = label_access(apply_filters(records, ["status=404"]))
    columns = ["ip", "req", "size_label", "client"]
    assert sorted(stream.rows().select(columns).collect()) == sorted(batch.select(columns).collect())


def mail_line(second, text):
    return f"Feb  8 15:51:{second:02d} mx1 postfix/smtpd[1]: {text}"


@pytest.mark.parametrize("ttl_ms", [0, 3_600_000])
def test_enrich_over_batches(spark, tmp_path, ttl_ms):
    logs = tmp_path / "logs"
    logs.mkdir()
    parsed = parse_syslog(stream_lines(spark, str(logs), ordered=True), 2023)[0]
    stream = Stream(spark, stream_enrich(classify_mail(parsed), ttl_ms), tmp_path / "out")
    parts = [
        ["AAAAAAAAAA: early", "AAAAAAAAAA: client=h[192.0.2.1]", "AAAAAAAAAA: one", "connect from h[192.0.2.9]"],
        ["AAAAAAAAAA: two", "BBBBBBBBBB: none", "AAAAAAAAAA: client=h[192.0.2.2]", "AAAAAAAAAA: three"],
        ["AAAAAAAAAA: four", "BBBBBBBBBB: client=h[192.0.2.3]"],
    ]
    for number, texts in enumerate(parts):
        (logs / f"{number}.log").write_text("\n".join(mail_line(i, t) for i, t in enumerate(texts)) + "\n")
        stream.run()
    columns = ["msgid", "content", "ipaddr"]
    batch = enrich_msgid(classify_mail(parse_syslog(read_lines(spark, str(logs)), 2023)[0]))
    got = sorted(tuple(r) for r in stream.rows().select(columns).collect())
    assert got == sorted(tuple(r) for r in batch.select(columns).collect())
    assert ("AAAAAAAAAA", "four", "192.0.2.2") in got and ("AAAAAAAAAA", "early", "**UNKNOWN**") in got


def test_rows_of_a_large_id_wait_on_disk(spark, tmp_path, monkeypatch):
    """Many rows of one id in a micro-batch, in any order, as from many files; then equal to the batch form."""
    from fleetlens.streaming import mail

    logs = tmp_path / "logs"
    logs.mkdir()
    for number in range(3):
        texts = []
        for i in range(1500):
            texts.append(f"AAAAAAAAAA: client=h[192.0.2.{i % 250}]" if i % 7 == number else f"AAAAAAAAAA: line {number} {i}")
            texts.append(f"BBBBBBBB{i % 90 + 10}: line {number} {i}")
        (logs / f"{number}.log").write_text("\n".join(mail_line(i % 60, t) for i, t in enumerate(texts)) + "\n")
    parsed = parse_syslog(stream_lines(spark, str(logs), ordered=True), 2023)[0]
    chunks = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")
    try:
        stream = Stream(spark, stream_enrich(classify_mail(parsed), held_rows=300), tmp_path / "out")
        stream.run()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", chunks)
    columns = ["file_path", "msgid", "content", "ipaddr", "pid"]
    batch = enrich_msgid(classify_mail(parse_syslog(read_lines(spark, str(logs)), 2023)[0]))
    got = sorted(tuple(r) for r in stream.rows().select(columns).collect())
    assert got == sorted(tuple(r) for r in batch.select(columns).collect())
    assert len(got) == 9000


def test_sessions_expire(spark, tmp_path):
    """An address is forgotten its time after the last row of the id, and rows of the id keep it alive."""
    logs = tmp_path / "logs"
    logs.mkdir()
    parsed = parse_syslog(stream_lines(spark, str(logs), ordered=True), 2023)[0]
    stream = Stream(spark, stream_enrich(classify_mail(parsed), ttl_ms=20_000), tmp_path / "out")
    parts = [
        ["AAAAAAAAAA: client=h[192.0.2.1]", "BBBBBBBBBB: client=h[192.0.2.2]"],
        ["AAAAAAAAAA: alive"],
        ["AAAAAAAAAA: still", "BBBBBBBBBB: gone"],
    ]
    began = time.monotonic()
    for number, texts in enumerate(parts):
        (logs / f"{number}.log").write_text("\n".join(mail_line(i, t) for i, t in enumerate(texts)) + "\n")
        time.sleep(max(0.0, began + [0, 14, 28][number] - time.monotonic()))
        stream.run()
    found = {r["content"]: r["ipaddr"] for r in stream.rows().collect()}
    assert found["alive"] == found["still"] == "192.0.2.1" and found["gone"] == "**UNKNOWN**"


def test_sections_over_batches(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    lines = stream_lines(spark, str(logs), ordered=True).withColumn("log", F.lit("site"))
    records = parse_access(route_lines(lines)[0])[0]
    stream = Stream(spark, records.select("log", "file_path", "block_start", "seq", "date", "req"), tmp_path / "out")
    out = str(tmp_path / "rows")
    marker = section_marker(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), uuid4().hex, "log")
    days = [[1, 1, 2], [2, 3], [3, 1]]
    for number, part in enumerate(days):
        texts = [access_line(number * 10 + i, day=d) for i, d in enumerate(part)]
        (logs / f"{number}.log").write_text("\n".join(texts) + "\n")
        stream.run(marker)
    rows = spark.read.parquet(out).orderBy("file_path", "seq").collect()
    assert [r["new_section"] for r in rows] == [True, False, True, False, True, False, True]


def test_sections_per_file_equal_batch(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    for name, part in {"a": [1, 1, 2], "b": [2, 1]}.items():
        (logs / name).write_text("\n".join(access_line(i, day=d) for i, d in enumerate(part)) + "\n")
    records = parse_access(route_lines(stream_lines(spark, str(logs), ordered=True))[0])[0]
    out = str(tmp_path / "rows")
    Stream(spark, records.select("file_path", "block_start", "seq", "date"), tmp_path / "out").run(
        section_marker(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), uuid4().hex)
    )
    batch = mark_sections(parse_access(route_lines(read_lines(spark, str(logs)))[0])[0])

    def flags(df):
        return sorted((r["file_path"][-1], r["date"], r["new_section"]) for r in df.collect())

    assert flags(spark.read.parquet(out)) == flags(batch)


def test_options_are_restored(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    with state_on_disk(spark):
        assert "RocksDB" in spark.conf.get(name)
    assert spark.conf.get(name) == before


def test_section_state_is_bounded(spark, tmp_path):
    logs, state = tmp_path / "logs", tmp_path / "state"
    logs.mkdir()
    records = parse_access(route_lines(stream_lines(spark, str(logs), ordered=True))[0])[0]
    stream = Stream(spark, records.select("file_path", "block_start", "seq", "date"), tmp_path / "out")
    marker = section_marker(lambda df, n: df.count(), uuid4().hex, folder=str(state), forget_after="0 seconds")
    for number in range(4):
        (logs / f"{number}.log").write_text(access_line(number) + "\n")
        stream.run(marker)
    assert sorted(p.name for p in state.iterdir()) == ["after=2", "after=3"]
    assert spark.read.parquet(str(state / "after=3")).count() == 1


def test_mail_reports_equal_batch(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    parts = [
        ["AAAAAAAAAA: early", "AAAAAAAAAA: client=h[192.0.2.1]", "AAAAAAAAAA: one", "connect from h[192.0.2.9]"],
        ["AAAAAAAAAA: two", "BBBBBBBBBB: none", "AAAAAAAAAA: client=h[192.0.2.2]", "AAAAAAAAAA: three"],
        ["AAAAAAAAAA: four", "BBBBBBBBBB: client=h[192.0.2.3]", "BBBBBBBBBB: five"],
    ]
    stream = Stream(spark, stream_mail(stream_lines(spark, str(logs), ordered=True), 2023), tmp_path / "out")
    out = str(tmp_path / "rows")
    marker = mail_reports(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), uuid4().hex, ["host"])
    for number, texts in enumerate(parts):
        (logs / f"{number}.log").write_text("\n".join(mail_line(i, t) for i, t in enumerate(texts)) + "\n")
        stream.run(marker)
    report, _ = mail_log(read_lines(spark, str(logs)), 2023, scope=["host"])
    columns = ["msgid", "content", "ipaddr", "new_section"]
    got = sorted(tuple(r) for r in spark.read.parquet(out).select(columns).collect())
    assert got == sorted(tuple(r) for r in report.select(columns).collect())


def test_error_reports_equal_batch(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    text = (DATA / "error.log").read_text().splitlines()
    stream = Stream(spark, stream_error(stream_lines(spark, str(logs), ordered=True)), tmp_path / "out")
    out = str(tmp_path / "rows")
    marker = error_reports(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), uuid4().hex)
    for number in range(3):
        (logs / f"{number}.log").write_text("\n".join(text[number * 3 : number * 3 + 3]) + "\n")
        stream.run(marker)
    report, _ = error_log(read_lines(spark, str(logs)))
    columns = ["date", "time", "level", "message", "noise", "new_section"]
    got = sorted(tuple(r) for r in spark.read.parquet(out).select(columns).collect())
    assert got and got == sorted(tuple(r) for r in report.select(columns).collect())


def test_purify(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    stream = Stream(spark, stream_purify(stream_lines(spark, str(logs))), tmp_path / "out")
    for number, texts in enumerate([["a", "b", "a", "x" * 3001], ["b", "c", "A"], ["a", "c", "d"]]):
        (logs / f"{number}.log").write_text("\n".join(texts) + "\n")
        stream.run()
    got = sorted(r["value"] for r in stream.rows().collect())
    assert got == ["A", "a", "b", "c", "d"]
    assert got == sorted(r["value"] for r in purified(read_lines(spark, str(logs))).collect())


def test_purify_within(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "0.log").write_text("a\nb\na\n")
    lines = stream_lines(spark, str(logs)).withColumn("stamp", F.lit("2023-01-01").cast("timestamp"))
    stream = Stream(spark, stream_purify_within(lines, "stamp", "1 hour").select("value"), tmp_path / "out")
    stream.run()
    assert sorted(r["value"] for r in stream.rows().collect()) == ["a", "b"]


def test_lines_belong_to_the_bytes_of_their_newline(tmp_path):
    data = b"one\n\ntwo three\n" + b"x" * 200 + b"\nlast"
    (tmp_path / "a").write_bytes(data)
    wanted = [(i, line) for i, line in zip([0, 4, 5, 15], data.split(b"\n")[:-1])]
    for cut in range(len(data) + 1):
        parts = [*lines_ending_between(str(tmp_path / "a"), 0, cut), *lines_ending_between(str(tmp_path / "a"), cut, len(data))]
        assert parts == wanted


def test_a_batch_of_grown_files_can_be_bounded(tmp_path):
    for name in "ab":
        (tmp_path / name).write_bytes(b"0123456789" * 10)
    reader = GrowingTextReader({"path": str(tmp_path), "max_bytes": "150", "piece_bytes": "40"})
    first = reader.latestOffset()
    assert sum(json.loads(first["files"]).values()) == 150
    ranges = reader.partitions({}, first)
    assert [(r.path[-1], r.start, r.end) for r in ranges] == [
        ("a", 0, 40), ("a", 40, 80), ("a", 80, 100), ("b", 0, 40), ("b", 40, 50),
    ]
    assert sum(json.loads(reader.latestOffset()["files"]).values()) == 200


def test_follow_growing_files(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    stream = Stream(spark, follow_lines(spark, str(logs)), tmp_path / "out")
    with open(logs / "a.log", "ab") as log:
        for text in (b"one\ntwo\nthr", b"ee\r\n", b"", b"\nfour"):
            log.write(text)
            log.flush()
            stream.run()
    (logs / "b.log").write_bytes(b"other\n")
    stream.run()
    rows = stream.rows().orderBy("file_path", "seq").collect()
    assert [(r["file_path"][-5:], r["seq"], r["value"]) for r in rows] == [
        ("a.log", 0, "one"), ("a.log", 4, "two"), ("a.log", 8, "three"), ("a.log", 15, ""), ("b.log", 0, "other"),
    ]
