"""Order-dependent operators against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators.lines import mark_sections, tail_bytes, tail_lines, with_offsets
from fleetlens.operators.ordered import carry_last, first_in_group, join_group_facts, previous_value, running_total
from fleetlens.sources.lines import read_lines
from fleetlens.sources.tail import read_last_lines, read_tail


@pytest.fixture(scope="module")
def log_file(tmp_path_factory):
    """A file of 3,000 lines of uneven length, with carriage returns, accents and bad UTF-8."""
    rng = random.Random(7)
    lines = [b"x" * rng.randrange(60) + rng.choice([b"", b"\r", "é".encode(), b"\xff"]) for _ in range(3000)]
    path = tmp_path_factory.mktemp("log") / "big.log"
    path.write_bytes(b"\n".join(lines) + b"\n")
    offsets, at = [], 0
    for line in lines:
        offsets.append(at)
        at += len(line) + 1
    return path, lines, offsets


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def texts(df):
    return [r["value"] for r in df.orderBy("file_path", "block_start", "seq").collect()]


def plain(lines):
    return [line.rstrip(b"\r").decode("utf-8", "replace") for line in lines]


def test_lines_and_offsets(spark, small_splits, log_file):
    path, lines, offsets = log_file
    df = read_lines(spark, str(path))
    assert df.select("block_start").distinct().count() > 4
    assert texts(df) == plain(lines)
    placed = with_offsets(df).orderBy("block_start", "seq").collect()
    assert [r["offset"] for r in placed] == offsets


@pytest.mark.parametrize("amount", [0, 1, 99, 100, 101, 5000, 40000, 10**9])
def test_tail_bytes(spark, small_splits, log_file, amount):
    path, lines, offsets = log_file
    size = path.stat().st_size
    expected = plain(line for line, at in zip(lines, offsets) if at >= size - amount)
    assert texts(tail_bytes(read_lines(spark, str(path)), amount)) == expected
    assert texts(read_tail(spark, str(path), amount)) == expected


@pytest.mark.parametrize("n", [1, 5, 700, 5000])
def test_tail_lines(spark, small_splits, log_file, n):
    path, lines, _ = log_file
    assert texts(tail_lines(read_lines(spark, str(path)), n)) == plain(lines[-n:])
    assert texts(read_last_lines(spark, str(path), n)) == plain(lines[-n:])


def test_tail_lines_by_estimate(spark, log_file):
    path, _, _ = log_file
    lines = read_lines(spark, str(path))
    assert texts(tail_lines(lines, 5, estimate_bytes=305)) == texts(tail_bytes(lines, 1525))


def test_tail_without_final_newline(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\ntwo\nthree")
    lines = read_lines(spark, str(tmp_path / "a.log"))
    for amount, kept in [(4, []), (5, ["three"]), (8, ["three"]), (9, ["two", "three"])]:
        assert texts(tail_bytes(lines, amount)) == kept
        assert texts(read_tail(spark, str(tmp_path / "a.log"), amount)) == kept


def test_sections(lines_of):
    dates = list("aabaccca")
    marked = mark_sections(lines_of(dates).withColumnRenamed("value", "date"))
    got = [r["new_section"] for r in marked.orderBy("seq").collect()]
    assert got == [True, False, True, True, True, False, False, True]


@pytest.fixture(scope="module")
def random_rows(spark):
    """Two thirds of the rows in one group; values are often null."""
    rng = random.Random(3)
    rows = [
        (rng.choice(["hot", "hot", "a", "b", "c"]), i // 7, i, rng.choice([None, None, None, i])) for i in range(900)
    ]
    return rows, spark.createDataFrame(rows, "g string, b bigint, s bigint, v bigint")


def test_carry_last(random_rows):
    rows, df = random_rows
    last, expected = {}, {}
    for g, _, s, v in rows:
        last[g] = v if v is not None else last.get(g)
        expected[s] = last[g]
    got = carry_last(df, ["g"], ["b"], "s", F.col("v"), "out").collect()
    assert {r["s"]: r["out"] for r in got} == expected


def test_previous_value(random_rows):
    rows, df = random_rows
    last, expected = {}, {}
    for g, _, s, v in rows:
        expected[s] = last.get(g)
        last[g] = -1 if v is None else v
    got = previous_value(df, ["g"], ["b"], "s", F.coalesce("v", F.lit(-1)), "out").collect()
    assert {r["s"]: r["out"] for r in got} == expected


def test_running_total(random_rows):
    rows, df = random_rows
    total, expected = {}, {}
    for g, _, s, _ in rows:
        expected[s] = total.get(g, 0)
        total[g] = total.get(g, 0) + s
    got = running_total(df, ["g"], ["b"], "s", F.col("s"), "out", grand="all").collect()
    assert {r["s"]: r["out"] for r in got} == expected
    assert {r["g"]: r["all"] for r in got} == total


@pytest.mark.parametrize("n", [1, 4, 1000])
def test_first_in_group(random_rows, n):
    rows, df = random_rows
    got = first_in_group(df, ["g"], [F.col("s").desc()], n, F.xxhash64("s"), spread=5).collect()
    expected = set()
    for g in {r[0] for r in rows}:
        ordered = sorted((r[2] for r in rows if r[0] == g), reverse=True)[:n]
        expected |= {(g, s, i + 1) for i, s in enumerate(ordered)}
    assert {(r["g"], r["s"], r["rank"]) for r in got} == expected


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_group_facts_with_hot_key(random_rows, how):
    rows, df = random_rows
    facts = df.groupBy("g").agg(F.count("*").alias("n")).where("g <> 'c'")
    got = join_group_facts(df, facts, "g", "n", how, hot_rows=200)
    counts = {g: sum(r[0] == g for r in rows) for g in ("hot", "a", "b")}
    assert counts["hot"] > 200 > counts["a"]
    expected = {(s, counts.get(g)) for g, _, s, _ in rows if how == "left" or g != "c"}
    collected = got.collect()
    assert {(r["s"], r["n"]) for r in collected} == expected and len(collected) == len(expected)
