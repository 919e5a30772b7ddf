"""Duplicates, repeated lines, retention, usage, aliases and JSON text on small input."""

from __future__ import annotations

import re
import json
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.functions.json_text import json_pretty, pretty
from fleetlens.functions.labels import short_status, thousands
from fleetlens.functions.arguments import month_number, parse_clause, parse_size_arg
from fleetlens.operators.aliases import annotate_ids, read_aliases, resolve_alias
from fleetlens.operators.duplicates import dedup_plan, duplicate_members, in_walk_order, size_candidates
from fleetlens.operators.purify import purified, purify, purify_stats
from fleetlens.operators.retention import retention_plan
from fleetlens.operators.usage import dir_usage, root_usage


@pytest.fixture(scope="module")
def files(spark):
    """Most files share one digest; names test the order of directories."""
    rng = random.Random(5)
    rows = []
    for i in range(300):
        size = rng.choice([1, 1, 1, 2, 3, 1000 + i])
        name = rng.choice(["a", "a b", "a-b", "b"]) + "/" + rng.choice(["", "x/", "x-y/"]) + f"f{i}"
        rows.append((rng.choice(["r1", "r2"]), name, size, f"md5-{size}"))
    return rows, spark.createDataFrame(rows, "root string, subpath string, size bigint, md5 string")


def groups_of(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[3], []).append(row)
    return {k: sorted(v, key=lambda r: (r[0], r[1].split("/"))) for k, v in groups.items() if len(v) > 1}


@pytest.mark.parametrize("hot_rows", [20, 10**6])
@pytest.mark.parametrize("keep", [1, 2, 60, "X", 0, None])
def test_dedup_plan(files, keep, hot_rows):
    rows, df = files
    expected = set()
    for members in groups_of(rows).values():
        for place, row in enumerate(members, 1):
            if not keep or (keep != "X" and keep > len(members)):
                action = "skip"
            else:
                action = "keep" if place == keep else "delete"
            expected.add((row[0], row[1], len(members), action))
    got = dedup_plan(df, keep, hot_rows).select("root", "subpath", "n", "action").collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_members_and_candidates(files):
    rows, df = files
    members = [r for g in groups_of(rows).values() for r in g]
    assert {tuple(r)[:4] for r in duplicate_members(df, hot_rows=20).collect()} == set(members)
    assert {tuple(r) for r in size_candidates(df, hot_rows=20).collect()} == set(members)
    walk = [(r["root"], r["subpath"]) for r in in_walk_order(df).collect()]
    assert walk == sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0], r[1].split("/")))


def test_purify(lines_of):
    long_line = "é" * 1501
    texts = ["a", "b", "a", "A", long_line, "", "b", "", long_line, "é" * 1500, "a"]
    lines = lines_of(texts)
    got = {r["seq"]: r["status"] for r in purify(lines).collect()}
    assert [got[i] for i in range(len(texts))] == "--- --- DUP --- TLL --- DUP DUP TLL --- DUP".split()
    assert [r["value"] for r in purified(lines).orderBy("seq").collect()] == ["a", "b", "A", "", "é" * 1500]
    assert tuple(purify_stats(lines).first()) == (11, 4, 2, 5)


def test_purify_stats_of_nothing(lines_of):
    assert tuple(purify_stats(lines_of(["x"]).where("false")).first()) == (0, 0, 0, 0)


def test_retention(spark):
    rows = [("h", "auto", f"f{i:02d}", f"2024-01-{1 + i % 28:02d} 12:00:00") for i in range(40)]
    df = spark.createDataFrame(rows, "host string, dir string, file string, m string")
    df = df.select("host", "dir", "file", F.col("m").cast("timestamp").alias("mtime"))
    got = {r["file"]: (r["rotated"], r["expired"]) for r in retention_plan(df, "2024-01-29 11:59:59", 20, 15).collect()}
    newest = {r[2] for r in sorted(rows, key=lambda r: ([-ord(c) for c in r[3]], r[2]))[:20]}
    for i, row in enumerate(rows):
        days = 28 - (1 + i % 28)  # one second short of a whole number of days, plus one
        assert got[row[2]] == (row[2] not in newest, days > 15)


def test_usage(spark):
    rows = [("r", "a/1", 1), ("r", "a/b/2", 2), ("r", "c", 4), ("r", "proc/x", 8), ("q", "a/1", 16)]
    df = spark.createDataFrame(rows, "root string, subpath string, size bigint")
    assert {tuple(r) for r in dir_usage(df).collect()} == {
        ("r", "a", 3), ("r", "proc", 8), ("r", ".", 15), ("q", "a", 16), ("q", ".", 16),
    }
    assert {tuple(r) for r in dir_usage(df, depth=2).collect()} >= {("r", "a/b", 2), ("r", ".", 15)}
    assert {tuple(r) for r in root_usage(df).collect()} == {("r", "a", 3), ("r", "c", 4), ("q", "a", 16)}


def test_aliases(spark, lines_of):
    aliases = read_aliases(
        lines_of(["; note", "", " 17ade7  web server ", "beef db$1", "cafe", "17ade7 www", "_EOF_", "dead late", "_EOF_"])
    )
    assert [(r["alias"], r["label"]) for r in aliases.orderBy("alias").collect()] == [
        ("17ade7", "www"), ("beef", "db$1"), ("cafe", ""),
    ]
    texts = {
        "17ade7745a9c up": "17ade7745a9c www up", "x17ade7": "x17ade7 www", "abeef1": "abeef1", "beef": "beef db$1",
        "dead": "dead", "beef 17ade7": "beef db$1 17ade7 www", "cafe0": "cafe0 ",
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["annotated"] for r in annotate_ids(df, "t", aliases).collect()} == texts
    ids = spark.createDataFrame([("www",), ("beef",), ("db$1",), ("late",)], "id string")
    assert {r["id"]: r["resolved"] for r in resolve_alias(ids, "id", aliases).collect()} == {
        "www": "17ade7", "beef": "beef", "db$1": "beef", "late": "late",
    }


def test_json_pretty(spark):
    cases = {
        '{"b":1,"a":[1,2,{}],"c":[]}': '{\n    "b": 1,\n    "a": [\n        1,\n        2,\n        {}\n    ],\n    "c": []\n}',
        '"a/b é"': '"a/b \\u00e9"', "1.0": "1", "0.1": "0.1", "1e25": "1.0e+25", "1.5e-7": "1.5e-7", "-0": "-0",
        "123456789012345678901": "1.2345678901234568e+20", "": "null", "{": "null", "NaN": "null", "true": "true",
        "[" * 600 + "]" * 600: "null",
    }
    for text, expected in cases.items():
        assert pretty(text) == expected, text
    df = spark.createDataFrame([('{"a":1}',), (None,)], "t string").select(json_pretty(F.col("t")).alias("p"))
    assert {r["p"] for r in df.collect()} == {'{\n    "a": 1\n}', None}


def test_arguments():
    assert [parse_size_arg(t) for t in ("0", "10k", "5M", "7")] == [0, 10240, 5242880, 7]
    for bad in ("", "k", "10K", "-1", "1.5M", "10kk"):
        with pytest.raises(ValueError):
            parse_size_arg(bad)
    assert parse_clause("status=404,,500") == ("status", ["404", "500"])
    assert parse_clause("url=a=b") == ("url", ["a=b"])
    for bad in ("status", "Status=1", "status="):
        with pytest.raises(ValueError):
            parse_clause(bad)
    assert [month_number(m) for m in ("Jan", "Dec", "jan", "Foo")] == [1, 12, None, None]


def test_small_labels(spark):
    numbers = {"1": "1", "999": "999", "1000": "1'000", "1234567": "1234'567", "-5000": "-5000"}
    got = spark.createDataFrame([(n,) for n in numbers], "n string").select("n", thousands(F.col("n")).alias("t"))
    assert {r["n"]: r["t"] for r in got.collect()} == numbers
    states = {"Exited (0) 3 days ago": "Ex(0) 3 days ago", "Up 3 hours": "Up 3 hours"}
    got = spark.createDataFrame([(s,) for s in states], "s string").select("s", short_status(F.col("s")).alias("t"))
    assert {r["s"]: r["t"] for r in got.collect()} == states


def test_labels_that_hold_aliases(spark):
    """Later aliases apply to labels too, through any number of steps; earlier ones do not."""
    rows = [("aa", "x-bb1", 1), ("bb", "cc", 2), ("cc", "dd", 3), ("dd", "end", 4), ("ee", "aa", 5), ("z.", "never", 6)]
    aliases = spark.createDataFrame(rows, "alias string, label string, seq int")
    texts = {"aa0": "aa0 x-bb1 cc dd end", "ee": "ee aa", "bb,aa": None, "": "", "none": "none", None: None, "z.": "z."}

    def folded(text):
        for alias, label, _ in rows:
            if re.fullmatch("[0-9a-f]+", alias):
                text = re.sub(f"(^|[^0-9a-f])({alias})([0-9a-f]*)", lambda m: m.group() + " " + label, text)
        return text

    df = spark.createDataFrame([(t,) for t in texts] * 3, "t string")
    got = annotate_ids(df, "t", aliases).collect()
    assert len(got) == 3 * len(texts)
    for row in got:
        assert row["annotated"] == (None if row["t"] is None else folded(row["t"]))
    assert folded("aa0") == texts["aa0"] and folded("ee") == texts["ee"]


@pytest.mark.parametrize("n", [1, 40])
def test_aliases_in_the_plan_and_joined_ones_agree(spark, n):
    rng = random.Random(n)
    names = {"".join(rng.choice("ab1") for _ in range(rng.randrange(1, 5))) for _ in range(n)}
    rows = [(a, " ".join(rng.choice([*names, "x", "abba"]) for _ in range(rng.randrange(3))), i) for i, a in enumerate(sorted(names))]
    aliases = spark.createDataFrame(rows, "alias string, label string, seq int")
    texts = [" ".join("".join(rng.choice("ab1x") for _ in range(rng.randrange(6))) for _ in range(5)) for _ in range(60)]
    df = spark.createDataFrame([(t, i) for i, t in enumerate([*texts, None, ""])], "t string, seq int")
    plan = annotate_ids(df, "t", aliases)
    assert "Join" not in plan._jdf.queryExecution().executedPlan().toString()
    found = sorted((r.seq, r.annotated) for r in plan.collect() if r.t is not None)
    assert found == sorted((r.seq, r.annotated) for r in annotate_ids(df, "t", aliases, in_place=0).collect() if r.t is not None)


def test_pretty_from_tokens_is_pretty_in_python(spark):
    from fleetlens.functions import json_text

    rng = random.Random(4)

    def value(depth):
        kind = rng.randrange(9 if depth < 4 else 6)
        if kind < 3:
            return rng.choice([0, 1, -1, 7, 2**60, -(10**17), 10**18, 2**63, True, False, None])
        if kind < 5:
            return rng.choice(["", "a", "x:y, {z}", "[1]", "é", 'q"', "/", "\\", "\n", "\x7f", "1.5"])
        if kind == 5:
            return rng.choice([1.5, -0.0, 1e30, 3.0])
        if kind < 7:
            return [value(depth + 1) for _ in range(rng.randrange(4))]
        return {rng.choice("abcdé") * rng.randrange(3): value(depth + 1) for _ in range(rng.randrange(4))}

    texts = []
    for i in range(1500):
        v = value(0)
        texts.append(json.dumps(v, ensure_ascii=bool(i % 2), indent=rng.choice([None, 1]), separators=rng.choice([(",", ":"), (" , ", " : ")])))
    broken = [t[: rng.randrange(len(t) + 1)] + rng.choice(["", "}", ",", " 1", "]", '"', ":"]) + t[rng.randrange(len(t) + 1) :] for t in texts[:500]]
    texts += broken + ["1 2", "{} {}", "[1][2]", "[] 1", '{"a":1,"a":2}', "01", "-0", "--1", "nulL", "'a'", "[1,]", "[,1]", "{,}", "/**/1", "[NaN]", "1,2", "a", "\t7 ", '"a" "b"']
    texts += ["[" * n + "]" * n for n in (100, 249, 251, 512, 513)] + ["[" + "1," * 5000 + "1]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(8)
    found = {r.i: r.p for r in df.select("i", json_pretty(F.col("t")).alias("p")).collect()}
    for i, t in enumerate(texts):
        assert found[i] == pretty(t), t
    # Texts of strings without escapes and of integers do not reach Python.
    plain = [t for t in texts[:1500] if t.isascii() and not re.search(r"[\\\x7f]|[.][0-9]|[0-9]e|-0|[0-9]{19}", t)]
    by_tokens = {r.t for r in df.where(json_text.is_plain(F.col("t"))).select("t").collect()}
    repeated = {t for t in plain if len(set(re.findall(r'"[a-d]*" *:', t))) < len(re.findall(r'"[a-d]*" *:', t))}
    assert len(plain) > 200 and set(plain) - repeated <= by_tokens
