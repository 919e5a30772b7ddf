"""Numbered files: the same results as without numbers, found by hash."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators.duplicates import PLACE, dedup_plan, duplicate_groups, in_walk_order, number_files

SCHEMA = "root string, subpath string, size bigint, md5 string"


def build(spark, seed, rows=400):
    rng = random.Random(seed)
    found = []
    for i in range(rows):
        folder = "/".join(rng.choice(["a", "a b", "a-b", "é", "z"]) for _ in range(rng.randint(0, 3)))
        size = rng.choice([1, 1, 1, 2, 3, 1000 + i])
        md5 = None if i % 31 == 0 else f"md5-{size}"
        found.append((rng.choice(["r1", "r2", None]), f"{folder}/f{i}".lstrip("/"), size, md5))
    return spark.createDataFrame(found, SCHEMA).repartition(5)


def tuples(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("seed", [1, 2])
def test_same_results(spark, seed):
    files = build(spark, seed)
    numbered = number_files(files)
    assert tuples(duplicate_groups(numbered)) == tuples(duplicate_groups(files))
    walk = [tuple(r) for r in in_walk_order(files).collect()]
    assert [tuple(r) for r in in_walk_order(numbered).select(*files.columns).collect()] == walk
    for keep in (1, 3, 500, "X", 0):
        for hot_rows in (20, 10**6):
            plan = dedup_plan(numbered, keep, hot_rows)
            known = F.col("root").isNotNull()  # without numbers a null root equals nothing
            assert tuples(plan.drop(PLACE).where(known)) == tuples(dedup_plan(files, keep, hot_rows).where(known))


def test_a_first_member_without_root_is_kept(spark):
    files = spark.createDataFrame([(None, "x", 1, "m"), ("r", "a", 1, "m")], SCHEMA)
    plan = {r["subpath"]: r["action"] for r in dedup_plan(number_files(files)).collect()}
    assert plan == {"x": "keep", "a": "delete"}


def test_one_of_two_equal_rows_is_kept(spark):
    files = spark.createDataFrame([("r", "x", 1, "m")] * 2, SCHEMA)
    assert sorted(r["action"] for r in dedup_plan(number_files(files)).collect()) == ["delete", "keep"]
    assert [tuple(r) for r in duplicate_groups(number_files(files)).collect()] == [("m", 2, 2, "r", "x")]


def test_no_files(spark):
    none = number_files(build(spark, 1).where("false"))
    assert duplicate_groups(none).count() == dedup_plan(none).count() == 0


def test_numbers_are_given_anew(spark):
    files = build(spark, 3, 50).withColumn(PLACE, F.lit(7))
    assert number_files(files).select(PLACE).distinct().count() == 50


def test_no_rows_are_sorted_to_find_first_members(spark):
    numbered = number_files(build(spark, 1))
    for result in (duplicate_groups(numbered), dedup_plan(numbered)):
        assert "SortAggregate" not in result._jdf.queryExecution().executedPlan().toString()
