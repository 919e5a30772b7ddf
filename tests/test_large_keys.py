"""Queries on tables whose keys outgrow those of the small ones."""

from __future__ import annotations

import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from compare import compare, sql_connection
from fleetlens.plans.catalog import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
LOOKUPS = ["ip_bits", "net_lookup", "net_lookup_shuffled", "stream_lookup_large", "access_report", "stream_access"]


@pytest.fixture(scope="module")
def large_keys(spark, tmp_path_factory):
    """Events of users around 65535 and 2**32, whose numbers fill more than one group of a v6 address."""
    folder = str(tmp_path_factory.mktemp("large"))
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    first = F.when(F.col("event_id") % 2 == 0, 65_530).otherwise(2**32 - 5)
    events.withColumn("user_id", first + F.col("user_id") % 10).write.parquet(f"{folder}/written")
    (Path(folder) / "tables").mkdir()
    spark.read.parquet(f"{folder}/written").toPandas().to_parquet(f"{folder}/tables/events.parquet", coerce_timestamps="us")
    for name in ("region", "nation"):
        shutil.copy(f"{SF_DIR}/{name}.parquet", f"{folder}/tables/{name}.parquet")
    return f"{folder}/tables"


@pytest.mark.parametrize("name", LOOKUPS)
def test_lookups_of_long_v6_numbers(spark, large_keys, name):
    rows = QUERIES[name](spark, large_keys)
    assert compare(rows, sql_connection(large_keys), name, ORACLES[name]) is None
