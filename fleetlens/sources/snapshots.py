"""Files of captured command output, account files and container descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators.snapshots import ACCOUNT_SCHEMA, CONTAINER_META, parse_container_meta


def read_accounts(spark: SparkSession, path: str) -> DataFrame:
    """Account files: seven fields separated by colons, no quoting."""
    reader = spark.read.option("sep", ":").option("quote", "").option("escape", "").schema(ACCOUNT_SCHEMA)
    return reader.csv(path).select("*", F.col("_metadata.file_path").alias("file_path"))


def read_container_meta(spark: SparkSession, path: str) -> DataFrame:
    """Container descriptions, one JSON array per file: ``name``, ``container_id``, ``overlay_id``."""
    whole = spark.read.option("wholetext", "true").text(path)
    return parse_container_meta(whole.select(F.col("_metadata.file_path").alias("file_path"), "value"))


__all__ = ["CONTAINER_META", "read_accounts", "read_container_meta"]
