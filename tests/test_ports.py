"""Ports of a container are taken apart once."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators.snapshots import parse_ports, ports_by_interface


def test_entries_are_split_and_named_once(spark):
    rows = spark.createDataFrame([("0.0.0.0:81->80/tcp, 53/udp, 10.0.0.1:25->25/tcp, 0.0.0.0:443->443/tcp",), ("",), ("x",)],
                                 "ports string")
    parsed = rows.select(parse_ports(F.col("ports")).alias("entries"))
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2
    named = spark.createDataFrame(parsed.collect(), parsed.schema).select(ports_by_interface(F.col("entries")).alias("text"))
    assert named._jdf.queryExecution().optimizedPlan().toString().count("]:") == 1
    assert [r["text"] for r in named.collect()] == ["[*]:tcp{81->80,443}; [-]:udp{53}; [10.0.0.1]:tcp{25}", "", ""]
