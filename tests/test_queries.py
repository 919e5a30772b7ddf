"""Every registered query against its SQL."""

from __future__ import annotations

import os
from pathlib import Path

import pytest

from compare import compare, sql_connection
from fleetlens.plans.catalog import ORACLES, QUERIES

SF_DIR = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connection():
    return sql_connection(SF_DIR)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    rows = QUERIES[name](spark, SF_DIR)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert compare(rows, connection, name, ORACLES[name]) is None


def test_lookup_does_not_shuffle_the_rows(spark):
    from fleetlens.operators.network import lookup_network
    from fleetlens.plans.network_queries import networks
    from fleetlens.plans.registry import table
    from fleetlens.plans.render import event_ip

    rows = table(spark, SF_DIR, "events").select("event_id", event_ip().alias("ip"))
    plan = lookup_network(rows, "ip", networks(spark, SF_DIR))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and plan.count("BroadcastHashJoin") > 1


@pytest.mark.parametrize("name", ["access_parse", "error_parse", "mail_classify"])
def test_parsing_runs_each_pattern_once(spark, name):
    from fleetlens.operators.mail import MAIL_KINDS

    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    patterns = {"access_parse": 1, "error_parse": 3, "mail_classify": 1 + len(MAIL_KINDS)}
    assert plan.count("regexp_replace(") == patterns[name]
    assert "Window" not in plan and "Join" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize("name", ["access_sections", "access_report", "error_report", "mail_enrich", "mail_report"])
def test_order_is_summed_up_by_hash(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_records_and_rejects_come_from_one_parse(spark):
    from fleetlens.plans.pipelines import access_log
    from fleetlens.plans.registry import table
    from fleetlens.plans.render import access_lines

    report, rejects = access_log(access_lines(table(spark, SF_DIR, "events")))
    for frame in (report, rejects):
        assert "regexp_replace(value" not in frame._jdf.queryExecution().executedPlan().toString()


def test_stored_tables_can_be_cleared(spark):
    from fleetlens.session import clear_stored, stored

    kept = stored(spark.range(3), "test")
    path = Path(kept.inputFiles()[0].removeprefix("file:").removeprefix("//")).parent
    assert path.exists()
    clear_stored(spark)
    assert not path.exists()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
    assert set(QUERIES) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
