"""Writing and tailing a file per log, where there are very many logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.plans.pipelines import log_lines
from fleetlens.sources.sinks import write_by_name
from fleetlens.sources.walk import walk_files

LOGS, LINES = 1500, 9


def text(log, seq):
    return f"log {log} line {seq} \u00e9" if seq % 4 else ""


def test_tails_of_many_files(spark, tmp_path):
    rows = spark.range(LOGS * LINES).select(
        (F.col("id") % LOGS).cast("string").alias("name"), F.expr(f"id div {LOGS}").alias("seq")
    )
    line = F.concat(F.lit("log "), "name", F.lit(" line "), F.col("seq").cast("string"), F.lit(" \u00e9"))
    write_by_name(rows.withColumn("value", F.when(F.col("seq") % 4 > 0, line).otherwise("")), str(tmp_path / "logs"))
    files = walk_files(spark, [str(tmp_path / "logs")])
    whole = {log: [text(log, seq) for seq in range(LINES)] for log in range(LOGS)}
    assert {r["path"].rpartition("/")[2]: r["size"] for r in files.collect()} == {
        str(log): len("".join(f"{line}\n" for line in lines).encode()) for log, lines in whole.items()
    }
    assert not list((tmp_path / "logs-partial").iterdir())

    def found(**tail):
        by_log: dict[int, list] = {}
        for r in log_lines(spark, files, **tail).select("file_path", "seq", "value").collect():
            by_log.setdefault(int(r["file_path"].rpartition("/")[2]), []).append((r["seq"], r["value"]))
        return {log: [value for _, value in sorted(lines)] for log, lines in by_log.items()}

    assert found() == whole
    assert found(last_lines=5) == {log: lines[-5:] for log, lines in whole.items()}
    assert found(last_bytes=1) == {log: lines[-1:] for log, lines in whole.items()}  # the last line is empty
    assert found(last_bytes=25) == {log: lines[-2:] for log, lines in whole.items()}


def test_the_queries_list_logs_by_tasks(spark):
    """No pattern over all logs is listed by the driver, with a scan split for each log."""
    from fleetlens.plans.catalog import QUERIES

    for name in ("files_tail_bytes", "files_tail_lines"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "binaryFile" not in plan and "InMemoryFileIndex" in plan
