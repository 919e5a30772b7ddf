"""The work on mail records stays compiled, and a micro-batch of them is held once."""

from __future__ import annotations

import random
from uuid import uuid4

from pyspark.sql import functions as F

from fleetlens.operators.mail import classify_mail, parse_syslog
from fleetlens.operators.ordered import carry_last, carry_last_by_block
from fleetlens.streaming.reports import mail_reports, stream_mail

COMPILED_BYTES = 8000  # HotSpot interprets methods beyond this


def generated_methods(spark, plan):
    """The bytes of the largest method of each generated stage below ``plan``."""
    if plan.getClass().getSimpleName() == "WholeStageCodegenExec":
        code = plan.doCodeGen()._2()
        generator = spark._jvm.org.apache.spark.sql.catalyst.expressions.codegen.CodeGenerator
        yield generator.compile(code)._2().maxMethodCodeSize()
    children = plan.children()
    for i in range(children.length()):
        yield from generated_methods(spark, children.apply(i))


def test_classification_is_compiled(spark, tmp_path):
    spark.createDataFrame([("f", "text")], "file_path string, value string").write.parquet(str(tmp_path / "lines"))
    rows = classify_mail(parse_syslog(spark.read.parquet(str(tmp_path / "lines")), 2023)[0])
    sizes = list(generated_methods(spark, rows._jdf.queryExecution().executedPlan()))
    assert sizes and max(sizes) <= COMPILED_BYTES


def test_a_batch_is_held_once(spark, lines_of):
    texts = ["AAAAAAAAAA: client=h[192.0.2.1]", "AAAAAAAAAA: one", "AAAAAAAAAA: two", "AAAAAAAAAA: three"]
    lines = lines_of([f"Feb  8 15:51:0{i} mx1 postfix/smtpd[1]: {text}" for i, text in enumerate(texts)])
    before = spark._jsc.getPersistentRDDs().size()
    held, found = [], []

    def sink(batch, batch_id):
        found.extend(tuple(r) for r in batch.select("content", "ipaddr", "new_section").collect())
        held.append(spark._jsc.getPersistentRDDs().size() - before)

    mail_reports(sink, uuid4().hex, ["host"])(stream_mail(lines, 2023), 0)
    assert held == [1]
    assert sorted(found) == sorted(
        [("client=h", "192.0.2.1", True), ("one", "192.0.2.1", False), ("two", "192.0.2.1", False), ("three", "192.0.2.1", False)]
    )


def test_carried_by_block(spark):
    """As ``carry_last``, with what is known before a group where it has nothing yet."""
    draw = random.Random(9)
    rows = [
        (draw.choice("ab"), f"f{i // 100}", i // 7, i, draw.choice("xyz") if draw.random() < 0.1 else None)
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, "id string, file string, block int, seq int, v string")
    before = spark.createDataFrame([("a", "known"), ("c", "other")], "id string, v string")
    args = (df, ["id"], ["file", "block"], "seq", F.col("v"), "out")
    seeded = F.coalesce("out", F.when(F.col("id") == "a", F.lit("known")))

    def rows_of(frame):
        return sorted(map(repr, frame.select("id", "file", "block", "seq", "v", "out").collect()))

    assert rows_of(carry_last_by_block(*args)) == rows_of(carry_last(*args))
    assert rows_of(carry_last_by_block(*args, initial=before)) == rows_of(carry_last(*args).withColumn("out", seeded))
    within = F.col("id") == "b"
    assert rows_of(carry_last_by_block(*args, within)) == rows_of(carry_last(*args, within))
