"""The log reports as streams: records row by row, then order and sessions batch by batch.

What a batch hands to the next one, the last day of each log and the client of each message id, is a
table per batch below the shared folder, so a repeated batch starts from the same. The operators
are those of the batch reports, so no log and no message id is a group in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.errors import flag_noise, parse_error
from fleetlens.operators.lines import BLOCK, FILE, SEQ, route_lines
from fleetlens.operators.mail import UNKNOWN_ADDRESS, classify_mail, drop_statistics, parse_syslog
from fleetlens.operators.ordered import carry_last_by_block
from fleetlens.session import shared_folder
from fleetlens.streaming.sections import KEPT_BATCHES, forget, section_marker

Sink = Callable[[DataFrame, int], None]


def stream_error(lines: DataFrame, drop_noise: bool = False) -> DataFrame:
    """Error records with noise flagged or dropped; give the stream to ``error_reports``."""
    return flag_noise(parse_error(route_lines(lines)[0])[0], drop=drop_noise)


def stream_mail(lines: DataFrame, year: int) -> DataFrame:
    """Classified mail records; give the stream to ``mail_reports``."""
    return drop_statistics(classify_mail(parse_syslog(route_lines(lines)[0], year)[0]))


def error_reports(sink: Sink, name: str) -> Sink:
    """A ``foreachBatch`` function for ``stream_error``: adds ``new_section``."""
    return section_marker(sink, name)


def access_reports(sink: Sink, name: str) -> Sink:
    """A ``foreachBatch`` function for ``stream_access`` over ordered lines: adds ``new_section``."""
    return section_marker(sink, name)


def mail_reports(
    sink: Sink, name: str, scope: Sequence[str] = (), folder: str | None = None, forget_after: str = "1 day"
) -> Sink:
    """A ``foreachBatch`` function for ``stream_mail``: client addresses, then ``new_section``.

    The client of an id without rows for ``forget_after`` is left out of the state.
    """
    keys = [*scope, "msgid"]

    def enrich(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state_folder = folder or f"{shared_folder(spark)}/sessions/{name}"
        rows = batch.persist()  # read for the summaries, the rows and the state
        rows.count()  # stages that run side by side on several executors would each parse what is not cached yet
        client = F.when(F.col("kind") == "msg_start", F.col("ipaddr"))
        named = F.col("msgid") != ""
        clients = rows.where(named).groupBy(*keys).agg(
            F.max_by("ipaddr", F.when(F.col("kind") == "msg_start", F.struct(*FILE, *BLOCK, SEQ))).alias("client")
        )
        clients = clients.withColumn("seen", F.current_timestamp())
        earlier = None
        if batch_id > 0:
            schema = ", ".join([*(f"`{k}` string" for k in keys), "client string", "seen timestamp"])
            before = spark.read.schema(schema).parquet(f"{state_folder}/after={batch_id - 1}")
            earlier = before.select(*keys, F.col("client").alias("v"))
            fresh = before.where(F.col("seen") >= F.current_timestamp() - F.expr(f"INTERVAL {forget_after}"))
            kept = fresh.withColumnsRenamed({"client": "_old", "seen": "_seen"})
            clients = clients.join(kept, keys, "full").select(
                *keys, F.coalesce("client", "_old").alias("client"), F.coalesce("seen", "_seen").alias("seen")
            )
        carried = carry_last_by_block(rows, keys, [*FILE, *BLOCK], SEQ, client, "_client", named, earlier)
        known = F.coalesce("ipaddr", "_client", F.lit(UNKNOWN_ADDRESS))
        mark(carried.withColumn("ipaddr", known).select(*batch.columns), batch_id, rows)
        clients.where(F.col("client").isNotNull()).write.mode("overwrite").parquet(f"{state_folder}/after={batch_id}")
        forget(spark, state_folder, batch_id - KEPT_BATCHES)
        rows.unpersist()

    mark = section_marker(sink, name)
    return enrich
