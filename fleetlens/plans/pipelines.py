"""Whole runs: access log, error log and mail log reports, and the duplicate scan.

The log reports parse the lines once and store the records that pass the filters and the rejects below
the shared folder, as the section marks, the sessions and the two results all read them. With
``store=False`` nothing is run or written, and each of those reads parses the lines again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators.access import Clause, clause_condition, clauses_of, label_access, parse_access_lines
from fleetlens.operators.duplicates import reuse_digest, size_candidates
from fleetlens.operators.errors import flag_noise, parse_error_lines
from fleetlens.operators.lines import mark_sections, route_lines, split_rejects
from fleetlens.operators.mail import classify_mail, enrich_msgid, parse_syslog_lines
from fleetlens.operators.network import lookup_network
from fleetlens.session import stored
from fleetlens.sources.files import hash_files, read_index, read_manifest, write_index
from fleetlens.sources.lines import read_lines
from fleetlens.sources.tail import Paths, read_last_lines, read_tail

Tail = Callable[[DataFrame], DataFrame]


def log_lines(
    spark: SparkSession, paths: Paths, last_bytes: int | str | None = None, last_lines: int | None = None
) -> DataFrame:
    """Lines for a report: whole files, or only their ends, which are then read without what is before them."""
    if last_bytes is not None:
        return read_tail(spark, paths, last_bytes)
    if last_lines is not None:
        return read_last_lines(spark, paths, last_lines)
    if isinstance(paths, DataFrame):
        return read_tail(spark, paths, 2**62)
    return read_lines(spark, paths)


def access_log(
    lines: DataFrame,
    tail: Tail | None = None,
    filters: Iterable[str | Clause] = (),
    nets: DataFrame | None = None,
    store: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """``(report, rejects)`` of access-log lines."""
    taken = route_lines(tail(lines) if tail else lines)[0]
    rows = parse_access_lines(taken)
    for clause in clauses_of(filters):
        rows = rows.where(F.col("stage").isNotNull() | clause_condition(clause))
    records, rejects = split_rejects(_once(rows, "access", store), taken.columns)
    marked = mark_sections(records)
    if nets is None:
        return label_access(marked), rejects
    return label_access(lookup_network(marked, "ip", nets), "net_label"), rejects


def error_log(
    lines: DataFrame, tail: Tail | None = None, drop_noise: bool = False, store: bool = True
) -> tuple[DataFrame, DataFrame]:
    """``(report, rejects)`` of error-log lines."""
    taken = route_lines(tail(lines) if tail else lines)[0]
    records, rejects = split_rejects(_once(parse_error_lines(taken), "error", store), taken.columns)
    return mark_sections(flag_noise(records, drop=drop_noise)), rejects


def mail_log(
    lines: DataFrame,
    year: int,
    tail: Tail | None = None,
    scope: Sequence[str] = (),
    store: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """``(report, rejects)`` of mail-log lines: of whole files, or of their ends with ``tail``."""
    taken = route_lines(tail(lines) if tail else lines)[0]
    parsed = classify_mail(parse_syslog_lines(taken, year))
    rows = _once(parsed.where(F.col("stage").isNotNull() | (F.col("content") != "")), "mail", store)
    records, rejects = split_rejects(rows, taken.columns, "host")
    return enrich_msgid(mark_sections(records), scope), rejects


def _once(rows: DataFrame, name: str, store: bool) -> DataFrame:
    """Store parsed rows; of lines only those that were rejected are still needed."""
    if not store:
        return rows
    return stored(rows.withColumn("value", F.when(F.col("stage").isNotNull(), F.col("value"))), name)


def duplicate_scan(
    spark: SparkSession,
    roots: Sequence[str],
    index_path: str,
    now: datetime,
    previous_index: str | None = None,
) -> DataFrame:
    """Index the files below ``roots``, hash those that may have a duplicate, and store the index.

    Digests of ``previous_index`` are reused where path, size and mtime agree. The new index goes to
    ``index_path``, which must differ, and is read back as the result, so files are hashed once.
    """
    if previous_index is not None and previous_index.rstrip("/") == index_path.rstrip("/"):
        raise ValueError("the new index must not replace the one being read")
    files = read_manifest(spark, roots)
    candidates = size_candidates(files)
    if previous_index is None:
        pending = candidates.withColumn("md5", F.lit(None).cast("string"))
    else:
        pending = reuse_digest(candidates, read_index(spark, previous_index))
    hashed = hash_files(pending).select("root", "subpath", "md5")
    indexed = files.join(hashed, ["root", "subpath"], "left")
    write_index(indexed, index_path, now)
    return read_index(spark, index_path)
