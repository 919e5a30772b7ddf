"""Run a registered query and its SQL on the same tables and compare schema and rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def sql_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    return value


def _rows(names: list[str], table) -> tuple[list[tuple[str, str]], Counter]:
    order = sorted(names)
    types = [(n, str(table.schema.field(n).type).replace("large_", "")) for n in order]
    columns = [[_plain(v) for v in table.column(n).to_pylist()] for n in order]
    return types, Counter(zip(*columns))


def compare(rows, connection, name: str, sql: str) -> str | None:
    """``None`` when the DataFrame and the SQL agree, else a short account of the difference."""
    mine = rows.toArrow()
    theirs = connection.sql(sql).to_arrow_table()
    if sorted(mine.column_names) != sorted(theirs.column_names):
        return f"{name}: columns {sorted(mine.column_names)} != {sorted(theirs.column_names)}"
    types_a, rows_a = _rows(mine.column_names, mine)
    types_b, rows_b = _rows(theirs.column_names, theirs)
    if types_a != types_b:
        return f"{name}: types {[p for p in zip(types_a, types_b) if p[0] != p[1]]}"
    if rows_a != rows_b:
        only_a, only_b = rows_a - rows_b, rows_b - rows_a
        return (
            f"{name}: {mine.num_rows} rows against {theirs.num_rows}; only here {list(only_a)[:3]}; "
            f"only in SQL {list(only_b)[:3]}"
        )
    return None
