"""Access logs as a stream."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from fleetlens.operators.access import Clause, apply_filters, label_access, parse_access
from fleetlens.operators.lines import route_lines
from fleetlens.operators.network import lookup_network


def stream_access(lines: DataFrame, filters: Iterable[str | Clause] = (), nets: DataFrame | None = None) -> DataFrame:
    """The batch operators on streamed lines; all of them work row by row.

    The networks are fetched once, when the stream is set up, and joined as broadcast tables.
    """
    records, _ = parse_access(route_lines(lines)[0])
    records = apply_filters(records, filters)
    if nets is None:
        return label_access(records)
    return label_access(lookup_network(records, "ip", nets), "net_label")
