"""All registered queries."""

from __future__ import annotations

from fleetlens.plans import (  # noqa: F401
    access_queries,
    content_queries,
    error_queries,
    file_queries,
    host_queries,
    mail_queries,
    network_queries,
    stream_queries,
)
from fleetlens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
