"""Helpers for call arguments."""

from __future__ import annotations

import re

# Unit suffixes of a byte amount.
_UNITS = {"": 1, "k": 1024, "M": 1024 * 1024}

# English short month names, case-sensitive.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def parse_size_arg(text: str) -> int:
    """``"10k"`` to 10240. Raises ``ValueError`` for anything else than digits and k or M."""
    found = re.fullmatch(r"([0-9]+)([Mk]?)", text)
    if not found:
        raise ValueError(f"not a byte amount: {text!r}")
    return int(found[1]) * _UNITS[found[2]]


def parse_clause(text: str) -> tuple[str, list[str]]:
    """``"status=404,500"`` to ``("status", ["404", "500"])``; empty values are dropped."""
    found = re.fullmatch(r"([a-z]+)=(.+)", text, re.DOTALL)
    if not found:
        raise ValueError(f"not a key=value filter: {text!r}")
    return found[1], [value for value in found[2].split(",") if value]


def month_number(name: str) -> int | None:
    return MONTHS.index(name) + 1 if name in MONTHS else None
