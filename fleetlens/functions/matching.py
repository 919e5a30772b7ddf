"""Regular-expression matching that runs each pattern once per row.

All patterns start with ``(?d)``: only a newline ends a line, so U+2028, U+0085 or a carriage
return inside a message neither ends the match nor is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lines are split at newlines before they get here, so a newline cannot occur inside a field.
SEPARATOR = "\n"


def match_groups(text: Column, pattern: str, groups: int) -> Column:
    """The first ``groups`` groups of an anchored pattern as one array.

    Rows that do not match keep their text as a single element, so ``size(...) == groups`` tells
    whether the pattern matched. Unmatched optional groups are empty strings.
    """
    packed = SEPARATOR.join(f"${i}" for i in range(1, groups + 1))
    return F.split(F.regexp_replace(text, pattern, packed), SEPARATOR, -1)


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters read instead of computing them again.

    A filter over a projected column is pushed below the projection and would run the regular
    expression a second time; it is not pushed through a one-element ``inline``.
    """
    names = list(columns)
    one_row = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    keep = [c for c in df.columns if c not in names]
    return df.select(*keep, F.inline(one_row))


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def digits_to_long(text: Column) -> Column:
    """A run of digits as a bigint; beyond the range it stays at the largest bigint."""
    return F.when(text != "", F.coalesce(text.try_cast("bigint"), F.lit(2**63 - 1)))
