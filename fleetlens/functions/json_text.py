"""Pretty JSON text."""

from __future__ import annotations

import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from fleetlens.functions.addresses import bound

# The nesting limit, the integer range, and the decimal exponents written plainly.
MAX_DEPTH = 512
LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1
PLAIN_EXPONENTS = range(-4, 17)

TOKENS = 500  # a text of more is written in Python, as each token copies what is written so far
_ATOM = r"(?:true|false|null|0|-?[1-9][0-9]{0,17})(?![^\s\[\]{},:\"])"
_STRING = r'"[\x20\x21\x23-\x5B\x5D-\x7E]*+"'
_PLAIN = rf"^[ \t\n\r]*+(?:(?:{_STRING}|[\[\]{{}},:]|{_ATOM})[ \t\n\r]*+)*+$"
_TOKEN = r'"[^"]*+"|[\[\]{},:]|[^\s\[\]{},:"]++'


def _reject(text: str):
    raise ValueError(text)


def _integer(text: str) -> int | float:
    value = int(text)
    return value if LONG_MIN <= value <= LONG_MAX and text != "-0" else float(text)


def _float_text(value: float) -> str:
    """Shortest digits that read back the same; whole numbers carry no fraction."""
    digits = Decimal(repr(value)).normalize()
    if digits.adjusted() in PLAIN_EXPONENTS or not digits:
        return format(digits, "f")
    mantissa = format(digits.scaleb(-digits.adjusted()), "f")
    return f"{mantissa if '.' in mantissa else mantissa + '.0'}e{digits.adjusted():+d}"


def _write(value, indent: str, depth: int) -> str:
    if isinstance(value, (dict, list)):
        if depth > MAX_DEPTH:
            raise ValueError("nested too deep")
        inner = indent + "    "
        if isinstance(value, dict):
            items = [f"{json.dumps(k)}: {_write(v, inner, depth + 1)}" for k, v in value.items()]
            opening, closing = "{", "}"
        else:
            items = [_write(v, inner, depth + 1) for v in value]
            opening, closing = "[", "]"
        if not items:
            return opening + closing
        return f"{opening}\n{inner}" + f",\n{inner}".join(items) + f"\n{indent}{closing}"
    if isinstance(value, float):
        return _float_text(value)
    return json.dumps(value)


def pretty(text: str | None) -> str | None:
    """Re-encode with four spaces, slashes as they are; text that is not JSON becomes ``null``."""
    if text is None:
        return None
    try:
        value = json.loads(text, parse_int=_integer, parse_constant=_reject)
        return _write(value, "", 1).replace("\\u007f", "\x7f")
    except (ValueError, RecursionError):
        return "null"


@F.pandas_udf(StringType())
def _one_by_one(texts: pd.Series) -> pd.Series:
    return texts.map(pretty)


def _written(tokens: Column) -> Column:
    """The text of valid JSON from its tokens: each one's piece depends on its depth and its neighbours."""
    step = F.transform(
        tokens,
        lambda token, i: F.struct(
            token.alias("token"), F.get(tokens, i - 1).alias("before"), F.get(tokens, i + 1).alias("after")
        ),
    )
    opens, closes = ["{", "["], ["}", "]"]

    def line(depth: Column) -> Column:
        return F.concat(F.lit("\n"), F.repeat(F.lit("    "), depth))

    def add(state: Column, here: Column) -> Column:
        token, depth = here["token"], state["depth"]
        piece = (
            F.when(token.isin(opens), F.when(here["after"].isin(closes), token).otherwise(F.concat(token, line(depth + 1))))
            .when(token.isin(closes), F.when(here["before"].isin(opens), token).otherwise(F.concat(line(depth - 1), token)))
            .when(token == ",", F.concat(token, line(depth)))
            .when(token == ":", ": ")
            .otherwise(token)
        )
        deeper = depth + token.isin(opens).cast("int") - token.isin(closes).cast("int")
        return F.struct(deeper.alias("depth"), F.concat(state["text"], piece).alias("text"))

    return F.aggregate(step, F.struct(F.lit(0).alias("depth"), F.lit("").alias("text")), add, lambda state: state["text"])


def is_plain(text: Column) -> Column:
    """Whether JSON can be written from its tokens as they are."""
    # What follows a value is not looked at when it is parsed, but must not be there both as an element and as a member.
    element = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull()
    member = F.try_parse_json(F.concat(F.lit('{"":'), text, F.lit("}"))).isNotNull()
    short = F.regexp_count(text, F.lit(_TOKEN)) <= TOKENS
    return F.coalesce(text.rlike(_PLAIN) & short & element & member, F.lit(False))


def json_pretty(text: Column) -> Column:
    """:func:`pretty` as a column, written from the tokens of the text.

    Where a value has to be written anew, a text is left to :func:`pretty` in Python: it has escapes, characters
    beyond ASCII, or numbers that are no plain integers, or it repeats a key, is no JSON, or has more than ``TOKENS`` tokens.
    """
    tokens = F.regexp_extract_all(text, F.lit(f"({_TOKEN})"), F.lit(1))
    written = F.when(is_plain(text), bound(tokens, _written))
    return F.coalesce(written, _one_by_one(F.when(~is_plain(text), text)))
