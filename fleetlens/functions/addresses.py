"""Addresses and networks as strings of binary digits.

A network is the first ``prefix_len`` digits of its address, so "address in network" is a plain
equality on a prefix of the digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"(?d)^{_OCTET}(?:\.{_OCTET}){{3}}$"
_V4_TAIL = rf"(?d)^(.*:)({_OCTET})\.({_OCTET})\.({_OCTET})\.({_OCTET})$"
# Up to eight groups; "::" at most once. The number of groups is checked separately.
_V6_TEXT = (
    r"(?di)^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*+)?(?:::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*+)?)?$"
)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, where the body mentions it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _v4_bits(ip: Column) -> Column:
    octets = F.split(ip, r"\.")
    return F.concat(*[F.lpad(F.bin(F.get(octets, F.lit(i)).try_cast("bigint")), 8, "0") for i in range(4)])


def _tail_to_groups(ip: Column) -> Column:
    """Write a dotted tail, as in ``::ffff:1.2.3.4``, as two hexadecimal groups."""
    parts = F.split(F.regexp_replace(ip, _V4_TAIL, "$1\n$2\n$3\n$4\n$5"), "\n", -1)

    def pair(a: int, b: int) -> Column:
        high = F.get(parts, F.lit(a)).try_cast("bigint")
        low = F.get(parts, F.lit(b)).try_cast("bigint")
        return F.hex(high * 256 + low)

    return F.when(
        F.size(parts) == 5, F.concat(F.get(parts, F.lit(0)), pair(1, 2), F.lit(":"), pair(3, 4))
    ).otherwise(ip)


def _group_count(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit(":"))) + 1)


def _hex_digits(groups: Column) -> Column:
    """``a:1b`` to ``000a001b``."""
    padded = F.transform(F.split(groups, ":"), lambda g: F.lpad(g, 4, "0"))
    return F.when(groups == "", "").otherwise(F.concat_ws("", padded))


def _v6_bits(ip: Column) -> Column:
    return bound(F.when(ip.contains("."), _tail_to_groups(ip)).otherwise(ip), _plain_v6_bits)


def _plain_v6_bits(ip: Column) -> Column:
    left = F.substring_index(ip, "::", 1)
    right = F.substr(ip, F.length(left) + 3)
    given = _group_count(left) + _group_count(right)
    whole = F.when(ip.contains("::"), given <= 7).otherwise(given == 8)
    digits = F.concat(_hex_digits(left), F.repeat(F.lit("0000"), 8 - given), _hex_digits(right))
    bits = bound(
        digits,
        lambda hex32: F.concat(
            F.lpad(F.conv(hex32.substr(1, 16), 16, 2), 64, "0"),
            F.lpad(F.conv(hex32.substr(17, 16), 16, 2), 64, "0"),
        ),
    )
    return F.when(ip.rlike(_V6_TEXT) & whole, bits)


def ip_family(ip: Column) -> Column:
    """``v6`` for anything with a colon, else ``v4``; validity is up to :func:`ip_bits`."""
    return F.when(ip.contains(":"), "v6").otherwise("v4")


def ip_bits(ip: Column) -> Column:
    """32 or 128 binary digits, or null when the text is not an address."""
    return F.when(ip.contains(":"), _v6_bits(ip)).when(ip.rlike(_V4), _v4_bits(ip))


def net_parts(cidr: Column) -> Column:
    """``struct<family, prefix_len, bits>`` of a network; null when the text is not one.

    A missing mask means the whole address; a mask beyond the address width means the same.
    """
    parts = F.split(F.regexp_replace(cidr, r"(?d)^([0-9a-f:.]+)(?:/(\d{1,3}))?$", "$1\n$2"), "\n", -1)
    return bound(parts, _checked_net)


def _checked_net(parts: Column) -> Column:
    address = F.when(F.size(parts) == 2, F.get(parts, F.lit(0)))
    mask = F.when(F.get(parts, F.lit(1)) != "", F.get(parts, F.lit(1)).try_cast("int"))

    def net(bits: Column) -> Column:
        prefix_len = F.least(F.coalesce(mask, F.length(bits)), F.length(bits))
        return F.when(
            bits.isNotNull(),
            F.struct(
                ip_family(address).alias("family"),
                prefix_len.alias("prefix_len"),
                F.substring(bits, F.lit(1), prefix_len).alias("bits"),
            ),
        )

    return bound(bound(address, ip_bits), net)


def net_bits(cidr: Column) -> Column:
    """The digits of a network, cut to its mask."""
    return net_parts(cidr)["bits"]
