"""Hex and integers as columns. Values of more than 64 bits stay text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_0x(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), "^0x", "")


def hex_to_long(c: Column | str) -> Column:
    """0x-prefixed or bare hex of up to 63 bits; empty is 0."""
    digits = strip_0x(c)
    return F.when(digits == "", F.lit(0).cast("bigint")).otherwise(F.conv(digits, 16, 10).cast("bigint"))


def quantity_to_long(c: Column | str) -> Column:
    """0x hex, or else a decimal number, or with a leading zero an octal one."""
    x = _col(c)
    return F.when(x.rlike("^0[xX]"), F.conv(F.substring(x, 3, 64), 16, 10)).when(x.rlike("^0[0-7]+$"), F.conv(x, 8, 10)).otherwise(x).cast("bigint")


def long_to_hex(c: Column | str) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(_col(c))))


def topic_address(c: Column | str) -> Column:
    """The address in a 32-byte topic."""
    return F.concat(F.lit("0x"), F.lower(F.right(strip_0x(c), F.lit(40))))


def word_to_long(c: Column | str, word: int = 0) -> Column:
    """A 32-byte word of data as a number if it fits 63 bits, else null."""
    w = F.substring(strip_0x(c), 64 * word + 1, 64)
    return F.when((F.length(w) == 64) & w.rlike("^0{48}[0-7]"), F.conv(F.substring(w, 49, 16), 16, 10).cast("bigint"))
