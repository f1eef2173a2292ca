"""Rounding, number text, numeric coercion and hash-derived uniforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(c: Column, digits: int) -> Column:
    """``floor(x * 10^n + 0.5) / 10^n``: the same value in every SQL engine, unlike ``round`` on doubles."""
    scale = float(10**digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def round_half_even_int(c: Column) -> Column:
    """Whole number nearest to ``c``, ties to the even one."""
    return F.bround(c, 0).cast("long")


def to_number(c: Column) -> Column:
    """Number, or null where the text is not one (never an error under ANSI mode)."""
    return c.cast("string").try_cast("double")


def number_text(c: Column) -> Column:
    """Shortest text of a double without an exponent between 1e-4 and 1e16 (``0.3``, ``50.0``, ``0.0001``)."""
    plain = F.rtrim(c.cast("decimal(38,17)").cast("string"), F.lit("0"))
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    size = F.abs(c)
    widened = ((size >= 1e-4) & (size < 1e-3)) | ((size >= 1e7) & (size < 1e16))
    return F.when(widened, plain).otherwise(c.cast("string"))


def md5_text(*parts: Column) -> Column:
    """md5 of the parts joined with ``|``."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def hash_unit(*parts: Column) -> Column:
    """Uniform number in [0, 1) from the first 52 bits of :func:`md5_text`."""
    bits = F.conv(F.substring(md5_text(*parts), 1, 13), 16, 10).cast("long")
    return bits.cast("double") / F.lit(float(2**52))
