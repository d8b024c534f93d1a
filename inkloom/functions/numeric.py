"""Numeric column helpers. Each rounding rule is named so that operators state which one they use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def round_half_up(value) -> Column:
    """Nearest integer, ties towards +infinity, as BIGINT."""
    return F.floor(as_col(value).cast("double") + F.lit(0.5))


def round_half_even(value) -> Column:
    """Nearest integer, ties to even, as DOUBLE."""
    return F.rint(as_col(value).cast("double"))


def truncate(value) -> Column:
    """Integer part, towards zero, as BIGINT."""
    return as_col(value).cast("bigint")


def clamp(value, low=0.0, high=1.0) -> Column:
    return F.least(as_col(high), F.greatest(as_col(low), as_col(value)))


def floor_div(value, size) -> Column:
    return F.floor(as_col(value) / as_col(size))


def positive_mod(value, modulus) -> Column:
    return F.pmod(as_col(value), as_col(modulus))


def radians(degrees) -> Column:
    """Degrees times pi over 180, in that order, so estimates keep their float noise."""
    return as_col(degrees).cast("double") * F.lit(3.141592653589793) / F.lit(180.0)


def six(value) -> Column:
    """Round to the six decimals at which results are compared; -0.0 becomes 0.0."""
    return F.round(as_col(value), 6) + F.lit(0.0)


def int_range(count) -> Column:
    """0 .. count-1 as an array; empty when count is not positive (plain sequence would run backwards)."""
    n = as_col(count).cast("int")
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
