"""Rounding and text forms of figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: float, digits: int = 6) -> float:
    """Python's rounding (half to even on the binary value), for scalars on the driver."""
    return round(float(value), digits)


def two_decimals(value: Column) -> Column:
    """Two decimals, as Python formats them; no thousands separators."""
    return F.replace(F.format_number(value, 2), F.lit(","), F.lit(""))


def percent(share: Column) -> Column:
    return F.concat(two_decimals(share * 100), F.lit("%"))
