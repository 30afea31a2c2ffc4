"""Whole-number arithmetic. Spark's ``/`` goes through doubles, which cannot tell nanosecond times apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_div(value: Column, divisor: int | Column) -> Column:
    """The greatest whole number not above value / divisor, exact for every BIGINT; the divisor is positive."""
    by = F.lit(divisor) if isinstance(divisor, int) else divisor
    whole = value.cast("bigint")
    return F.call_function("div", whole - F.pmod(whole, by), by)
