"""Arithmetic on doubles that gives what SQL engines with IEEE 754 numbers give."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quotient(a: Column, b: Column) -> Column:
    """a / b; infinite with the sign of a where b is zero, NaN where both are."""
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(a / b)


def rounded(x: Column, digits: int) -> Column:
    """The double times 10^digits, to the nearest whole number (halves away from zero), and back. F.round takes the shortest decimal
    text of x instead, so that 1.005 becomes 1.01; here it becomes 1.0."""
    scale = F.lit(float(10**digits))
    return F.round(x * scale, 0) / scale
