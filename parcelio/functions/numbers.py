"""Rounding, clamping, rescaling and division rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(value: Column) -> Column:
    """Nearest whole number, ties to the even neighbour (IEEE rounding)."""
    return F.rint(value)


def divide_or_null(numerator: Column, denominator: Column) -> Column:
    """Quotient, or null for a zero denominator (no infinity in the result)."""
    return F.try_divide(numerator, denominator)


def clamp_negative(value: Column) -> Column:
    """Negative amounts become zero; null stays null."""
    return F.when(value < 0, F.lit(0.0)).otherwise(value)


def rescale_censored(value: Column, low: float, high: float) -> Column:
    """Position of `value` within [low, high] as 0..1; null outside."""
    return F.when(value.between(low, high), (value - F.lit(low)) / F.lit(high - low))


def cube(value: Column) -> Column:
    return F.pow(value.cast("double"), F.lit(3.0))
