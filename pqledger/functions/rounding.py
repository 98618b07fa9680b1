"""Rounding of doubles as Python rounds them: half to even, decided by the exact binary value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits a double into two halves of 26 bits, whose products with a power of ten are exact.
SPLIT = float((1 << 27) + 1)


def exact_round(x: Column, digits: int) -> Column:
    """x to so many digits (0 to 6) behind the point. 2.675 is 2.67, as the double is a little less, and 0.125 is 0.12.

    The product with 10^digits is taken with its rounding error; the error decides where the product alone looks like a tie.
    Doubles too large to have further digits, infinities and NaN stay, and so does null."""
    scale = float(10**digits)
    x = x.cast("double")
    p = x * scale
    whole = F.rint(p)  # half to even
    high = SPLIT * x - (SPLIT * x - x)
    error = (high * scale - p) + (x - high) * scale  # exactly x * scale - p
    half = p - whole
    nudged = F.when((half == 0.5) & (error > 0), whole + 1).when((half == -0.5) & (error < 0), whole - 1).otherwise(whole)
    return F.when(F.abs(p) < float(1 << 53), nudged / scale).otherwise(x)
