"""Score arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def score32(num: Column, den: Column) -> Column:
    """Percent truncated in 32-bit float arithmetic; 0 when nothing was scored.

    Spark divides floats as doubles, so the quotient is cast back.
    """
    ratio = (num.cast("float") / F.nullif(den, F.lit(0)).cast("float")).cast("float")
    pct = (ratio * F.lit(100).cast("float")).cast("float").cast("int")
    return F.coalesce(pct, F.lit(0))


def score64(num: Column, den: Column) -> Column:
    """Percent truncated in 64-bit arithmetic, as the audit shows it."""
    pct = (num.cast("double") / F.nullif(den, F.lit(0)).cast("double") * F.lit(100.0)).cast("int")
    return F.coalesce(pct, F.lit(0))
