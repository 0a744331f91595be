"""Numbers that come out alike in Spark and in SQL databases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(amount: Column) -> Column:
    """A double amount as decimal(18,2)."""
    return amount.cast("decimal(18,2)")


def histogram_bin(x: Column, low: float, high: float, n: int) -> Column:
    """Bin 1 to n of equal widths; 0 below, n + 1 from high on."""
    return F.width_bucket(x, F.lit(low), F.lit(high), F.lit(n))
