"""Rounding as the map format defines it: half up, on the double itself."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def rounded(value: Column, digits: int = 0) -> Column:
    """``floor(value * 10^digits + 0.5) / 10^digits``. ``round`` would go through the
    decimal text of the double and differs at exact halves."""
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)
