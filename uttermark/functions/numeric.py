"""Numeric column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column, scale: int = 0) -> Column:
    """Round half to even."""
    return F.bround(x, scale)
