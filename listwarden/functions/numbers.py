"""Rounding rules, guarded rates and number formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(value: Column, decimals: int = 0) -> Column:
    return F.bround(value, decimals)


def half_up(value: Column) -> Column:
    return F.floor(value + F.lit(0.5))


def rate(part: Column, whole: Column) -> Column:
    """part / whole where an empty whole gives 0.0, never null."""
    return part.cast("double") / F.greatest(F.lit(1), whole).cast("double")


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def percent_text(value: Column, decimals: int = 1, missing: str = "–") -> Column:
    text = F.format_string(f"%.{decimals}f %%", half_even(value * 100.0, decimals))
    return F.when(value.isNull(), missing).otherwise(text)
