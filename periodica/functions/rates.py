"""Decimal-safe rate conversions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def daily_thousands(annual: Column, year: Column) -> Column:
    """Annual amount to thousands a day, one decimal, half up, by the year's length."""
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    days = F.when(leap, 366).otherwise(365).cast("decimal(3,0)")
    return F.round(annual.cast("decimal(24,0)") / (days * 1000), 1).cast("decimal(24,1)")
