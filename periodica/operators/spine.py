"""Calendar spines and calendar lags over long frames.

The frames here hold one row per (key, period), so a key is never longer than
the calendar it covers and window frames over it stay bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from periodica.functions.calendar import last_complete_month, month_index
from periodica.functions.measures import growth_pct

MONTH_STEP = {"month": 1, "quarter": 3, "year": 12}
DAY_STEP = {"day": 1, "week": 7}


def period_number(period: Column | str, unit: str) -> Column:
    """Integer ordinal whose differences are calendar distances in ``unit``."""
    p = F.col(period) if isinstance(period, str) else period
    if unit in MONTH_STEP:
        return F.floor(month_index(p) / MONTH_STEP[unit]).cast("long")
    return F.floor(F.unix_date(p) / DAY_STEP[unit]).cast("long")


def spine(first: Column, last: Column, unit: str) -> Column:
    """Array of period dates from ``first`` to ``last``; month-based units give period ends."""
    if unit in DAY_STEP:
        return F.sequence(first, last, F.expr(f"interval {DAY_STEP[unit]} day"))
    starts = F.sequence(
        F.trunc(first, "MM"), F.trunc(last, "MM"), F.expr(f"interval {MONTH_STEP[unit]} month")
    )
    return F.transform(starts, lambda d: F.last_day(d))


def on_spine(df: DataFrame, keys: list[str], period: str, unit: str) -> DataFrame:
    """Every period between a key's first and last, absent ones with NULL values."""
    bounds = df.groupBy(*keys).agg(F.min(period).alias("_a"), F.max(period).alias("_b"))
    grid = bounds.select(*keys, F.explode(spine(F.col("_a"), F.col("_b"), unit)).alias(period))
    return grid.join(df, [*keys, period], "left")


def calendar_lag(keys: list[str], period: str, value: Column | str, k: int, unit: str = "month") -> Column:
    """Value of the period exactly ``k`` units before, NULL when it is absent.

    A value-range frame finds the period by its ordinal: one sort of the key,
    no self join, and a missing period never lets another row stand in.
    """
    v = F.col(value) if isinstance(value, str) else value
    w = Window.partitionBy(*keys).orderBy(period_number(period, unit)).rangeBetween(-k, -k)
    return F.first(v).over(w)


def calendar_growth(keys: list[str], period: str, value: str, k: int, unit: str = "month") -> Column:
    return growth_pct(F.col(value), calendar_lag(keys, period, value, k, unit))


def duplicate_periods(df: DataFrame, keys: list[str], period: str, unit: str) -> DataFrame:
    """Keys and ordinals that hold more than one row (an error for lag operators)."""
    return (
        df.groupBy(*keys, period_number(period, unit).alias("period_no"))
        .agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    )


def complete_months(df: DataFrame, day: str, today: Column | None = None) -> DataFrame:
    """Rows up to the last complete month of the whole frame."""
    cutoff = df.agg(F.max(day).alias("d")).select(last_complete_month("d", today)).scalar()
    return df.where(F.col(day) <= cutoff)


def last_complete_by_key(df: DataFrame, keys: list[str], day: str, value: str, today: Column | None = None) -> DataFrame:
    """Last complete month of every key's valid observations."""
    return (
        df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max(day).alias("observed_through"))
        .withColumn("cutoff", last_complete_month("observed_through", today))
    )


def common_last_month(df: DataFrame, keys: list[str], day: str, value: str, today: Column | None = None) -> DataFrame:
    """Earliest of the keys' last complete months."""
    return last_complete_by_key(df, keys, day, value, today).agg(F.min("cutoff").alias("common_month"))


def all_valid_last_month(df: DataFrame, day: str, value: str, members: int) -> DataFrame:
    """Last complete month over the days on which every member has a value."""
    full = df.where(F.col(value).isNotNull()).groupBy(day).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == members)
    return full.agg(F.max(day).alias("d")).select(last_complete_month("d").alias("common_month"))


def report_month(df: DataFrame, group: str, frequency: str, day: str, value: str, today: Column) -> DataFrame:
    """Latest month any group supports; a month-based group may not use the current one."""
    top = (
        df.where(F.col(value).isNotNull() & (F.col(day) <= today))
        .groupBy(group, frequency).agg(F.max(day).alias("d"))
    )
    high = F.col(frequency).isin("daily", "weekly", "ten_day")
    month = F.when(high, last_complete_month("d", today)).otherwise(
        F.when(F.trunc("d", "MM") == F.trunc(today, "MM"), F.last_day(F.add_months("d", -1))).otherwise(F.last_day("d"))
    )
    return top.agg(F.max(month).alias("report_month"))


def complete_weeks(first_week: Column, observed: Column) -> Column:
    """Mondays of whole weeks that end inside the last complete month."""
    monday = F.trunc(observed, "WEEK")
    last_week = F.when(observed >= F.date_add(monday, 6), monday).otherwise(F.date_sub(monday, 7))
    weeks = F.sequence(first_week, F.greatest(first_week, last_week), F.expr("interval 7 day"))
    return F.filter(weeks, lambda w: (F.date_add(w, 6) <= last_complete_month(observed)) & (w <= last_week))
