"""Modelling frames, intervention paths and forecast calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from periodica.operators.filters import replace_zero_negative
from periodica.operators.spine import spine
from periodica.operators.windows import fill_gaps


def intervention_path(day: Column, kind: str, start: Column, end: Column | None = None) -> Column:
    """0/1 path of a pulse, a lasting step or a temporary change."""
    if kind == "pulse":
        hit = day == start
    elif kind == "step":
        hit = day >= start
    elif kind == "temporary":
        hit = day.between(start, end)
    else:
        raise ValueError(f"unknown intervention {kind!r}")
    return F.when(hit, 1.0).otherwise(0.0)


def future_calendar(df: DataFrame, key: str, period: str, steps: int, unit: str) -> DataFrame:
    """The ``steps`` periods after each series' last one."""
    last = df.groupBy(key).agg(F.max(period).alias("_l"))
    end = {"day": F.date_add("_l", steps), "week": F.date_add("_l", steps * 7)}.get(unit)
    if end is None:
        months = {"month": 1, "quarter": 3, "year": 12}[unit]
        end = F.add_months("_l", months * steps)
    dates = spine(F.col("_l"), end, unit)
    return last.select(key, F.posexplode(F.slice(dates, 2, steps)).alias("step", period)).withColumn("step", F.col("step") + 1)


def future_values(calendar: DataFrame, regressors: DataFrame, on: list[str]) -> DataFrame:
    """Regressor values on the future calendar; absent ones stay NULL."""
    return calendar.join(regressors, on, "left")


def modelling_frame(df: DataFrame, key: str, period: str, value: str, start: Column, end: Column, drop_zero: bool, drop_negative: bool, fill: str | None) -> DataFrame:
    """Range cut, zero and negative rules, inner gap fill."""
    cut = df.where(F.col(period).between(start, end)).withColumn(
        value, replace_zero_negative(value, "missing" if drop_zero else "none", "missing" if drop_negative else "none"))
    return cut if fill is None else fill_gaps(cut, [key], period, value, fill, value)


def common_bounds(df: DataFrame, key: str, period: str, value: str, group: list[str]) -> DataFrame:
    """First and last period on which every series of a group has a value; groups without one have no row."""
    members = df.select(*group, key).distinct().groupBy(*group).agg(F.count(F.lit(1)).alias("_all"))
    full = df.where(F.col(value).isNotNull()).groupBy(*group, period).agg(F.countDistinct(key).alias("_n"))
    full = full.join(members, group).where(F.col("_n") == F.col("_all"))
    return full.groupBy(*group).agg(F.min(period).alias("first_period"), F.max(period).alias("last_period"))


def forecast_calendar(model: DataFrame, observed: DataFrame, key: str, period: str, training_end: Column, steps: int, unit: str) -> DataFrame:
    """Model dates, later observed dates and the extension after both."""
    known = model.select(key, period).unionByName(observed.where(F.col(period) > training_end).select(key, period)).distinct()
    ahead = future_calendar(known, key, period, steps, unit).select(key, period)
    phase = F.when(F.col(period) <= training_end, "training").otherwise("holdout")
    return known.withColumn("phase", phase).unionByName(ahead.withColumn("phase", F.lit("extension")))
