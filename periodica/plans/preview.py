"""Indicator summaries and seasonal bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from periodica.functions import calendar as cal
from periodica.functions.measures import change_by_rule, difference_rule


def _last_in(value: str, period: str, test: Column) -> Column:
    hit = test & F.col(value).isNotNull()
    return F.max_by(F.when(hit, F.col(value)), F.when(hit, F.col(period)))


def summary(df: DataFrame, key: str, period: str, value: str, frequency: str, unit: str, kind: str) -> DataFrame:
    """Latest value of each indicator with its reference values and growth.

    A reference comes from its own calendar window only; an empty window stays
    missing and never borrows an older value. One shuffle by indicator.
    """
    p, f, cur = F.col(period), F.col(frequency), F.col("_cur")
    rows = df.where(F.col(value).isNotNull()).withColumn("_cur", F.max(period).over(Window.partitionBy(key)))
    ten_start = F.when(F.dayofmonth(cur) > 20, F.date_add(F.trunc(cur, "MM"), 10)).when(
        F.dayofmonth(cur) > 10, F.trunc(cur, "MM")).otherwise(F.date_add(F.trunc(F.add_months(F.trunc(cur, "MM"), -1), "MM"), 20))
    ten_end = F.when(F.dayofmonth(cur) > 20, F.date_add(F.trunc(cur, "MM"), 19)).when(
        F.dayofmonth(cur) > 10, F.date_add(F.trunc(cur, "MM"), 9)).otherwise(F.date_sub(F.trunc(cur, "MM"), 1))
    months = cal.month_index(cur) - cal.month_index(p)
    quarters = (F.year(cur) - F.year(p)) * 4 + F.quarter(cur) - F.quarter(p)
    years = F.year(cur) - F.year(p)
    previous = (
        ((f == "daily") & (p == F.date_sub(cur, 1))) | ((f == "weekly") & (p == F.date_sub(cur, 7)))
        | ((f == "ten_day") & p.between(ten_start, ten_end)) | ((f == "monthly") & (months == 1))
        | ((f == "quarterly") & (quarters == 1)) | ((f == "yearly") & (years == 1)))
    same = ((f == "monthly") & (months == 12)) | ((f == "quarterly") & (quarters == 4)) | ((f == "yearly") & (years == 1))
    back = lambda n: F.avg(F.when((f == "daily") & (p >= F.date_sub(cur, n)) & (p < cur), F.col(value)))
    out = rows.groupBy(key, frequency, unit, kind).agg(
        F.max(period).alias("latest_period"), F.max_by(value, period).alias("latest"),
        _last_in(value, period, previous).alias("previous"), _last_in(value, period, same).alias("same_last_year"),
        back(7).alias("mean_7"), back(30).alias("mean_30"),
        _last_in(value, period, (f == "yearly") & (years == 2)).alias("two_years_ago"),
        _last_in(value, period, (f == "yearly") & (years == 3)).alias("three_years_ago"),
    )
    diff = difference_rule(unit, kind)
    plain = lambda c: F.when(diff, F.col("latest") - c).when(c != 0, (F.col("latest") - c) / F.when(c != 0, c))
    sized = lambda c: change_by_rule(F.col("latest"), c, diff)
    signed = f.isin("monthly", "quarterly")
    return out.withColumn(
        "growth_previous", F.when(f == "yearly", None).when(signed, plain(F.col("previous"))).otherwise(sized(F.col("previous")))
    ).withColumn("growth_year", F.when(signed, plain(F.col("same_last_year"))).otherwise(sized(F.col("same_last_year"))))


SEASON_KEYS = {
    "daily": (F.year, cal.leap_day_of_year), "weekly": (cal.iso_year, F.weekofyear),
    "ten_day": (F.year, cal.ten_day_index), "monthly": (F.year, F.month), "quarterly": (F.year, F.quarter),
}


def seasonal_band(df: DataFrame, key: str, period: str, value: str, frequency: str, current_year: Column | int, years: int = 5) -> DataFrame:
    """Range and mean of each season over the years before last year, with the last two years beside it."""
    year_of, season_of = SEASON_KEYS[frequency]
    y, now = year_of(F.col(period)).cast("int"), F.lit(current_year) if isinstance(current_year, int) else current_year
    rows = df.where(F.col(value).isNotNull()).select(key, season_of(F.col(period)).cast("int").alias("season"), y.alias("_y"), period, value)
    hist = F.col("_y").between(now - 1 - years, now - 2)
    v = F.col(value)
    pick = lambda test: F.max_by(F.when(test, v), F.when(test, F.col(period)))
    return rows.groupBy(key, "season").agg(
        F.min(F.when(hist, v)).alias("hist_min"), F.max(F.when(hist, v)).alias("hist_max"), F.avg(F.when(hist, v)).alias("hist_mean"),
        pick(F.col("_y") == now).alias("current"), pick(F.col("_y") == now - 1).alias("previous"))
