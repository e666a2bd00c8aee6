"""Price chains, revenue estimates and search-index smoothing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from periodica.functions.measures import growth_pct, zscore
from periodica.operators import windows as win
from periodica.operators.spine import calendar_growth, calendar_lag, complete_months, on_spine, period_number


def chained_yoy(df: DataFrame, keys: list[str], period: str, official: str, monthly_change: str, index: str, base: str) -> DataFrame:
    """Official figure, else twelve compounded monthly changes, else the index ratio in one base year."""
    w = Window.partitionBy(*keys).orderBy(period_number(period, "month")).rangeBetween(-11, 0)
    m = F.col(monthly_change)
    chained = F.when(F.count(m).over(w) == 12, F.round((F.product(1 + m / 100).over(w) - 1) * 100, 2))
    prior = calendar_lag([*keys, base], period, index, 12)
    by_index = F.round(growth_pct(F.col(index), prior), 2)
    return df.withColumn("_c", chained).withColumn("_i", by_index).select(
        *keys, period, F.coalesce(F.col(official), F.col("_c"), F.col("_i")).alias("yoy"),
        F.when(F.col(official).isNotNull(), "official").when(F.col("_c").isNotNull(), "compounded").when(F.col("_i").isNotNull(), "index").alias("basis"))


def revenue_estimate(prices: DataFrame, output: DataFrame, keys: list[str], day: str, price: str, period: str, volume: str, scale: float = 1e8) -> DataFrame:
    """Monthly price times the volume of each series times days, with year-on-year and year-to-date figures."""
    known = complete_months(prices.where(F.col(price).isNotNull()), day)
    p = known.groupBy(F.last_day(day).alias("period")).agg(F.avg(price).alias("price"))
    v = output.where(F.col(volume).isNotNull()).groupBy(*keys, F.last_day(period).alias("period")).agg(F.avg(volume).alias("volume"))
    rows = on_spine(v, keys, "period", "month").join(p, "period", "left")
    days = F.dayofmonth("period")
    rows = rows.withColumn("days", days).withColumn("revenue", F.col("price") * F.col("volume") * days / scale)
    rows = rows.withColumn("ytd", win.year_to_date(keys, "period", "revenue"))
    out = rows.select(
        *keys, "period", "price", "volume", "days", "revenue", calendar_growth(keys, "period", "revenue", 12).alias("yoy"), "ytd",
        calendar_growth(keys, "period", "ytd", 12).alias("ytd_yoy"))
    return out.where("revenue is not null")


def _fit_rows(width: int, degree: int = 2) -> list[list[float]]:
    """Row i holds the weights that evaluate the fitted polynomial at position i."""
    a = np.vander(np.arange(width, dtype=float), degree + 1)
    return (a @ np.linalg.pinv(a)).tolist()


def smooth(df: DataFrame, keys: list[str], period: str, value: str, name: str, width: int = 7) -> DataFrame:
    """Local quadratic smoothing; the ends use the fit of the first and last window.

    Series shorter than the width use the largest odd window they hold; very
    short or constant series are returned unchanged. Each row sees at most
    ``2 * width`` neighbours.
    """
    valid = df.where(F.col(value).isNotNull())
    w, whole = win.over(keys, period), Window.partitionBy(*keys)
    rows = (
        valid.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(whole))
        .withColumn("_flat", F.min(value).over(whole) == F.max(value).over(whole))
        .withColumn("_near", F.collect_list(F.col(value).cast("double")).over(w.rowsBetween(-(width - 1), width - 1))))
    odd = F.least(F.lit(width), F.col("_n").cast("int"))
    rows = rows.withColumn("_w", odd - F.when(odd % 2 == 0, 1).otherwise(0))
    start = F.greatest(F.lit(0), F.least(F.col("_i") - F.floor(F.col("_w") / 2).cast("int"), (F.col("_n") - F.col("_w")).cast("int")))
    rows = rows.withColumn("_s", start.cast("int"))
    offset = F.col("_s") - F.greatest(F.lit(0), F.col("_i") - (width - 1)) + 1
    picked = F.slice("_near", offset.cast("int"), F.col("_w"))
    pos = (F.col("_i") - F.col("_s")).cast("int")
    tables = {k: F.lit(_fit_rows(k)) for k in range(3, width + 1, 2)}
    weights: Column | None = None
    for k, table in tables.items():
        one = table[pos]
        weights = F.when(F.col("_w") == k, one) if weights is None else weights.when(F.col("_w") == k, one)
    fitted = F.aggregate(F.zip_with(picked, weights, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    keep = (F.col("_w") < 3) | F.col("_flat")
    return rows.withColumn(name, F.when(keep, F.col(value).cast("double")).otherwise(fitted)).drop("_i", "_n", "_flat", "_near", "_w", "_s")


def search_index(df: DataFrame, keys: list[str], period: str, value: str, from_year: int) -> DataFrame:
    """Smoothed and standardised index beside the raw one."""
    s = smooth(df.where(F.year(period) >= from_year), keys, period, value, "smoothed")
    whole = Window.partitionBy(*keys)
    z = zscore(F.col("smoothed"), F.avg("smoothed").over(whole), F.stddev_samp("smoothed").over(whole))
    return s.withColumn("standardised", z)


def timeline_months(df: DataFrame, stamp: str, key: str, value: str, partial: str, today: Column) -> DataFrame:
    """Monthly means per keyword without partial points and without the running month."""
    month = F.trunc(F.to_date(F.timestamp_seconds(stamp)), "MM")
    v = F.col(value).try_cast("double")
    good = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) & ~F.coalesce(F.lower(F.col(partial)) == "true", F.lit(False))
    return df.where(good & (month < F.trunc(today, "MM"))).groupBy(month.alias("month"), key).agg(F.avg(v).alias("value"))
