"""Window operators over long frames with one row per (key, period)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from periodica.functions.calendar import month_index
from periodica.functions.measures import growth_pct


def over(keys: list[str], order: str | Column) -> Window:
    return Window.partitionBy(*keys).orderBy(order)


def row_growth(keys: list[str], order: str, value: str, periods: int) -> Column:
    return growth_pct(F.col(value), F.lag(value, periods).over(over(keys, order)))


def trailing_sum(keys: list[str], order: str, value: str, rows: int) -> Column:
    return F.sum(value).over(over(keys, order).rowsBetween(-(rows - 1), 0))


def full_window_avg(keys: list[str], order: str, value: str, rows: int) -> Column:
    """Rolling mean that needs every one of its rows."""
    w = over(keys, order).rowsBetween(-(rows - 1), 0)
    return F.when(F.count(value).over(w) == rows, F.avg(value).over(w))


def full_window_count(keys: list[str], order: str, test: Column, valid: Column, rows: int) -> Column:
    """Rolling number of rows passing ``test``, NULL while any row is missing."""
    w = over(keys, order).rowsBetween(-(rows - 1), 0)
    known = F.count(F.when(valid, 1)).over(w)
    return F.when(known == rows, F.count(F.when(test, 1)).over(w))


def prior_mean(keys: list[str], order: str, value: str, minimum: int) -> Column:
    """Mean of all earlier rows once there are ``minimum`` of them."""
    w = over(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return F.when(F.count(value).over(w) >= minimum, F.avg(value).over(w))


def positive_streak(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """Length of the current run of positive rows; missing stays missing and breaks it."""
    w = over(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    pos = F.coalesce(F.col(value) > 0, F.lit(False))
    out = df.withColumn("_breaks", F.sum(F.when(pos, 0).otherwise(1)).over(w))
    run = over([*keys, "_breaks"], order).rowsBetween(Window.unboundedPreceding, 0)
    count = F.sum(F.when(pos, 1).otherwise(0)).over(run)
    return out.withColumn(name, F.when(F.col(value).isNotNull(), count)).drop("_breaks")


def year_to_date(keys: list[str], period: str, value: str) -> Column:
    w = Window.partitionBy(*keys, F.year(period)).orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    return F.when(F.col(value).isNotNull(), F.sum(value).over(w))


def abs_rank(within: list[str], value: str) -> Column:
    """1 for the largest size; equal sizes share the smallest rank."""
    return F.rank().over(Window.partitionBy(*within).orderBy(F.abs(value).desc_nulls_last()))


def cumulative_to_current(keys: list[str], order: str, value: str) -> Column:
    w = over(keys, order)
    return F.when(F.row_number().over(w) == 1, F.col(value)).otherwise(F.col(value) - F.lag(value).over(w))


def ytd_to_month(keys: list[str], period: str, value: str) -> Column:
    """January keeps its value; a month without the month before it is NULL."""
    w = over(keys, period)
    step = month_index(period) - F.lag(month_index(period)).over(w)
    return F.when(F.month(period) == 1, F.col(value)).when(step == 1, F.col(value) - F.lag(value).over(w))


def newest_change(df: DataFrame, keys: list[str], period: str, value: str) -> DataFrame:
    """Newest and previous valid values with their ratio and point change."""
    valid = df.where(F.col(value).isNotNull())
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(period).desc()))
    two = valid.withColumn("_rn", rn).where("_rn <= 2")
    out = two.groupBy(*keys).agg(
        F.max(F.when(F.col("_rn") == 1, F.col(period))).alias("latest_period"),
        F.max(F.when(F.col("_rn") == 1, F.col(value))).alias("latest"),
        F.max(F.when(F.col("_rn") == 2, F.col(value))).alias("previous"),
    )
    return out.withColumn("change_pct", growth_pct("latest", "previous")).withColumn(
        "change_points", F.col("latest") - F.col("previous")
    )


def change_since_days(df: DataFrame, keys: list[str], period: str, value: str, days: int) -> DataFrame:
    """Newest valid value against the last one at least ``days`` older."""
    valid = df.where(F.col(value).isNotNull())
    top = valid.groupBy(*keys).agg(F.max(period).alias("latest_period"), F.max_by(value, period).alias("latest"))
    old = F.col(period) <= F.date_sub("latest_period", days)
    joined = valid.join(top, keys)
    return (
        joined.groupBy(*keys, "latest_period", "latest")
        .agg(F.max_by(F.when(old, F.col(value)), F.when(old, F.col(period))).alias("base"))
        .withColumn("change_pct", growth_pct("latest", "base"))
    )


def date_intervals(df: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Contiguous runs of distinct days."""
    days = df.where(F.col(day).isNotNull()).select(*keys, day).distinct()
    island = F.date_sub(F.col(day), F.row_number().over(over(keys, day)))
    return (
        days.withColumn("_g", island).groupBy(*keys, "_g")
        .agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count(F.lit(1)).alias("days")).drop("_g")
    )


def extreme_labels(df: DataFrame, within: list[str], label: str, order: str, value: str) -> DataFrame:
    """Largest positive and most negative part per row set; the first in order wins ties."""
    v = F.col(value)
    up, down = v > 0, v < 0
    return df.groupBy(*within).agg(
        F.max_by(F.when(up, F.col(label)), F.when(up, F.struct(v, -F.col(order)))).alias("top_positive"),
        F.max(F.when(up, v)).alias("top_positive_value"),
        F.min_by(F.when(down, F.col(label)), F.when(down, F.struct(v, F.col(order)))).alias("top_negative"),
        F.min(F.when(down, v)).alias("top_negative_value"),
    )


YOY_LAG = {"yearly": 1, "monthly": 12, "quarterly": 4, "weekly": 52, "ten_day": 36}  # fixed values


def transform_series(keys: list[str], order: str, value: str, transformation: str, frequency: str = "monthly") -> Column:
    """Row-lag difference transforms; a value that is not positive has no log and fails the job."""
    w = over(keys, order)
    x = F.col(value)
    log = F.when(x > 0, F.ln(x)).when(x.isNotNull(), F.raise_error(F.lit("logs need positive values")).cast("double"))
    if transformation in ("yoy_diff", "log_yoy_diff"):
        if frequency not in YOY_LAG:
            raise ValueError(f"no year lag for frequency {frequency!r}")
        k = YOY_LAG[frequency]
        base = x if transformation == "yoy_diff" else log
        return base - F.lag(base, k).over(w)
    if transformation == "level":
        return x
    if transformation == "log":
        return log
    if transformation == "diff":
        return x - F.lag(x, 1).over(w)
    if transformation == "second_diff":
        return x - 2 * F.lag(x, 1).over(w) + F.lag(x, 2).over(w)
    if transformation == "log_diff":
        return log - F.lag(log, 1).over(w)
    raise ValueError(f"unknown transformation {transformation!r}")


def fill_gaps(df: DataFrame, keys: list[str], order: str, value: str, method: str, name: str) -> DataFrame:
    """Fill missing rows between a key's first and last valid ones only."""
    if method not in ("ffill", "bfill", "linear"):
        raise ValueError(f"unknown fill {method!r}")
    w = over(keys, order)
    whole = Window.partitionBy(*keys)
    pos = F.when(F.col(value).isNotNull(), F.col("_i"))
    out = df.withColumn("_i", F.row_number().over(w))
    out = out.withColumn("_a", F.min(pos).over(whole)).withColumn("_b", F.max(pos).over(whole))
    inner = F.col("_i").between(F.col("_a"), F.col("_b"))
    known = F.struct(F.col(value).alias("v"), F.col("_i").alias("i"))
    seen = F.when(F.col(value).isNotNull(), known)
    if method in ("ffill", "linear"):
        out = out.withColumn("_p", F.last(seen, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if method in ("bfill", "linear"):
        # A growing frame over the reversed order looks ahead in linear time.
        back = over(keys, F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("_q", F.last(seen, ignorenulls=True).over(back))
    if method == "ffill":
        filled = F.col("_p.v")
    elif method == "bfill":
        filled = F.col("_q.v")
    else:
        gap = F.col("_q.i") - F.col("_p.i")
        filled = F.col("_p.v") + (F.col("_q.v") - F.col("_p.v")) * ((F.col("_i") - F.col("_p.i")) / F.when(gap != 0, gap))
    return out.withColumn(name, F.coalesce(F.col(value), F.when(inner, filled))).drop("_i", "_a", "_b", "_p", "_q")
