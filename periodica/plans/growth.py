"""Growth contributions, price/volume splits and diffusion diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from periodica.functions.measures import growth_pct, ratio
from periodica.operators import windows as win
from periodica.operators.quality import require


def with_total(parts: DataFrame, total: DataFrame, period: str) -> DataFrame:
    return parts.join(total.select(period, "total"), period, "inner")


def additivity(parts: DataFrame, total: DataFrame, period: str, value: str, absolute: float = 1e-6, relative: float = 0.005) -> DataFrame:
    """Residual of the total over the sum of its parts, and whether it is tolerable."""
    s = parts.groupBy(period).agg(F.sum(value).alias("parts"))
    out = s.join(total.select(period, "total"), period).withColumn("residual", F.col("total") - F.col("parts"))
    share = F.abs("residual") / F.when(F.col("total") != 0, F.abs("total"))
    return out.withColumn("within_tolerance", (F.abs("residual") <= absolute) | F.coalesce(share <= relative, F.lit(False)))


def growth_contributions(parts: DataFrame, total: DataFrame, key: str, period: str, value: str, lag: int) -> DataFrame:
    """Level change of each part over the lagged total, in points."""
    if lag <= 0:
        raise ValueError("lag must be positive")
    rows = with_total(parts, total, period)
    w = win.over([key], period)
    base = F.lag("total", lag).over(w)
    return rows.withColumn("lagged_total", base).select(
        key, period, value, "total", "lagged_total",
        ((F.col("total") - base) / F.when(base > 0, base) * 100).alias("total_growth"),
        ((F.col(value) - F.lag(value, lag).over(w)) / F.when(base > 0, base) * 100).alias("contribution"))


def check_positive_base(contributions: DataFrame) -> None:
    require(contributions.where("lagged_total <= 0"), "lagged total must be positive")


def price_volume(df: DataFrame, key: str, period: str, nominal: str, real: str, lag: int = 4) -> DataFrame:
    """Implicit deflator with its growth beside the real growth."""
    d = df.withColumn("deflator", ratio(nominal, real) * 100)
    return d.select(key, period, nominal, real, "deflator",
                    win.row_growth([key], period, real, lag).alias("real_growth"),
                    win.row_growth([key], period, "deflator", lag).alias("deflator_growth"))


def price_volume_quadrant(df: DataFrame, total: DataFrame, key: str, period: str, nominal: str, real: str, members: int, lag: int = 4) -> DataFrame:
    """Growth, deflator growth and share of every industry for periods where all are known."""
    rows = with_total(df, total, period).withColumn("deflator", ratio(nominal, real) * 100)
    out = rows.select(
        key, period, win.row_growth([key], period, real, lag).alias("real_growth"),
        win.row_growth([key], period, "deflator", lag).alias("deflator_growth"), ratio(real, "total").alias("share"))
    full = F.count(F.when(F.col("real_growth").isNotNull() & F.col("deflator_growth").isNotNull() & F.col("share").isNotNull(), 1)).over(Window.partitionBy(period))
    return out.withColumn("_n", full).where(F.col("_n") == members).drop("_n")


def share_breaks(df: DataFrame, period: str, share: str, total: str, relative: float, absolute: float) -> DataFrame:
    """Periods whose shares do not add to one beyond both tolerances."""
    s = df.groupBy(period).agg(F.sum(share).alias("shares"), F.max(total).alias("total"))
    e = F.abs(F.col("shares") - 1)
    return s.where((e > relative) & (e * F.abs("total") > absolute))


def growth_rates(parts: DataFrame, total: DataFrame, key: str, period: str, value: str, lag: int = 4, minimum: int = 8, window: int = 8) -> DataFrame:
    """Per-industry rates with history mean, momentum, streaks, windows and state."""
    k = [key]
    rows = with_total(parts, total, period)
    w = win.over(k, period)
    base = F.lag("total", lag).over(w)
    g = rows.select(
        key, period, win.row_growth(k, period, value, lag).alias("growth"),
        (F.lag(value, lag).over(w) / base).alias("base_share"), ratio(value, "total").alias("share"),
        ((F.col(value) - F.lag(value, lag).over(w)) / base * 100).alias("contribution"),
        ((F.col("total") - base) / base * 100).alias("total_growth"))
    g = g.withColumn("history_mean", win.prior_mean(k, period, "growth", minimum)).withColumn("previous_growth", F.lag("growth").over(w))
    gr = F.col("growth")
    g = (
        g.withColumn("positive", gr > 0).withColumn("above_history", gr > F.col("history_mean"))
        .withColumn("accelerating", gr > F.col("previous_growth"))
        .withColumn("avg_4", win.full_window_avg(k, period, "growth", 4)).withColumn("avg_long", win.full_window_avg(k, period, "growth", window))
        .withColumn("positive_in_4", win.full_window_count(k, period, gr > 0, gr.isNotNull(), 4))
        .withColumn("above_in_window", win.full_window_count(k, period, F.col("above_history"), F.col("above_history").isNotNull(), window))
    )
    g = win.positive_streak(g, k, period, "growth", "streak")
    level, momentum = gr - F.col("history_mean"), gr - F.col("previous_growth")
    known = level.isNotNull() & momentum.isNotNull()
    state = (
        F.when(~known, None).when((level > 0) & (momentum > 0), "high_rising").when((level > 0) & (momentum <= 0), "high_slowing")
        .when((level <= 0) & (momentum > 0), "low_improving").otherwise("low_worsening"))
    return (
        g.withColumn("four_positive", F.when(F.col("positive_in_4").isNotNull(), F.col("positive_in_4") == 4))
        .withColumn("gap_prior_4", gr - F.lag("avg_4").over(w)).withColumn("level_gap", level).withColumn("momentum_gap", momentum).withColumn("state", state))


def breadth(rates: DataFrame, period: str, condition: str, members: int) -> list[Column]:
    """Unweighted and base-share weighted percentage of industries that meet a condition.

    Both are missing unless the condition is known for every industry.
    """
    known = F.count(condition) == members
    shares = F.count(F.when(F.col("base_share").isNotNull(), 1)) == members
    return [
        F.when(known, F.count_if(F.col(condition)) / members * 100).alias(f"{condition}_pct"),
        F.when(known & shares, F.coalesce(F.sum(F.when(F.col(condition), F.col("base_share"))), F.lit(0.0)) * 100).alias(f"{condition}_weighted"),
    ]


def diffusion(rates: DataFrame, period: str, members: int) -> DataFrame:
    conditions = ("positive", "above_history", "accelerating", "four_positive")
    return rates.groupBy(period).agg(*[c for name in conditions for c in breadth(rates, period, name, members)])


def concentration(rates: DataFrame, key: str, period: str, members: int) -> DataFrame:
    """Size-based concentration of contributions, their balance and the main drivers."""
    c = F.col("contribution")
    s = rates.groupBy(period).agg(
        F.count(c).alias("_n"), F.sum(F.abs(c)).alias("movement"), F.sum(c).alias("net"), F.sum(c * c).alias("_sq"), F.max("total_growth").alias("total_growth"),
        F.min_by(F.when(c > 0, F.col(key)), F.when(c > 0, F.struct(-c, F.col(key)))).alias("top_positive"), F.max(F.when(c > 0, c)).alias("top_positive_value"),
        F.min_by(F.when(c < 0, F.col(key)), F.when(c < 0, F.struct(c, F.col(key)))).alias("top_negative"), F.min(F.when(c < 0, c)).alias("top_negative_value"))
    s = s.where((F.col("_n") == members) & (F.col("movement") > 0))
    hhi = F.col("_sq") / (F.col("movement") * F.col("movement"))
    equal = 1.0 / members
    return s.select(
        period, (F.col("net") / F.col("movement") * 100).alias("balance"),
        F.least(F.lit(100.0), F.greatest(F.lit(0.0), (hhi - equal) / (1 - equal) * 100)).alias("concentration"), hhi.alias("hhi"),
        "movement", "total_growth", "top_positive", "top_positive_value", "top_negative", "top_negative_value")
