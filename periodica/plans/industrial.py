"""Weighted and profit contributions, cumulative conversions and ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from periodica.functions.measures import ratio
from periodica.operators import windows as win
from periodica.operators.joins import nearest_prior, weight_for_year
from periodica.operators.quality import QualityError
from periodica.operators.spine import calendar_lag


def _mask(period: str):
    return ~F.month(period).isin(1, 2)


def cumulative_yoy(df: DataFrame, keys: list[str], period: str, value: str) -> DataFrame:
    """Percent and point change against the nearest date a year before; January and February masked."""
    out = nearest_prior(df, keys, period, value)
    v, p = F.col(value), F.col("prior")
    return out.withColumn("yoy", F.when(_mask(period), (v - p) / F.when(p != 0, p) * 100)).withColumn("yoy_diff", F.when(_mask(period), v - p))


def weighted_contributions(growth: DataFrame, weights: DataFrame, key: str, period: str, value: str) -> DataFrame:
    """Growth times the weight of the latest weight year; unweighted indicators drop out."""
    have = growth.join(weights.select(key).distinct(), key, "left_semi")
    return weight_for_year(have, weights, key, period).withColumn("contribution", F.col(value) * F.col("weight"))


def contribution_check(parts: DataFrame, total: DataFrame, period: str, tolerance: float = 0.5) -> DataFrame:
    """Per period: sum of contributions, the total and whether they agree."""
    s = parts.groupBy(period).agg(F.coalesce(F.sum("contribution"), F.lit(0.0)).alias("contribution_sum"))
    return total.join(s, period, "left").withColumn("difference", F.col("contribution_sum") - F.col("total")).withColumn(
        "passed", F.abs("difference") <= tolerance)


def sector_contributions(overall: DataFrame, weights: DataFrame, members: DataFrame, key: str, period: str, sector: str) -> DataFrame:
    """Overall growth of a sector times the summed weights of its members.

    ``overall`` is (period, sector, growth); a sector of ``members`` without
    its own growth series is an error, there is no substitute.
    """
    lacking = members.select(sector).distinct().join(overall.select(sector).distinct(), sector, "left_anti")
    if lacking.limit(1).count():
        raise QualityError("a sector has no overall growth series")
    rows = overall.join(members, sector)
    w = weight_for_year(rows, weights, key, period)
    return w.groupBy(period, sector).agg((F.max("growth") * F.sum("weight")).alias("contribution"))


def profit_contributions(df: DataFrame, key: str, period: str, value: str) -> DataFrame:
    """Change on the year over the total of all industries a year before, March to December."""
    total = df.groupBy(period).agg(F.sum(value).alias("_t")).where("_t <> 0")
    rows = df.join(total, period, "left").where(_mask(period))
    base, base_total = calendar_lag([key], period, value, 12), calendar_lag([key], period, "_t", 12)
    return rows.select(key, period, ((F.col(value) - base) / base_total * 100).alias("contribution"))


def ratio_panel(df: DataFrame, keys: list[str], period: str, profit: str, revenue: str, assets: str, equity: str) -> DataFrame:
    """Return on equity, margin, turnover and leverage from cumulative inputs."""
    out = df.withColumn("_p", win.cumulative_to_current(keys, period, profit)).withColumn("_r", win.cumulative_to_current(keys, period, revenue))
    return out.where(_mask(period)).select(
        *keys, period, (ratio("_p", equity) * 100).alias("roe"), (ratio("_p", "_r") * 100).alias("margin"),
        ratio("_r", assets).alias("turnover"), ratio(assets, equity).alias("leverage"))
