"""Sorting, previews and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def preview(df: DataFrame, order: list[str], view: str, n: int) -> DataFrame:
    if view == "all":
        return df
    cols = [F.col(c).asc() if view == "head" else F.col(c).desc() for c in order]
    return df.orderBy(*cols).limit(n)


def top_by_latest(df: DataFrame, key: str, period: str, value: str, n: int = 5) -> DataFrame:
    """Whole history of the ``n`` keys that lead in the latest period."""
    latest = df.where(F.col(value).isNotNull()).agg(F.max(period).alias("p")).scalar()
    top = df.where(F.col(period) == latest).orderBy(F.col(value).desc_nulls_last(), key).limit(n).select(key)
    return df.join(top, key, "left_semi")


def pool_others(df: DataFrame, key: str, period: str, share: str, value: str, n: int = 5, other: str = "other") -> DataFrame:
    """Top ``n`` keys by mean share; the rest are summed as one."""
    top = df.groupBy(key).agg(F.avg(share).alias("_a")).orderBy(F.col("_a").desc(), key).limit(n).select(key, F.lit(True).alias("_top"))
    label = F.when(F.col("_top"), F.col(key)).otherwise(F.lit(other))
    return df.join(top, key, "left").groupBy(period, label.alias(key)).agg(F.sum(value).alias(value))


def most_recent_keys(df: DataFrame, key: str, stamp: str, n: int = 1000) -> DataFrame:
    """The ``n`` ids with the newest activity."""
    return df.groupBy(key).agg(F.max(stamp).alias("last_seen")).orderBy(F.col("last_seen").desc(), key).limit(n)


def composite_order(df: DataFrame, has_data: str, value: str, name: str, n: int | None = None) -> DataFrame:
    """Rows with data first, then by falling value, then by name; ``n`` makes it a top-k."""
    out = df.orderBy(F.coalesce(F.col(has_data), F.lit(False)).desc(), F.coalesce(F.col(value), F.lit(0)).desc(), F.col(name))
    return out if n is None else out.limit(n)
