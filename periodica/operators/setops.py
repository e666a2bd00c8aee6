"""Set operations over keys and rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def shared_bounds(frames: list[tuple[DataFrame, str]]) -> DataFrame:
    """Earliest and latest day over several facts, from one small row each."""
    out = None
    for df, day in frames:
        one = df.agg(F.min(day).alias("a"), F.max(day).alias("b"))
        out = one if out is None else out.unionByName(one)
    return out.agg(F.min("a").alias("first_day"), F.max("b").alias("last_day"))


def lost_rows(before: DataFrame, after: DataFrame, cols: list[str]) -> DataFrame:
    return before.select(*cols).subtract(after.select(*cols))


def bag_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows, with multiplicity, found on one side only; empty means equal bags.

    Counting both sides in one aggregation needs a single shuffle.
    """
    cols = a.columns
    both = a.withColumn("_s", F.lit(1)).unionByName(b.withColumn("_s", F.lit(-1)))
    return both.groupBy(*cols).agg(F.sum("_s").alias("surplus")).where("surplus <> 0")
