"""Missing-aware aggregates and growth rules, as plain column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def finite(value: Column | str) -> Column:
    """NaN and the infinities become NULL, so they never enter an aggregate."""
    c = as_col(value).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def complete_sum(value: Column | str, n: Column | int) -> Column:
    """Sum of exactly ``n`` rows, NULL when a row or a value is missing."""
    v = as_col(value)
    return F.when((F.count(F.lit(1)) == n) & (F.count(v) == n), F.sum(v))


def complete_sum_of(values: list[Column | str], n: Column | int) -> Column:
    """``complete_sum`` over several fields of the same rows."""
    parts = [complete_sum(v, n) for v in values]
    return reduce(lambda a, b: a + b, parts)


def complete_avg(value: Column | str, n: Column | int) -> Column:
    v = as_col(value)
    return F.when(F.count(v) == n, F.avg(v))


def valid_total(value: Column | str, n: Column | int) -> Column:
    """Sum when exactly ``n`` rows hold a finite, non-negative value."""
    v = finite(value)
    ok = v >= 0
    return F.when(F.count_if(ok) == n, F.sum(F.when(ok, v)))


def sum_at_least(value: Column | str, min_count: int) -> Column:
    """Sum of the present values, NULL with fewer than ``min_count`` of them."""
    v = as_col(value)
    return F.when(F.count(v) >= min_count, F.sum(v))


def row_sum(values: list[Column | str], min_count: int) -> Column:
    """Sum across columns of one row under the same rule."""
    cols = [as_col(v) for v in values]
    present = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    return F.when(present >= min_count, total)


def ratio(top: Column | str, bottom: Column | str) -> Column:
    """Double division with NULL for a zero or missing denominator."""
    b = as_col(bottom).cast("double")
    return as_col(top).cast("double") / F.when(b != 0, b)


def growth_pct(current: Column | str, base: Column | str) -> Column:
    return (ratio(current, base) - 1) * 100


def change_by_rule(current: Column, reference: Column, difference: Column) -> Column:
    """Difference for rate-like series, else growth against the size of the base."""
    return F.when(difference, current - reference).when(
        reference != 0, (current - reference) / F.abs(reference)
    )


def difference_rule(unit: Column | str, kind: Column | str) -> Column:
    """Percent units are compared by difference, operating rates excepted."""
    # fixed values
    percent_unit, operating_rate = "%", "开工率"
    return F.coalesce(as_col(unit) == percent_unit, F.lit(False)) & ~as_col(kind).eqNullSafe(F.lit(operating_rate))


def weighted_pressure(ballistic: Column, cruise: Column, uavs: Column) -> Column:
    """Log-damped weighted count; weights 9, 3 and 1 are fixed values."""
    return 9.0 * F.log1p(ballistic) + 3.0 * F.log1p(cruise) + 1.0 * F.log1p(uavs)


def min_max_index(value: Column, low: Column, high: Column) -> Column:
    return F.when(high == low, F.lit(0.0)).otherwise(100.0 * (value - low) / (F.when(high != low, high - low)))


def zscore(value: Column, mean: Column, sd: Column) -> Column:
    """Standard score; a series without spread is returned unchanged."""
    return F.when(F.coalesce(sd, F.lit(0.0)) == 0, value).otherwise((value - mean) / F.when(sd != 0, sd))


def exact_median(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Exact median per group that no single task has to sort whole.

    Distinct values are pre-counted, an approximate quantile with a known
    rank error brackets the middle, and only the values inside the bracket are
    ranked. The bracket holds about four parts in ten thousand of the group.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    accuracy = 10000
    gap = 2.0 / accuracy
    bracket = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.percentile_approx(value, [0.5 - gap, 0.5 + gap], accuracy).alias("_b"),
        F.count(F.lit(1)).alias("_n"),
    )
    joined = counted.join(
        bracket.select(*keys, F.col("_b")[0].alias("_lo"), F.col("_b")[1].alias("_hi"), "_n"), keys
    )
    below = joined.groupBy(*keys).agg(
        F.sum(F.when(F.col(value) < F.col("_lo"), F.col("_c")).otherwise(0)).alias("_below")
    )
    inside = joined.where((F.col(value) >= F.col("_lo")) & (F.col(value) <= F.col("_hi"))).join(below, keys)
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.withColumn("_to", F.col("_below") + F.sum("_c").over(w)).withColumn(
        "_from", F.col("_to") - F.col("_c") + 1
    )
    left = F.floor((F.col("_n") + 1) / 2)
    right = F.floor(F.col("_n") / 2) + 1
    pick = lambda pos: F.max(F.when((F.col("_from") <= pos) & (F.col("_to") >= pos), F.col(value)))
    return ranked.groupBy(*keys).agg(
        ((pick(left).cast("double") + pick(right).cast("double")) / 2).alias(name)
    )
