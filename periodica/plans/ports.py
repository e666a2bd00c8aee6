"""Activity windows over node-day facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from periodica.functions.measures import ratio


def _window_sum(test: Column, value: Column, n: Column | int) -> Column:
    """Complete sum inside one window of a wider scan."""
    v = F.when(test, value)
    return F.when((F.count(F.when(test, 1)) == n) & (F.count(v) == n), F.sum(v))


def to_date_activity(df: DataFrame, node: str, day: str, at: Column, calls: str, kinds: list[str]) -> DataFrame:
    """Week-to-date and month-to-date calls of each node, in one pass."""
    d = F.col(day)
    week, month = d.between(F.trunc(at, "WEEK"), at), d.between(F.trunc(at, "MM"), at)
    wn, mn = F.weekday(at) + 1, F.dayofmonth(at)
    out = df.where(d.between(F.least(F.trunc(at, "WEEK"), F.trunc(at, "MM")), at)).groupBy(node).agg(
        F.count(F.when(week, 1)).alias("week_days"), _window_sum(week, F.col(calls), wn).alias("week_calls"),
        _window_sum(month, F.col(calls), mn).alias("month_calls"),
        *[_window_sum(week, F.col(k), wn).alias(f"week_{k}") for k in kinds],
        *[_window_sum(month, F.col(k), mn).alias(f"month_{k}") for k in kinds])
    return out.select("*", *[(ratio(f"week_{k}", "week_calls") * 100).alias(f"week_share_{k}") for k in kinds])


def rolling_activity(df: DataFrame, node: str, day: str, at: Column, days: int, calls: str, imports: str, exports: str) -> DataFrame:
    """Last ``days`` against the ``days`` before them; every figure needs a full window."""
    if days not in (7, 30):
        raise ValueError("only 7 or 30 day windows")
    d = F.col(day)
    now = d.between(F.date_sub(at, days - 1), at)
    before = d.between(F.date_sub(at, 2 * days - 1), F.date_sub(at, days))
    c, i, e = F.col(calls), F.col(imports), F.col(exports)
    s = df.where(d.between(F.date_sub(at, 2 * days - 1), at)).groupBy(node).agg(
        F.count(F.when(now, 1)).alias("observed_days"), F.count(F.when(before, 1)).alias("previous_observed_days"),
        _window_sum(now, c, days).alias("calls"), _window_sum(before, c, days).alias("previous_calls"),
        _window_sum(now, (c > 0).cast("int"), days).alias("active_days"),
        _window_sum(now, ((c > 0) & (i + e == 0)).cast("int"), days).alias("idle_cargo_days"),
        _window_sum(now, i, days).alias("imports"), _window_sum(now, e, days).alias("exports"))
    trade = F.col("imports") + F.col("exports")
    return s.select(
        "*", (F.col("calls") / days).alias("avg_calls"), (trade / days).alias("avg_handled"),
        (F.when(F.col("calls").isNotNull(), F.col("active_days")) / days * 100).alias("active_day_rate"), (trade / F.when(F.col("calls") != 0, F.col("calls"))).alias("cargo_per_call"),
        ((F.col("exports") - F.col("imports")) / F.when(trade != 0, trade) * 100).alias("trade_balance"),
        (F.col("calls") / F.when(F.col("previous_calls") != 0, F.col("previous_calls")) * 100).alias("activity_index"))


def comparison_windows(at: Column) -> Column:
    """Last week, the week before, month to date, prior month clipped, same month last year clipped."""
    monday, month = F.trunc(at, "WEEK"), F.trunc(at, "MM")
    prior, year = F.add_months(month, -1), F.add_months(month, -12)
    clip = lambda first: F.least(F.last_day(first), F.date_add(first, F.dayofmonth(at) - 1))
    w = lambda name, a, b: F.struct(F.lit(name).alias("window"), a.alias("first"), b.alias("last"))
    return F.array(
        w("last_week", F.date_sub(monday, 7), F.date_sub(monday, 1)), w("week_before", F.date_sub(monday, 14), F.date_sub(monday, 8)),
        w("month_to_date", month, at), w("prior_month", prior, clip(prior)), w("same_month_last_year", year, clip(year)))


def window_totals(df: DataFrame, node: str, day: str, metric: str, at: Column, nodes: Column | int) -> DataFrame:
    """Total of all nodes in each comparison window; NULL when a cell is missing.

    Days are summed first, so the windows meet one small row per day.
    """
    daily = df.where(F.col(day).between(F.add_months(F.trunc(at, "MM"), -13), at)).groupBy(day).agg(
        F.countDistinct(node).alias("_k"), F.count(metric).alias("_n"), F.sum(metric).alias("_s"))
    rows = daily.withColumn("_w", F.explode(comparison_windows(at))).where(F.col(day).between(F.col("_w.first"), F.col("_w.last")))
    span = F.datediff(F.max("_w.last"), F.max("_w.first")) + 1
    full = (F.count(F.lit(1)) == span) & (F.min("_n") == nodes) & (F.max("_n") == nodes)
    return rows.groupBy(F.col("_w.window").alias("window"), F.col("_w.first").alias("first_day"), F.col("_w.last").alias("last_day")).agg(
        F.when(full, F.sum("_s")).alias("total"))
