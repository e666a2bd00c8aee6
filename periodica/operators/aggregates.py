"""Aggregations over node-day facts, reports and transactions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from periodica.functions import calendar as cal
from periodica.functions.measures import (
    complete_sum, finite, min_max_index, ratio, valid_total, weighted_pressure,
)
from periodica.operators import chunked
from periodica.operators.spine import complete_months


def check_unique(df: DataFrame, keys: list[str], label: str) -> None:
    """Raise when a natural key repeats; reads one aggregated row."""
    if df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        raise ValueError(f"{label}: duplicate rows for {keys}")


def daily_totals(df: DataFrame, day: str, metrics: list[str], nodes: Column | int) -> DataFrame:
    """Per-day totals, NULL unless every node reports a valid value."""
    return df.groupBy(day).agg(*[valid_total(m, nodes).alias(m) for m in metrics])


def window_total(df: DataFrame, day: str, metric: str, start: Column, end: Column, nodes: Column | int) -> DataFrame:
    """Total over all node-day cells of a window, NULL when a cell is missing."""
    cells = (F.datediff(end, start) + 1) * nodes
    inside = df.where(F.col(day).between(start, end))
    return inside.agg(complete_sum(metric, cells).alias("total"))


def bucket_sums(df: DataFrame, keys: list[str], day: str, metrics: list[str], unit: str) -> DataFrame:
    """Calendar bucket sums clipped to each key's own first and last day.

    A bucket is complete when it has one valid row for each of its clipped
    days; otherwise the sum is NULL.
    """
    start = cal.bucket_start(day, unit)
    per = df.groupBy(*keys, start.alias("bucket")).agg(
        F.count(F.lit(1)).alias("_n"), F.countDistinct(day).alias("_d"),
        F.min(day).alias("_a"), F.max(day).alias("_b"),
        *[F.count_if(finite(m) >= 0).alias(f"_v_{m}") for m in metrics],
        *[F.sum(finite(m)).alias(f"_s_{m}") for m in metrics],
    )
    bounds = per.groupBy(*keys).agg(F.min("_a").alias("_first"), F.max("_b").alias("_last"))
    if keys:
        out = per.join(bounds, keys)
    else:
        edge = bounds.select(F.struct("_first", "_last").alias("e")).scalar()
        out = per.withColumn("_e", edge).withColumn("_first", F.col("_e._first")).withColumn("_last", F.col("_e._last"))
    out = out.withColumn("period_start", F.greatest("bucket", "_first")).withColumn(
        "period_end", F.least(cal.bucket_end("bucket", unit), F.col("_last"))
    )
    days = F.datediff("period_end", "period_start") + 1
    sums = [F.when((F.col("_n") == days) & (F.col(f"_v_{m}") == days), F.col(f"_s_{m}")).alias(m) for m in metrics]
    return out.select(*keys, "bucket", "period_start", "period_end", *sums, (F.col("_n") > F.col("_d")).alias("duplicate_days"))


def bucket_spine(first: Column, last: Column, unit: str) -> Column:
    step = {"day": "1 day", "week": "7 day", "month": "1 month", "year": "12 month"}[unit]
    return F.sequence(cal.bucket_start(first, unit), last, F.expr(f"interval {step}"))


def distinct_by_region(df: DataFrame, match: Column, unit: str) -> DataFrame:
    """Distinct vessels per (bucket, region); NULL where the region was not observed.

    Buckets and regions form a dense grid between the first and last day.
    """
    rows = df.withColumn("bucket", cal.bucket_start(F.to_date("observed"), unit))
    ids = rows.groupBy("bucket", "region", "mmsi").agg(F.max(match).alias("_m"))
    seen = ids.groupBy("bucket", "region").agg(F.count_if(F.coalesce("_m", F.lit(False))).alias("vessels"))
    edge = seen.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    grid = (
        seen.select("region").distinct()
        .withColumn("_e", edge.select(F.struct("a", "b").alias("e")).scalar())
        .select("region", F.explode(bucket_spine(F.col("_e.a"), F.col("_e.b"), unit)).alias("bucket"))
    )
    return grid.join(seen, ["bucket", "region"], "left")


def distinct_by_class(df: DataFrame, match: Column, unit: str, known: list[str]) -> DataFrame:
    """Distinct vessels per bucket under the class of their latest report."""
    rows = df.where(match).withColumn("bucket", cal.bucket_start(F.to_date("observed"), unit))
    last = rows.groupBy("bucket", "mmsi").agg(F.max_by("category", F.struct("observed", "event_id")).alias("c"))
    kind = F.when(F.col("c").isin(known), F.col("c")).otherwise("other_unknown")
    return last.groupBy("bucket", kind.alias("kind")).agg(F.count(F.lit(1)).alias("vessels"))


def last_sample_stock(df: DataFrame, unit: str, minutes: int = 120) -> DataFrame:
    """Vessels present at the last sample of each bucket, by region.

    A day's sample holds the ids seen within ``minutes`` of its newest report;
    later sampled days of a bucket replace the earlier ones.
    """
    rows = df.withColumn("day", F.to_date("observed"))
    anchor = rows.groupBy("day").agg(F.max("observed").alias("anchor"))
    keep = anchor.withColumn("bucket", cal.bucket_start("day", unit)).groupBy("bucket").agg(
        F.max("day").alias("day"), F.max_by("anchor", "day").alias("anchor")
    )
    # Only the hours of a sample meet it; the other reports of a day find no partner and go no further.
    since = F.greatest(F.col("anchor") - F.expr(f"interval {minutes} minutes"), F.col("day").cast("timestamp"))
    hours = keep.withColumn("since", since).withColumn("hour", F.explode(F.sequence(F.date_trunc("hour", "since"), F.date_trunc("hour", "anchor"), F.expr("interval 1 hour")))).drop("day")
    fresh = rows.withColumn("hour", F.date_trunc("hour", "observed")).join(hours, "hour").where(F.col("observed") >= F.col("since"))
    last = fresh.groupBy("bucket", "anchor", "mmsi").agg(F.max_by("region", F.struct("observed", "event_id")).alias("region"))
    return last.groupBy("bucket", F.col("anchor").alias("sample_at"), "region").agg(F.count(F.lit(1)).alias("vessels"))


def status_counters(df: DataFrame) -> DataFrame:
    """Moving, stopped and class counters over the newest state of each vessel."""
    known = ["tanker", "cargo"]
    return df.agg(
        F.count_if(F.col("sog") >= 0.5).alias("moving"),
        F.count_if(F.col("sog") < 0.5).alias("stopped"),
        F.count_if(F.col("category") == "tanker").alias("tankers"),
        F.count_if(F.col("category") == "cargo").alias("cargo"),
        F.count_if(~F.coalesce(F.col("category"), F.lit("")).isin(known)).alias("other"),
        F.count_if(F.col("flag") == "CN").alias("flag_cn"),
    )


def monthly_two_sources(left: DataFrame, right: DataFrame, day: str, left_cols: list[str], right_cols: list[str]) -> DataFrame:
    """Monthly sums of two daily facts cut at their common last complete month."""
    ends = left.agg(F.max(day).alias("d")).unionByName(right.agg(F.max(day).alias("d"))).where("d is not null")
    cutoff = ends.agg(F.min(cal.last_complete_month("d")).alias("c")).scalar()
    monthly = lambda df, cols: df.where(F.col(day) <= cutoff).groupBy(F.last_day(day).alias("period")).agg(
        *[F.sum(x).alias(x) for x in cols]
    )
    return monthly(left, left_cols).join(monthly(right, right_cols), "period", "left")


def monthly_sales(df: DataFrame, day: str, by: list[str], amount: str) -> DataFrame:
    return complete_months(df, day).groupBy(F.last_day(day).alias("period"), *by).agg(
        F.count(F.lit(1)).alias("sales"), F.sum(amount).cast("double").alias("amount")
    )


# fixed values: kilograms per unit
WEIGHT_UNITS = {"LB": 0.45359237, "KG": 1.0}


def converted_with_total(df: DataFrame, period: Column, by: str, value: Column, unit: Column) -> DataFrame:
    """Tonnes per group plus an ``all`` row, both from one rollup."""
    kg = value
    for name, factor in WEIGHT_UNITS.items():
        if factor != 1.0:
            kg = F.when(unit == name, value * factor).otherwise(kg)
    rows = df.select(period.alias("period"), F.col(by).alias("_g"), (kg / 1000.0).alias("_t"))
    out = rows.rollup("period", "_g").agg(F.sum("_t").alias("tonnes"), F.grouping_id().alias("_level"))
    return out.where("_level < 2").select(
        "period", F.when(F.col("_level") == 1, "all").otherwise(F.col("_g")).alias(by), "tonnes"
    )


def first_appearance(df: DataFrame, ident: Column, month: Column, blank: list[str] = ["", "0"]) -> DataFrame:
    """Each id counted once, in its earliest month."""
    first = (
        df.select(F.trim(ident.cast("string")).alias("id"), month.alias("month"))
        .where(F.col("month").isNotNull() & F.col("id").isNotNull() & ~F.col("id").isin(blank))
        .groupBy("id").agg(F.min("month").alias("month"))
    )
    return first.groupBy("month").agg(F.count(F.lit(1)).alias("new_ids"))


def split_future(df: DataFrame, month: Column, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Rows up to the reference month, and the quarantined later ones."""
    late = F.coalesce(F.trunc(month, "MM") > F.trunc(as_of, "MM"), F.lit(False))
    return df.where(~late), df.where(late)


def sums_with_sources(df: DataFrame, period: str, measures: list[str], source: str) -> DataFrame:
    return df.groupBy(period).agg(
        *[F.sum(F.coalesce(F.col(m), F.lit(0.0))).alias(m) for m in measures],
        F.concat_ws(";", F.array_sort(F.collect_set(source))).alias("sources"),
    )


def monthly_events(df: DataFrame, day: str, weapons: list[str], flags: list[str]) -> DataFrame:
    """Daily event facts to full months, with a 0..100 intensity index.

    ``df`` holds one row per day.
    """
    cut = complete_months(df, day)
    a, b, u = (F.col(w) for w in weapons)
    monthly = (
        cut.groupBy(F.last_day(day).alias("period")).agg(
            *[F.sum(w).alias(w) for w in weapons],
            F.sum(weighted_pressure(a, b, u)).alias("intensity_log"),
            *[F.count_if(F.col(f)).alias(f"{f}_days") for f in flags],
            F.count(F.lit(1)).alias("observed_days"),
        )
        .where(F.col("observed_days") >= F.dayofmonth("period"))
    )
    edge = monthly.agg(F.struct(F.min("intensity_log").alias("lo"), F.max("intensity_log").alias("hi")).alias("e")).scalar()
    return monthly.withColumn("_e", edge).withColumn(
        "intensity_index", min_max_index(F.col("intensity_log"), F.col("_e.lo"), F.col("_e.hi"))
    ).drop("_e")


def merge_same_day(df: DataFrame, day: str, counts: list[str], flags: list[str], published: str, keep: list[str]) -> DataFrame:
    """Several records of a day to one: per-field maximum, flags OR-ed, best record kept.

    Days without a record between the first and the last are added as zero.
    """
    total = reduce(lambda a, b: a + b, [F.col(c) for c in counts])
    merged = df.groupBy(day).agg(
        *[F.max(c).alias(c) for c in counts],
        *[F.bool_or(f).alias(f) for f in flags],
        F.max_by(F.struct(*keep), F.struct(total, F.coalesce(F.col(published), F.lit("")))).alias("_best"),
        F.lit("observed").alias("status"),
    )
    edge = merged.agg(F.min(day).alias("a"), F.max(day).alias("b"))
    grid = edge.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias(day))
    out = grid.join(merged, day, "left")
    return out.select(
        day, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts],
        *[F.coalesce(F.col(f), F.lit(False)).alias(f) for f in flags],
        *[F.col(f"_best.{k}").alias(k) for k in keep],
        F.coalesce("status", F.lit("no_record")).alias("status"),
    )


def quarterly_day_weighted(df: DataFrame, keys: list[str], period: str, value: str) -> DataFrame:
    """Mean of month values weighted by their days, for quarters with three months."""
    days = F.dayofmonth(F.last_day(period))
    return (
        df.groupBy(*keys, cal.quarter_end(period).alias("quarter"))
        .agg(F.count(value).alias("_n"), (F.sum(F.col(value) * days) / F.sum(days)).alias("value"))
        .where("_n = 3").drop("_n")
    )


def monthly_mean(df: DataFrame, keys: list[str], day: str, value: str, common: bool = False) -> DataFrame:
    """Mean of daily values over complete months; optionally cut at the last month all keys share."""
    valid = df.where(F.col(value).isNotNull())
    cut = valid.groupBy(*keys).agg(cal.last_complete_month(F.max(day)).alias("_c"))
    means = (
        valid.join(cut, keys).where(F.col(day) <= F.col("_c"))
        .groupBy(*keys, F.last_day(day).alias("period")).agg(F.avg(value).alias("value"))
    )
    if not common:
        return means
    members = df.select(*keys).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    shared = means.groupBy("period").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == members)
    return means.where(F.col("period") <= shared.agg(F.max("period").alias("p")).scalar())


def expected_points(start: Column, end: Column, frequency: Column) -> Column:
    """Number of periods a gapless series would hold."""
    months = cal.month_index(end) - cal.month_index(start)
    ten = (F.year(end) - F.year(start)) * 36 + cal.ten_day_index(end) - cal.ten_day_index(start) + 1
    return (
        F.when(frequency == "daily", F.datediff(end, start) + 1)
        .when(frequency == "weekly", F.floor(F.datediff(end, start) / 7) + 1)
        .when(frequency == "ten_day", ten)
        .when(frequency == "monthly", months + 1)
        .when(frequency == "quarterly", (F.year(end) - F.year(start)) * 4 + F.quarter(end) - F.quarter(start) + 1)
        .when(frequency == "yearly", F.year(end) - F.year(start) + 1)
        .otherwise(0)
    )


def completeness(df: DataFrame, keys: list[str], period: str, value: str, frequency: str) -> DataFrame:
    """First and last valid period, valid and expected counts, percent missing."""
    valid = df.where(F.col(value).isNotNull())
    out = valid.groupBy(*keys, frequency).agg(
        F.min(period).alias("first_period"), F.max(period).alias("last_period"), F.count(F.lit(1)).alias("valid")
    )
    out = out.withColumn("expected", expected_points(F.col("first_period"), F.col("last_period"), F.col(frequency)).cast("long"))
    return out.withColumn("missing_pct", F.when(F.col("expected") > 0, (F.col("expected") - F.col("valid")) / F.col("expected") * 100).otherwise(0.0))


def dictionary_counts(df: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """Indicators per value of each attribute, each indicator once, in one pass."""
    once = df.groupBy(key).agg(*[F.first(a).alias(a) for a in attributes])
    filled = once.select(key, *[F.coalesce(F.col(a), F.lit("unclassified")).alias(a) for a in attributes])
    sets = [[F.col(a)] for a in attributes]
    out = filled.groupingSets(sets, *[F.col(a) for a in attributes]).agg(F.count(F.lit(1)).alias("indicators"))
    chosen = F.coalesce(*[F.when(F.col(a).isNotNull(), F.lit(a)) for a in attributes])
    return out.select(chosen.alias("attribute"), F.coalesce(*[F.col(a) for a in attributes]).alias("label"), "indicators")


FREQUENCY_DAYS = {"daily": 1, "weekly": 7, "ten_day": 10, "monthly": 30, "quarterly": 90, "yearly": 365}  # fixed values


def raw_variable_stats(df: DataFrame, key: str, period: str, value: str, frequency: str) -> DataFrame:
    """Share of missing points where zero counts as missing."""
    good = F.col(value).isNotNull() & (F.col(value) != 0)
    out = df.groupBy(key, frequency).agg(
        F.count_if(good).alias("valid"), F.min(F.when(good, F.col(period))).alias("first_period"),
        F.max(F.when(good, F.col(period))).alias("last_period"),
    )
    step = F.create_map(*[F.lit(x) for kv in FREQUENCY_DAYS.items() for x in kv])[F.col(frequency)]
    expected = F.greatest(F.lit(1), F.ceil((F.datediff("last_period", "first_period") + 1) / step))
    missing = F.greatest(F.lit(0), expected - F.col("valid")) / expected * 100
    return out.withColumn("missing_pct", F.when(F.col("valid") > 0, missing).otherwise(100.0))


def coverage_card(df: DataFrame, node: str, day: str, metric: str, nodes: Column | int) -> DataFrame:
    """This week's known total and how much of the node-day grid it covers."""
    end = df.agg(F.max(day).alias("d")).scalar()
    week = df.where(F.col(day).between(F.trunc(end, "WEEK"), end))
    cells = week.groupBy(node, day).agg(
        F.max(metric).alias("v"), F.countDistinct(metric).alias("_k"),
    )
    known = F.count("v")
    return cells.agg(
        F.min(day).alias("_a"), F.sum("v").alias("known_total"), known.alias("known_cells"), F.max("_k").alias("_k")
    ).withColumn("expected_cells", (F.datediff(end, F.trunc(end, "WEEK")) + 1) * nodes).select(
        F.trunc(end, "WEEK").alias("week_start"), end.alias("week_end"), "known_total", "known_cells", "expected_cells",
        (F.col("known_cells") / F.col("expected_cells") * 100).alias("coverage_pct"),
        (F.coalesce(F.col("_k"), F.lit(0)) > 1).alias("conflict"),
    )


def cohort_shares(df: DataFrame, fields: list[str], total: str) -> DataFrame:
    """Totals and shares over the nodes that are valid on every field."""
    ok = reduce(lambda a, b: a & b, [F.coalesce(finite(f) >= 0, F.lit(False)) for f in [total, *fields]])
    out = df.where(ok).agg(F.count(F.lit(1)).alias("cohort"), F.sum(total).alias(total), *[F.sum(f).alias(f) for f in fields])
    return out.select("*", *[(ratio(f, total) * 100).alias(f"{f}_share") for f in fields])


def group_sums(parts: DataFrame, attributes: DataFrame, key: str, period: str, group: str, value: str) -> DataFrame:
    """Contributions added up by an attribute of the indicator."""
    return parts.join(attributes, key).groupBy(period, group).agg(
        F.coalesce(F.sum(value), F.lit(0.0)).alias("contribution")
    )


def impact_rollup(df: DataFrame, by: str, impact: str) -> DataFrame:
    """Sum, count, positive and negative parts, and share of the absolute total."""
    v = F.col(impact)
    whole = df.agg(F.sum(F.abs(v)).alias("a")).scalar()
    out = df.groupBy(by).agg(
        F.sum(v).alias("total"), F.avg(v).alias("mean"), F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.when(v > 0, v)), F.lit(0.0)).alias("positive"),
        F.coalesce(F.sum(F.when(v < 0, v)), F.lit(0.0)).alias("negative"),
    )
    return out.withColumn("share_pct", F.when(whole > 0, F.abs(F.col("total").cast("double")) / whole.cast("double") * 100).otherwise(0.0))


def rank_by_size(df: DataFrame, keys: list[str], value: str, tie: str, name: str) -> DataFrame:
    """Position by falling absolute value, whole keys never sorted in one task.

    Sizes fall into fine logarithmic bands; rows are ordered inside a band and
    the few bands are ordered along the key.
    """
    size = F.abs(F.col(value).cast("double"))
    band = F.when(size > 0, -F.floor(F.log2(size) * 16)).otherwise(F.lit(1000000))
    banded = df.withColumn("_band", band.cast("long")).withColumn("_size", F.coalesce(-size, F.lit(0.0)))
    return chunked.row_number(banded, keys, "_band", ["_size", tie], name).drop("_band", "_size")


def movement_counts(df: DataFrame, keys: list[str], group: str, period: str, value: str) -> DataFrame:
    """Members of each group that rose or fell between the last two periods."""
    top = df.select(period).distinct().orderBy(F.col(period).desc()).limit(2)
    last = top.agg(F.struct(F.max(period).alias("b"), F.min(period).alias("a")).alias("e")).scalar()
    p = F.col(period)
    change = df.where((p == last["a"]) | (p == last["b"])).groupBy(*keys, group).agg(
        (F.sum(F.when(p == last["b"], F.col(value))) - F.sum(F.when(p == last["a"], F.col(value)))).alias("d")
    )
    return change.groupBy(group).agg(
        F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down"), F.count("d").alias("compared")
    )


def dictionary_coverage(df: DataFrame, keys: list[str], period: str, value: str, frequency: str, as_of: Column) -> DataFrame:
    """First and last valid period, the low-frequency end capped at the last whole period."""
    valid = df.where(F.col(value).isNotNull())
    out = valid.groupBy(*keys, frequency).agg(F.min(period).alias("first_period"), F.max(period).alias("last_period"))
    return out.withColumn("last_period", F.least("last_period", cal.last_complete_period(as_of, frequency)))


def pivot_indicators(df: DataFrame, period: str, name: str, value: str, names: list[str]) -> DataFrame:
    """Wide table by month end; the column list is given, so no extra pass reads it."""
    return df.groupBy(F.last_day(period).alias("period")).pivot(name, names).agg(F.first(value))


def fill_by_identity(part: Column, total: Column, other: Column) -> Column:
    """An unpublished part follows from the total and the other part."""
    return F.coalesce(part, total - other)
