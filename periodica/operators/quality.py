"""Data-quality checks and versioned-history rules.

Checks return small frames of failures or named results; ``require`` turns a
non-empty failure frame into an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from periodica.operators.joins import lost_keys, null_safe_on
from periodica.operators.spine import spine


class QualityError(ValueError):
    """A data rule is broken."""


def require(failures: DataFrame, message: str) -> None:
    first = failures.limit(1).collect()
    if first:
        raise QualityError(f"{message}: {first[0].asDict()}")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def null_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys]))


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Incoming rows replace stored ones as a whole, but a missing value never does.

    Value and provenance move together; history the batch does not cover is
    kept. Incoming keys must be present and unique.
    """
    require(null_keys(incoming, keys), "incoming keys must not be null")
    require(duplicate_keys(incoming, keys), "incoming keys must be unique")
    return upsert_rule(stored, incoming, keys, value)


def upsert_rule(stored: DataFrame, incoming: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """The merge rule alone, as one aggregation over both sides."""
    rest = [c for c in stored.columns if c not in keys]
    row = F.struct(*rest)
    both = stored.select(*keys, row.alias("_r"), F.lit(0).alias("_new")).unionByName(
        incoming.select(*keys, F.struct(*rest).alias("_r"), F.lit(1).alias("_new")))
    old = F.max(F.when(F.col("_new") == 0, F.struct(F.lit(True).alias("on"), F.col("_r").alias("r"))))
    new = F.max(F.when(F.col("_new") == 1, F.struct(F.lit(True).alias("on"), F.col("_r").alias("r"))))
    merged = both.groupBy(*keys).agg(old.alias("_o"), new.alias("_n"))
    take_new = F.col("_n").isNotNull() & (F.col("_o").isNull() | F.col(f"_n.r.{value}").isNotNull() | F.col(f"_o.r.{value}").isNull())
    return merged.withColumn("_r", F.when(take_new, F.col("_n.r")).otherwise(F.col("_o.r"))).select(*keys, "_r.*")


def dictionary_upsert(stored: DataFrame, incoming: DataFrame, key: str, retired: DataFrame | None = None) -> DataFrame:
    """Incoming dictionary rows replace stored ones; retired names are dropped from the batch."""
    if retired is not None:
        incoming = incoming.join(retired.select(key), key, "left_anti")
    rest = [c for c in stored.columns if c != key]
    both = stored.withColumn("_o", F.lit(0)).unionByName(incoming.withColumn("_o", F.lit(1)))
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), "_o").alias("_r")).select(key, "_r.*")


def missing_periods(df: DataFrame, keys: list[str], period: str, unit: str) -> DataFrame:
    """Periods between a key's first and last that it does not hold."""
    have = df.select(*keys, period).distinct()
    bounds = have.groupBy(*keys).agg(F.min(period).alias("_a"), F.max(period).alias("_b"))
    grid = bounds.select(*keys, F.explode(spine(F.col("_a"), F.col("_b"), unit)).alias(period))
    return grid.join(have, [*keys, period], "left_anti")


def history_failures(before: DataFrame, after: DataFrame, keys: list[str], numeric: list[str]) -> DataFrame:
    """Keys that vanished and numbers that turned into NULL."""
    lost = lost_keys(before, after, keys).withColumn("problem", F.lit("key_removed"))
    o, n = before.alias("o"), after.alias("n")
    erased = reduce(lambda a, b: a | b, [F.col(f"o.{c}").isNotNull() & F.col(f"n.{c}").isNull() for c in numeric])
    same = reduce(lambda a, b: a & b, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])
    gone = o.join(n, same).where(erased).select(*[F.col(f"o.{k}").alias(k) for k in keys], F.lit("value_erased").alias("problem"))
    return lost.unionByName(gone)


def guard_history(before: DataFrame, after: DataFrame, keys: list[str], numeric: list[str]) -> None:
    require(history_failures(before, after, keys, numeric), "history must not shrink")


def check_report(df: DataFrame, keys: list[str], period: str, value: str, as_of: Column, fresh_months: int, low: float, high: float, minimum: int) -> DataFrame:
    """Named checks over every series as (keys, check, passed, detail) rows.

    One aggregation reads the data once; periods are few and checked on it.
    """
    per = df.groupBy(*keys, F.last_day(period).alias("p")).agg(
        F.count(F.lit(1)).alias("n"), F.count(value).alias("v"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.countDistinct(period).alias("d"))
    one = per.groupBy(*keys).agg(
        F.min("p").alias("first"), F.max("p").alias("last"), F.count(F.lit(1)).alias("months"), F.sum("n").alias("rows"),
        F.sum("v").alias("values"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("d").alias("days"))
    span = F.months_between("last", "first").cast("long") + 1
    lag = F.months_between(F.last_day(as_of), F.col("last")).cast("long")
    checks = [
        ("history_length", F.col("months") >= minimum, F.col("months")),
        ("monthly_continuity", F.col("months") == span, span - F.col("months")),
        ("fresh", lag.between(0, fresh_months), lag),
        ("value_range", (F.col("lo") >= low) & (F.col("hi") <= high), F.col("rows") - F.col("values")),
        ("unique_periods", F.col("rows") == F.col("days"), F.col("rows") - F.col("days")),
    ]
    packed = F.array(*[F.struct(F.lit(n).alias("check"), ok.alias("passed"), d.cast("long").alias("detail")) for n, ok, d in checks])
    return one.select(*keys, F.inline(packed))


def closure_breaks(parts: DataFrame, total: DataFrame, period: str, value: str, tolerance: float) -> DataFrame:
    """Periods whose parts miss the total by more than the published rounding."""
    s = parts.groupBy(period).agg(F.sum(value).alias("parts"))
    return s.join(total, period).withColumn("residual", F.col("total") - F.col("parts")).where(F.abs("residual") > tolerance)


def latest_vintage(df: DataFrame, keys: list[str], vintage: list[str], value: str) -> DataFrame:
    """Newest vintage per key with a flag for revised keys."""
    keep = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(
        F.max_by(F.struct(*keep), F.struct(*vintage)).alias("_r"),
        (F.min(value) != F.max(value)).alias("_rev"),
    ).select(*keys, "_r.*", F.coalesce("_rev", F.lit(False)).alias("revised"))


def combine_sources(primary: DataFrame, secondary: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Primary wins; shows where only the secondary has a row and where they disagree."""
    a = primary.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_ha"))
    b = secondary.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_hb"))
    j = a.join(b, keys, "full")
    return j.select(
        *keys, F.when(F.col("_ha"), F.col("_a")).otherwise(F.col("_b")).alias(value),
        F.col("_ha").isNull().alias("secondary_only"),
        (F.col("_ha").isNotNull() & F.col("_hb").isNotNull() & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("conflict"),
    )


def unanimous(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The one distinct value of a key; NULL when its records disagree."""
    return df.groupBy(*keys).agg(F.when(F.min(value) == F.max(value), F.min(value)).alias(value))


def first_source(df: DataFrame, keys: list[str], rank: str, keep: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(F.struct(rank, *keep), rank).alias("_r")).select(*keys, "_r.*")


def with_reason(df: DataFrame, rules: list[tuple[Column, str]]) -> DataFrame:
    """First broken rule as ``reason``; NULL for good rows."""
    chain = None
    for broken, text in rules:
        b = F.coalesce(broken, F.lit(True))
        chain = F.when(b, text) if chain is None else chain.when(b, text)
    return df.withColumn("reason", chain)


def quarantine(df: DataFrame, rules: list[tuple[Column, str]]) -> tuple[DataFrame, DataFrame]:
    tagged = with_reason(df, rules)
    return tagged.where("reason is null").drop("reason"), tagged.where("reason is not null")


def gap_audit(stored: DataFrame, node: str, day: str, first: Column, last: Column, verified: DataFrame, now: Column, ttl_days: int) -> DataFrame:
    """Expected cells, stored ones, and missing ones split by fresh verification.

    ``verified`` rows are (node, first_gap, last_gap, checked_at).
    """
    have = stored.where(F.col(day).between(first, last)).select(node, day).distinct()
    grid = stored.select(node).distinct().withColumn(day, F.explode(F.sequence(first, last, F.expr("interval 1 day"))))
    missing = grid.join(have, [node, day], "left_anti")
    age = F.unix_timestamp(now) - F.unix_timestamp("checked_at")
    fresh = verified.where((age >= 0) & (age < ttl_days * 86400)).select(
        node, F.explode(F.sequence("first_gap", "last_gap", F.expr("interval 1 day"))).alias(day), F.lit(True).alias("_ok")).distinct()
    m = missing.join(fresh, [node, day], "left").groupBy(node).agg(
        F.count(F.lit(1)).alias("missing"), F.count_if(F.coalesce("_ok", F.lit(False))).alias("source_missing"))
    per = grid.groupBy(node).agg(F.count(F.lit(1)).alias("expected")).join(m, node, "left").fillna(0, ["missing", "source_missing"])
    unverified = F.col("missing") - F.col("source_missing")
    return per.select(
        node, "expected", (F.col("expected") - F.col("missing")).alias("stored"), "source_missing", unverified.alias("unverified_missing"),
        F.when(unverified > 0, "unverified_gaps").when(F.col("missing") > 0, "source_gaps").otherwise("complete").alias("status"))


def continuous_sampling(runs: DataFrame, stamp: str, ok: Column, start: Column, end: Column, max_gap: int, chunk: str | None = None) -> DataFrame:
    """True when all runs in the window are good, gaps are short and both ends are covered."""
    inside = runs.where((F.col(stamp) >= start - F.make_dt_interval(secs=F.lit(max_gap))) & (F.col(stamp) <= end))
    hour = F.date_trunc("hour", F.col(stamp))
    w = Window.partitionBy("_h").orderBy(stamp)
    sec = lambda c: F.unix_micros(c) / 1e6
    r = inside.withColumn("_h", hour).withColumn("_gap", sec(F.col(stamp)) - sec(F.lag(stamp).over(w)))
    per = r.groupBy("_h").agg(F.min(stamp).alias("a"), F.max(stamp).alias("b"), F.max("_gap").alias("g"), F.bool_and(ok).alias("ok"))
    along = Window.orderBy("_h")  # one row per hour
    per = per.withColumn("g", F.greatest("g", sec(F.col("a")) - sec(F.lag("b").over(along))))
    s = per.agg(F.min("a").alias("a"), F.max("b").alias("b"), F.max("g").alias("g"), F.bool_and("ok").alias("ok"))
    good = (F.col("a") <= start) & (F.col("b") >= end - F.make_dt_interval(secs=F.lit(max_gap))) & (F.coalesce("g", F.lit(0.0)) <= max_gap) & F.col("ok")
    return s.select(F.coalesce(good, F.lit(False)).alias("continuous"), F.col("g").alias("largest_gap"))


def progress_summary(df: DataFrame, table: str, stamp: str) -> DataFrame:
    return df.agg(F.lit(table).alias("source"), F.count(F.lit(1)).alias("rows"), F.max(stamp).alias("latest"))


def progress_failures(before: DataFrame, after: DataFrame) -> DataFrame:
    """Tables that shrank or whose newest date went back."""
    b = before.select("source", F.col("rows").alias("rows_before"), F.col("latest").alias("latest_before"))
    j = b.join(after, "source", "left")
    return j.select(
        "source", F.when(F.coalesce("rows", F.lit(0)) < F.col("rows_before"), "fewer_rows")
        .when(F.col("latest_before").isNotNull() & F.coalesce(F.col("latest") < F.col("latest_before"), F.lit(True)), "date_regressed").alias("problem")
    ).where("problem is not null")


def validate_series(df: DataFrame, keys: list[str], value: str, minimum: int) -> DataFrame:
    """One verdict per series: too few values, no spread, infinite, or fine."""
    v = F.col(value).cast("double")
    clean = F.when(~F.isnan(v), v)
    out = df.groupBy(*keys).agg(
        F.count(clean).alias("valid"), F.var_samp(clean).alias("variance"), F.count_if(F.abs(clean) == float("inf")).alias("infinite"))
    return out.select(*keys, "valid", F.when(F.col("infinite") > 0, "infinite").when(F.col("valid") < minimum, "insufficient_data")
                      .when((F.col("valid") > 1) & (F.coalesce("variance", F.lit(0.0)) == 0), "no_variance").otherwise("ok").alias("verdict"))


def all_or_nothing(df: DataFrame, node: str, day: str, first: Column, last: Column, nodes: Column, fetched: str, oldest: Column) -> DataFrame:
    """The window's rows if every cell is there and the last day is fresh, else none."""
    rows = df.where(F.col(day).between(first, last))
    cells = rows.select(node, day).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    freshest = rows.where(F.col(day) == last).agg(F.min(fetched).alias("f")).scalar()
    gate = (cells == nodes * (F.datediff(last, first) + 1)) & (freshest >= oldest)
    return rows.where(F.coalesce(gate, F.lit(False)))


def newest_source(df: DataFrame, source: str, period: str) -> DataFrame:
    """The source file that holds the newest observation; names break ties."""
    per = df.groupBy(source).agg(F.max(period).alias("newest"))
    return per.agg(F.max_by(F.struct(source, "newest"), F.struct(F.col("newest"), F.col(source))).alias("_r")).select("_r.*")


def processing_log(parts: list[tuple[str, DataFrame]], columns: list[str]) -> DataFrame:
    """Side outputs of several steps as one (step, variable, detail) table."""
    return reduce(lambda a, b: a.unionByName(b), [d.select(F.lit(step).alias("step"), *columns) for step, d in parts])


def measurement_issues(df: DataFrame, rules: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Reason for each measurement that a dated exclusion rule covers."""
    r = rules.select(*keys, "from_day", "to_day", "reason")
    hit = F.col(day).between(F.col("from_day"), F.col("to_day"))
    j = df.join(r, keys, "left")
    cols = df.columns
    return j.groupBy(*cols).agg(F.min(F.when(hit, F.col("reason"))).alias("reason"))
