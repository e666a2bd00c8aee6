"""Row filters and value-replacement rules."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from periodica.functions import calendar as cal
from periodica.functions.measures import as_col
from periodica.session import cut_lineage

COMPARISONS = {
    "≥": lambda a, b: a >= b, "≤": lambda a, b: a <= b, ">": lambda a, b: a > b,
    "<": lambda a, b: a < b, "=": lambda a, b: a == b, "≠": lambda a, b: a != b,
}


def compare(column: Column | str, op: str, value: float) -> Column:
    if op not in COMPARISONS:
        raise ValueError(f"unknown comparison {op!r}")
    c = as_col(column)
    if op == "≠":  # a missing value is unequal to any number
        return ~c.eqNullSafe(F.lit(value))
    return F.coalesce(COMPARISONS[op](c, F.lit(value)), F.lit(False))


def last_periods(df: DataFrame, period: str, n: int) -> DataFrame:
    """Rows of the last ``n`` distinct periods of the frame."""
    first = df.select(period).distinct().orderBy(F.col(period).desc()).limit(n).agg(F.min(period).alias("p")).scalar()
    return df.where(F.col(period) >= first)


def period_bounds(text: str, unit: str) -> tuple[Column, Column]:
    """'2001', '2001-05', '2001Q2' or a date to its first and last day."""
    if unit == "year":
        start = F.lit(f"{int(text[:4])}-01-01").cast("date")
    elif unit == "quarter":
        start = F.lit(f"{int(text[:4])}-{(int(text[-1]) - 1) * 3 + 1:02d}-01").cast("date")
    elif unit == "month":
        start = F.lit(f"{text[:7]}-01").cast("date")
    else:
        day = F.lit(text).cast("date")
        return day, day
    return start, cal.bucket_end(start, unit)


def custom_window(df: DataFrame, period: str, start: str, end: str, unit: str) -> DataFrame:
    a, b = period_bounds(start, unit)[0], period_bounds(end, unit)[1]
    return df.where(F.col(period).between(a, b))


def trailing_years(df: DataFrame, period: str, years: int) -> DataFrame:
    """Rows from the frame's newest date back ``years`` years, inclusive."""
    newest = df.agg(F.max(period).alias("p")).scalar()
    return df.where(F.col(period) >= F.add_months(newest, -12 * years))


def month_span(df: DataFrame, period: str, first: str | None, last: str) -> DataFrame:
    """Months ``first`` to ``last`` ('YYYY-MM') inclusive, whatever the day."""
    m = F.trunc(period, "MM")
    keep = m <= F.lit(f"{last}-01").cast("date")
    return df.where(keep if first is None else keep & (m >= F.lit(f"{first}-01").cast("date")))


def rolling_window(df: DataFrame, day: str, months: int | None) -> DataFrame:
    """Trailing calendar window of the frame; ``None`` means the last seven days."""
    edge = df.agg(F.struct(F.max(day).alias("b"), F.min(day).alias("a")).alias("e")).scalar()
    start = cal.week_window_start(edge["b"], edge["a"]) if months is None else cal.window_start(edge["b"], months, edge["a"])
    return df.where(F.col(day) >= start)


def in_windows(df: DataFrame, day: str, windows: dict[str, int | None], name: str = "window") -> DataFrame:
    """Each row once for every trailing window (name to months; ``None``: seven days) that holds it.

    All window starts come from one pass over the days, the rows from a second.
    """
    edge = df.agg(F.struct(F.max(day).alias("b"), F.min(day).alias("a")).alias("e")).scalar()
    start = lambda m: cal.week_window_start(edge["b"], edge["a"]) if m is None else cal.window_start(edge["b"], m, edge["a"])
    held = [F.when(F.col(day) >= start(m), F.lit(n)) for n, m in windows.items()]
    return df.withColumn(name, F.explode(F.array_compact(F.array(*held))))


def trim_to_valid(df: DataFrame, keys: list[str], period: str, values: list[str]) -> DataFrame:
    """Rows from the first to the last with any valid value; inner gaps stay."""
    any_valid = reduce(lambda a, b: a | b, [F.col(v).isNotNull() for v in values])
    w = Window.partitionBy(*keys)
    p = F.when(any_valid, F.col(period))
    out = df.withColumn("_a", F.min(p).over(w)).withColumn("_b", F.max(p).over(w))
    return out.where(F.col(period).between(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def replace_zero_negative(value: Column | str, zero: str = "none", negative: str = "none") -> Column:
    """``missing`` turns the value into NULL, ``adjust`` into 1, ``none`` keeps it."""
    v = as_col(value)
    if zero != "none":
        v = F.when(v == 0, F.lit(None) if zero == "missing" else F.lit(1.0)).otherwise(v)
    if negative != "none":
        v = F.when(v < 0, F.lit(None) if negative == "missing" else F.lit(1.0)).otherwise(v)
    return v


@dataclass(frozen=True)
class ReplacementRule:
    """One value-replacement rule for one variable."""

    variable: str
    kind: str
    months: tuple[int, ...] = ()
    weeks: tuple[int, ...] = ()
    start: str | None = None
    end: str | None = None
    condition: str | None = None
    value: float | None = None
    value2: float | None = None
    replace_with: float | None = None
    label: str = field(default="")

    def mask(self, variable: str, period: str, value: str) -> Column:
        p, v = F.col(period), F.col(value)
        if self.kind == "months":
            hit = F.month(p).isin(*self.months)
        elif self.kind == "weeks_yearly":
            hit = F.weekofyear(p).isin(*self.weeks)
        elif self.kind == "weeks_monthly":
            hit = cal.week_of_month(p).isin(*self.weeks)
        elif self.kind == "date_range":
            hit = F.lit(True)
            if self.start:
                hit = hit & (p >= F.lit(self.start).cast("date"))
            if self.end:
                hit = hit & (p <= F.lit(self.end).cast("date"))
        elif self.kind == "condition":
            tests = {
                "eq": v == self.value, "gt": v > self.value, "lt": v < self.value, "gte": v >= self.value,
                "lte": v <= self.value, "isnull": v.isNull(),
                "between": v.between(self.value, self.value2) if self.condition == "between" else F.lit(False),
            } if self.condition != "isnull" else {"isnull": v.isNull()}
            if self.condition not in tests:
                raise ValueError(f"unknown condition {self.condition!r}")
            hit = F.coalesce(tests[self.condition], F.lit(False))
        else:
            raise ValueError(f"unknown rule {self.kind!r}")
        return (F.col(variable) == self.variable) & hit


def preview_rule(df: DataFrame, rule: ReplacementRule, variable: str, period: str, value: str) -> DataFrame:
    """Affected rows with their old values and the new one."""
    return df.where(rule.mask(variable, period, value)).select(
        variable, period, F.col(value).alias("old_value"), F.lit(rule.replace_with).cast("double").alias("new_value")
    )


def apply_rules(df: DataFrame, rules: list[ReplacementRule], variable: str, period: str, value: str) -> DataFrame:
    """Rules in order; each one sees the values the earlier ones left."""
    out = df
    for rule in rules:
        out = out.withColumn(
            value, F.when(rule.mask(variable, period, value), F.lit(rule.replace_with).cast("double")).otherwise(F.col(value))
        )
    return out


def drop_empty(df: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Series with a valid value, and a log of the removed keys with reasons."""
    counts = df.groupBy(key).agg(F.count(value).alias("_n"))
    unnamed = F.col(key).isNull() | (F.trim(key) == "") | F.lower(F.trim(key)).startswith("unnamed")
    log = counts.select(
        key, F.when(unnamed, "unnamed").when(F.col("_n") == 0, "all_missing").alias("reason")
    ).where("reason is not null")
    kept = df.where(~unnamed & F.col(value).isNotNull())
    return kept, log


def drop_repeated_names(df: DataFrame, key: str, position: str) -> tuple[DataFrame, DataFrame]:
    """Of several columns of one name only the first by position stays; the log has the others."""
    first = df.groupBy(key).agg(F.min(position).alias("_first"))
    rows = df.join(first, df[key].eqNullSafe(first[key])).drop(first[key])
    log = rows.where(F.col(position) > F.col("_first")).select(key, position, F.col(key).alias("kept"), F.lit("duplicate_column").alias("reason")).distinct()
    return rows.where(F.col(position) == F.col("_first")).drop("_first"), log


def same_content(df: DataFrame, key: str, period: str, value: str) -> DataFrame:
    """(key, kept, reason) of series that hold the same values at the same periods as an earlier one by name.

    Order-free signatures of all series come from one aggregate; a series is
    compared value by value only with the first one of its signature. Series without
    a value are no copies of each other. Each (key, period) is expected once.
    """
    valid = df.where(F.col(value).isNotNull()).select(key, period, value)
    row = F.xxhash64(period, value)
    marks = valid.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(row.cast("decimal(38,0)")).alias("_sum"), F.bit_xor(F.xxhash64(row)).alias("_xor"))
    same = ["_n", "_sum", "_xor"]
    first = marks.groupBy(*same).agg(F.min(key).alias("kept"), F.count(F.lit(1)).alias("_k")).where("_k > 1").drop("_k")
    pairs = cut_lineage(marks.join(first, same).where(F.col(key) != F.col("kept")).select(key, "kept", "_n"), "same-signature")
    own = valid.join(pairs, key).withColumnRenamed(value, "_v")
    other = valid.join(pairs.select("kept").distinct(), valid[key] == F.col("kept")).select("kept", period, F.col(value).alias("_w"))
    equal = own.join(other, ["kept", period]).where(F.col("_v") == F.col("_w")).groupBy(key, "kept", "_n").agg(F.count(F.lit(1)).alias("_m"))
    return equal.where("_m = _n").select(key, "kept", F.lit("same_content").alias("reason"))


def exclude_listed(df: DataFrame, retired: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(retired.select(*keys).distinct(), keys, "left_anti")


def monthly_cleanup(df: DataFrame, keys: list[str], day: str, value: str, total: str, from_year: int = 2012) -> DataFrame:
    """Month-start periods, first duplicate kept, zero missing, total masked in January and February."""
    rows = df.where(F.col(day).isNotNull() & F.col(value).isNotNull() & (F.year(day) >= from_year))
    first = rows.groupBy(*keys, F.trunc(day, "MM").alias("period")).agg(F.min_by(value, day).alias(value))
    masked = (F.col(keys[0]) == total) & F.month("period").isin(1, 2)
    return first.withColumn(value, F.when(masked, None).otherwise(F.nullif(F.col(value), F.lit(0.0))))


def in_periods(df: DataFrame, day: str, periods: list[tuple[str, str]]) -> DataFrame:
    """Several disjoint date windows in one scan; the list is a query argument."""
    tests = [F.col(day).between(F.lit(a).cast("date"), F.lit(b).cast("date")) for a, b in periods if a <= b]
    return df.where(reduce(lambda a, b: a | b, tests)) if tests else df.where(F.lit(False))


def fetched_since(df: DataFrame, stamp: str, since: Column) -> DataFrame:
    return df.where(F.col(stamp) > since)


def matches_selection(flag_country: Column, flag: Column, destination: Column, flags: list[str], destinations: list[str]) -> Column:
    """Multi-select on filled labels; an empty selection matches everything."""
    label = F.coalesce(F.nullif(flag_country, F.lit("")), F.nullif(flag, F.lit("")), F.lit("unknown"))
    dest = F.coalesce(F.nullif(destination, F.lit("")), F.lit("unknown"))
    ok = F.lit(True)
    if flags:
        ok = ok & label.isin(*flags)
    if destinations:
        ok = ok & dest.isin(*destinations)
    return ok


def is_pair(a: Column, b: Column, members: tuple[str, str]) -> Column:
    """Both ends form exactly the given set, in either direction."""
    return F.array_sort(F.array(F.upper(F.trim(a)), F.upper(F.trim(b)))) == F.array_sort(F.array(*[F.lit(m) for m in members]))


# fixed values: text marks of the home location
HOME_NAME_PARTS = ("DUBAI", "DXB", "DWC", "AL MAKTOUM")
HOME_PREFIX = "AE"


def direction_of(origin: Column, origin_code: Column, dest: Column, dest_code: Column) -> Column:
    """import, export, domestic or transit, from text marks on both ends."""

    def at_home(name: Column, code: Column) -> Column:
        n, c = F.coalesce(F.upper(name), F.lit("")), F.coalesce(F.upper(code), F.lit(""))
        parts = reduce(lambda a, b: a | b, [n.contains(p) for p in HOME_NAME_PARTS])
        return n.startswith(HOME_PREFIX) | parts | c.startswith(HOME_PREFIX)

    o, d = at_home(origin, origin_code), at_home(dest, dest_code)
    return F.when(o & d, "domestic").when(d, "import").when(o, "export").otherwise("transit")


def ship_class(code: Column) -> Column:
    """Vessel class from the numeric ship type; the ranges are fixed values."""
    return (
        F.when(code.between(80, 89), "tanker").when(code.between(70, 79), "cargo").when(code.between(60, 69), "passenger")
        .when(code == 30, "fishing").when(code.isin(31, 32, 50, 51, 52, 53, 54, 55, 58), "tug")
        .when(code.isin(36, 37), "pleasure").when(code.between(1, 99), "other").otherwise("unknown")
    )
