"""Mixed-frequency alignment of many series onto one calendar.

Everything works on one long frame with a frequency column; a frequency is a
condition, not a separate job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from periodica.functions import calendar as cal
from periodica.operators import windows as win
from periodica.operators.filters import replace_zero_negative
from periodica.operators.quality import require

# fixed values: day bands of the median gap, and coarseness order
GAP_BANDS = (("daily", 1, 1), ("weekly", 5, 7.9), ("ten_day", 8, 24), ("monthly", 25, 35), ("quarterly", 85, 100), ("yearly", 350, 380))
PRIORITY = {"daily": 1.0, "weekly": 2.0, "ten_day": 2.5, "monthly": 3.0, "quarterly": 4.0, "yearly": 5.0}


def infer_frequency(df: DataFrame, key: str, period: str) -> DataFrame:
    """Frequency of each series from the median gap between its periods.

    Gaps are counted by value first, so the median is found on a short list.
    """
    days = df.select(key, period).distinct()
    gap = F.datediff(period, F.lag(period).over(win.over([key], period)))
    counts = days.withColumn("gap", gap).where("gap is not null").groupBy(key, "gap").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(key).orderBy("gap")
    total = F.sum("c").over(Window.partitionBy(key))
    c = counts.withColumn("_to", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", total)
    lo, hi = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    first = lambda pos: F.min(F.when(F.col("_to") >= pos, F.col("gap")))
    med = c.groupBy(key).agg(F.floor((first(lo) + first(hi)) / 2).alias("median_gap"))
    band = None
    for name, a, b in GAP_BANDS:
        test = F.col("median_gap").between(a, b)
        band = F.when(test, name) if band is None else band.when(test, name)
    known = med.withColumn("frequency", band.otherwise("irregular"))
    return df.select(key).distinct().join(known, key, "left").withColumn("frequency", F.coalesce("frequency", F.lit("undetermined")))


def bucket_label(period: Column, frequency: str, origin: Column | None = None) -> Column:
    """Label date of a resampling bucket; weeks close on Monday, ten-day bins count from the origin."""
    if frequency == "daily":
        return period
    if frequency == "weekly":
        return F.date_add(period, (7 - F.weekday(period)) % 7)
    if frequency == "ten_day":
        return F.date_add(origin, (F.floor(F.datediff(period, origin) / 10) * 10).cast("int"))
    return {"monthly": cal.month_end, "quarterly": cal.quarter_end, "yearly": cal.year_end}[frequency](period)


def resample(df: DataFrame, key: str, period: str, value: str, frequency: str, how: str = "mean") -> DataFrame:
    """Aggregate each series to the buckets of a frequency; empty buckets are dropped."""
    origin = df.agg(F.min(period).alias("p")).scalar() if frequency == "ten_day" else None
    rows = df.where(F.col(value).isNotNull()).withColumn("_b", bucket_label(F.col(period), frequency, origin))
    agg = {
        "mean": F.avg(value), "sum": F.sum(value), "last": F.max_by(value, period), "first": F.min_by(value, period), "median": F.median(value),
    }.get(how)
    if agg is None:
        raise ValueError(f"unknown aggregation {how!r}")
    return rows.groupBy(key, F.col("_b").alias("bucket")).agg(agg.alias(value))


def align_to_common(df: DataFrame, key: str, period: str, value: str, how: str = "mean") -> tuple[DataFrame, DataFrame]:
    """All series at the coarsest frequency among them, with a report of what each one was.

    The report is one row per series; the chosen frequency is read from it.
    """
    report = infer_frequency(df, key, period)
    rank = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    top = report.where(F.col("frequency").isin(*PRIORITY)).agg(F.max_by("frequency", F.try_element_at(rank, F.col("frequency"))).alias("f"), F.countDistinct("frequency").alias("n")).first()
    if top is None or top["f"] is None or top["n"] < 2:
        return df.select(key, F.col(period).alias("bucket"), value), report.withColumn("target", F.col("frequency"))
    return resample(df, key, period, value, top["f"], how), report.withColumn("target", F.lit(top["f"]))


FRIDAY_RULES = {
    "weekly": cal.nearest_friday, "ten_day": cal.dekad_friday, "monthly": lambda d: cal.period_friday(d, "month"),
    "quarterly": lambda d: cal.period_friday(d, "quarter"), "yearly": lambda d: cal.period_friday(d, "year"),
}


def friday_of(period: Column, frequency: Column) -> Column:
    """Friday a date maps to under its frequency's rule; daily dates close their week."""
    out = F.when(frequency == "daily", cal.week_friday(period))
    for name, rule in FRIDAY_RULES.items():
        out = out.when(frequency == name, rule(period))
    return out


def collapse_to_friday(df: DataFrame, key: str, period: str, value: str, friday: Column) -> DataFrame:
    """One value per Friday: the last non-zero one, else the last.

    A missing value is not zero, so a missing last row wins over earlier ones.
    """
    v = F.col(value)
    nonzero = v.isNull() | (v != 0)
    box = F.struct(v.alias("v"))
    picked = F.coalesce(F.max_by(F.when(nonzero, box), F.when(nonzero, F.col(period))), F.max_by(box, period))
    return df.groupBy(key, friday.alias("friday")).agg(picked["v"].alias(value))


def weekly_mean(df: DataFrame, key: str, period: str, value: str) -> DataFrame:
    return df.groupBy(key, cal.week_friday(period).alias("friday")).agg(F.avg(value).alias(value))


def theoretical_fridays(first: Column, last: Column) -> Column:
    start = cal.week_friday(first)
    end = F.date_sub(last, (F.weekday(last) - 4 + 7) % 7)
    return F.when(start <= end, F.sequence(start, end, F.expr("interval 7 day"))).otherwise(F.array().cast("array<date>"))


def align_to_fridays(df: DataFrame, key: str, period: str, value: str, first: Column | None = None, last: Column | None = None, borrow: bool = True) -> DataFrame:
    """Last value of each Saturday-to-Friday week on a full Friday calendar.

    An empty week borrows the first value of the next week if that week holds
    at least two; ``borrowed_from`` names its date. Only weeks with a value are
    shuffled and ordered; each then adds the empty weeks up to the next one, and a
    key's first row those before the first. A null key has the calendar alone.
    """
    valid = df.where(F.col(value).isNotNull())
    per = valid.groupBy(key, cal.week_friday(period).alias("_week")).agg(
        F.max_by(value, period).alias("_last"), F.min_by(value, period).alias("_first"), F.min(period).alias("_at"), F.max(period).alias("_to"), F.count(F.lit(1)).alias("_n"))
    whole, along = Window.partitionBy(key), win.over([key], "_week")
    rows = per.withColumn("_a", F.min("_at").over(whole)).withColumn("_b", F.max("_to").over(whole))
    start = first if first is not None else F.col("_a")
    end = last if last is not None else F.col("_b")
    rows = rows.withColumn("_start", cal.week_friday(start)).withColumn("_stop", F.date_add(F.date_sub(end, (F.weekday(end) - 4 + 7) % 7), 7))
    inside = F.coalesce(F.col(key).isNotNull() & (F.col("_week") >= F.col("_start")) & (F.col("_week") < F.col("_stop")), F.lit(False))
    rows = rows.withColumn("_own", F.when(inside, F.struct("_week", "_n", "_first", "_at")))
    rows = rows.select(
        key, "_last", "_own", "_start", "_stop", (F.row_number().over(along) == 1).alias("_head"), F.min("_own").over(whole).alias("_lead"),
        F.first("_own", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("_next"))
    own = F.struct(F.col("_own._week").alias("_from"), F.coalesce("_next._week", "_stop").alias("_until"), "_last", F.col("_next").alias("_then"))
    head = F.struct(F.col("_start").alias("_from"), F.coalesce("_lead._week", "_stop").alias("_until"), F.lit(None).cast(df.schema[value].dataType).alias("_last"), F.col("_lead").alias("_then"))
    stretches = F.array(F.when(F.col("_head"), head), F.when(F.col("_own").isNotNull(), own))
    rows = rows.select(key, F.inline(F.filter(stretches, lambda s: s["_from"] < s["_until"])))
    rows = rows.select("*", F.explode(F.sequence("_from", F.date_sub("_until", 7), F.expr("interval 7 day"))).alias("friday"))
    here = F.when(F.col("friday") == F.col("_from"), F.col("_last"))
    can = here.isNull() & (F.date_add("friday", 7) == F.col("_then._week")) & (F.col("_then._n") >= 2) if borrow else F.lit(False)
    return rows.select(key, "friday", F.coalesce(here, F.when(can, F.col("_then._first"))).alias(value), F.when(can, F.col("_then._at")).alias("borrowed_from"))


def dekad_to_weekly(df: DataFrame, key: str, period: str, value: str, borrow: bool = True) -> DataFrame:
    """Days 10, 20 and month end on their Fridays, then the full Friday calendar."""
    p = F.col(period)
    kept = df.where(F.dayofmonth(p).isin(10, 20) | (p == F.last_day(p)))
    mapped = kept.where(F.col(value).isNotNull()).groupBy(key, cal.dekad_friday(p).alias("friday")).agg(F.max_by(value, period).alias(value))
    return align_to_fridays(mapped.withColumnRenamed("friday", period), key, period, value, borrow=borrow)


def publication_shift(df: DataFrame, lags: DataFrame, key: str, period: str) -> DataFrame:
    """Dates moved by each variable's publication lag of 0 to 365 days."""
    require(lags.where("lag_days < 0 or lag_days > 365"), "publication lag must be within 0..365 days")
    return df.join(lags.select(key, "lag_days"), key, "left").withColumn(
        period, F.date_add(period, F.coalesce("lag_days", F.lit(0)))).drop("lag_days")


def smart_yoy_diff(df: DataFrame, key: str, friday: str, value: str, name: str) -> DataFrame:
    """Difference to the Friday of the same month last year, NULL without that exact Friday."""
    prior = df.select(F.col(key), F.col(friday).alias("_f"), F.col(value).alias("_p"))
    rows = df.withColumn("_f", cal.prior_year_friday(friday))
    return rows.join(prior, [key, "_f"], "left").withColumn(name, F.col(value) - F.col("_p")).drop("_f", "_p")


def log_by_series(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Natural log of positive series, log1p of series with zeros; negatives become missing."""
    v = F.when(F.col(value) >= 0, F.col(value))
    low = F.min(v).over(Window.partitionBy(*keys))
    return df.withColumn(name, F.when(low > 0, F.ln(F.when(v > 0, v))).otherwise(F.log1p(v)))


# fixed values: operations recommended by the nature of a variable
NATURE_OPERATIONS = {"流量": ("log", "diff_yoy"), "存量": ("log", "diff_yoy"), "率": ("none", "none"), "同比": ("none", "none")}


def default_operations(nature: Column) -> Column:
    flow = nature.isin(*[n for n, ops in NATURE_OPERATIONS.items() if ops[0] != "none"])
    return F.when(flow, F.array(F.lit("log"), F.lit("diff_yoy"))).otherwise(F.array(F.lit("none"), F.lit("none")))


def transform_variables(df: DataFrame, key: str, period: str, value: str, operations: list[str], frequency: str, yoy_rows: int = 52) -> tuple[DataFrame, DataFrame]:
    """A chain of log, diff_1 and diff_yoy, with statistics before and after."""
    out = df.withColumn("_x", F.col(value))
    for op in operations:
        if op == "none":
            continue
        if op == "log":
            out = log_by_series(out, [key], "_x", "_x")
        elif op == "diff_1":
            out = out.withColumn("_x", F.col("_x") - F.lag("_x").over(win.over([key], period)))
        elif op == "diff_yoy" and frequency in ("weekly", "ten_day"):
            out = smart_yoy_diff(out, key, period, "_x", "_y").withColumn("_x", F.col("_y")).drop("_y")
        elif op == "diff_yoy":
            out = out.withColumn("_x", F.col("_x") - F.lag("_x", yoy_rows).over(win.over([key], period)))
        else:
            raise ValueError(f"unknown operation {op!r}")
    out = out.withColumnRenamed("_x", "transformed")
    s = lambda c, p: [F.avg(c).alias(f"{p}_mean"), F.stddev_samp(c).alias(f"{p}_sd"), F.min(c).alias(f"{p}_min"), F.max(c).alias(f"{p}_max"), F.count_if(F.col(c).isNull()).alias(f"{p}_missing")]
    return out, out.groupBy(key).agg(*s(value, "before"), *s("transformed", "after"))


def prepare(df: DataFrame, key: str, period: str, value: str, frequency: str, lags: DataFrame | None, first: Column, last: Column, zero: str = "none", negative: str = "none", borrow: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole preparation: range, value rules, shift, Friday rules, one calendar.

    Returns the aligned long frame, the borrowing log and the removal log. All
    frequencies travel together; the series key is the only shuffle key.
    """
    rows = df.where(F.col(period).between(first, last)).withColumn(value, replace_zero_negative(value, zero, negative))
    if lags is not None:
        rows = publication_shift(rows, lags, key, period)
    p, f = F.col(period), F.col(frequency)
    dekad_day = F.dayofmonth(p).isin(10, 20) | (p == F.last_day(p))
    rows = rows.where((f != "ten_day") | dekad_day).withColumn("_friday", friday_of(p, f))
    v = F.col(value)
    keep = v.isNull() | (v != 0)
    box = F.struct(v.alias("v"))
    last_nonzero = F.coalesce(F.max_by(F.when(keep, box), F.when(keep, p)), F.max_by(box, period))["v"]
    # Weekly series keep their own dates until the calendar step, so a week with two points can lend one.
    own = f == "weekly"
    slot = F.when(own, p).otherwise(F.col("_friday"))
    one = rows.groupBy(key, frequency, slot.alias("_slot")).agg(
        F.when(f == "daily", F.avg(value)).when(f == "ten_day", F.max_by(F.when(v.isNotNull(), v), F.when(v.isNotNull(), p))).otherwise(last_nonzero).alias(value))
    aligned = align_to_fridays(one.withColumnRenamed("_slot", period), key, period, value, first, last, borrow)
    borrowed = aligned.where("borrowed_from is not null").select(key, F.col("borrowed_from"), F.col("friday").alias("borrowed_to"))
    counts = df.select(key).distinct().join(aligned.groupBy(key).agg(F.count(value).alias("_n")), key, "left")
    removed = counts.where(F.coalesce("_n", F.lit(0)) == 0).select(key, F.lit("all_missing").alias("reason"))
    return aligned.select(key, "friday", value), borrowed, removed
