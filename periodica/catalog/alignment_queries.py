"""Mixed-frequency alignment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from periodica.catalog import carriers as c
from periodica.catalog.carriers import ctes
from periodica.catalog.registry import f32, q6, qf, query, r6
from periodica.functions import calendar as cal
from periodica.plans import alignment as al

D = lambda s: F.lit(s).cast("date")

_MIXED = """
, mixed as (select indicator || '/d' as variable, 'daily' as frequency, period, qty as value from flag_day
  union all select indicator, 'monthly', period, value from customer_month where substr(indicator, 2)::bigint % 3 = 0
  union all select indicator, 'quarterly', period, value from customer_month where substr(indicator, 2)::bigint % 3 = 1
  union all select indicator, 'ten_day', period, value from customer_month where substr(indicator, 2)::bigint % 3 = 2)"""


def mixed(t):
    n = F.substring("indicator", 2, 12).cast("long") % 3
    m = c.customer_month(t).select(F.col("indicator").alias("variable"), F.when(n == 0, "monthly").when(n == 1, "quarterly").otherwise("ten_day").alias("frequency"), "period", "value")
    d = c.flag_day(t).select(F.concat("indicator", F.lit("/d")).alias("variable"), F.lit("daily").alias("frequency"), "period", F.col("qty").alias("value"))
    return d.unionByName(m)


@query("t07_infer_frequency", ctes("flag_day", "customer_month") + _MIXED + """
, g as (select variable, period - lag(period) over (partition by variable order by period) as gap from mixed),
m as (select variable, floor(median(gap))::bigint as median_gap from g where gap is not null group by 1)
select v.variable, median_gap, case when median_gap is null then 'undetermined' when median_gap = 1 then 'daily' when median_gap between 5 and 7 then 'weekly' when median_gap between 8 and 24 then 'ten_day' when median_gap between 25 and 35 then 'monthly'
  when median_gap between 85 and 100 then 'quarterly' when median_gap between 350 and 380 then 'yearly' else 'irregular' end as frequency from (select distinct variable from mixed) v left join m using (variable)""")
def _(t):
    return al.infer_frequency(mixed(t), "variable", "period")


_LABEL = {"weekly": "period + (8 - isodow(period))::int % 7", "ten_day": "(select min(period) from flag_day) + ((period - (select min(period) from flag_day)) // 10 * 10)::int", "monthly": "last_day(period)",
          "quarterly": "(date_trunc('quarter', period) + interval 3 month - interval 1 day)::date", "yearly": "make_date(year(period)::int, 12, 31)"}
_HOW = {"weekly": ("mean", "avg(value)"), "ten_day": ("last", "max_by(value, period)"), "monthly": ("sum", "sum(value)"), "quarterly": ("first", "min_by(value, period)"), "yearly": ("median", "median(value)")}


@query("t08_resample", ctes("flag_day") + "\n" + " union all ".join(
    f"select '{f}' as frequency, indicator, {_LABEL[f]} as bucket, {q6(_HOW[f][1], 2) if f == 'monthly' else qf(_HOW[f][1])} as value from flag_day group by 2, 3" for f in _LABEL))
def _(t):
    out = None
    for f, (how, _sql) in _HOW.items():
        one = al.resample(c.flag_day(t), "indicator", "period", "value", f, how).withColumn("frequency", F.lit(f)).withColumn("value", r6("value", 2) if how == "sum" else f32("value"))
        out = one if out is None else out.unionByName(one)
    return out


@query("t09_align_to_common", ctes("flag_day", "flag_month") + f"""
, d as (select period, sum(qty) as value from flag_day group by 1)
select 'all/d' as variable, last_day(period) as bucket, {qf('avg(value)')} as value from d group by 2 union all select indicator || '/m', period, {qf('value')} from flag_month""")
def _(t):
    d = c.lines_day(t).groupBy(F.lit("all/d").alias("variable"), F.col("day").alias("period")).agg(F.sum("qty").cast("double").alias("value"))
    m = c.flag_month(t).select(F.concat("indicator", F.lit("/m")).alias("variable"), "period", "value")
    out, _report = al.align_to_common(d.unionByName(m), "variable", "period", "value")
    return out.withColumn("value", f32("value"))


def _fri(d: str) -> str:
    return f"({d} + (5 - isodow({d}))::int)"


def _pf(d: str, start: str, end: str, near: str) -> str:
    return (f"case when {near} < {start} then {start} + ((5 - isodow({start}) + 7) % 7)::int when {near} > {end} then {end} - ((isodow({end}) - 5 + 7) % 7)::int else {near} end")


_MS, _ME = "date_trunc('month', day)::date", "last_day(day)"
_QS, _QE = "date_trunc('quarter', day)::date", "(date_trunc('quarter', day) + interval 3 month - interval 1 day)::date"
_YS, _YE = "date_trunc('year', day)::date", "make_date(year(day)::int, 12, 31)"
_DEK = f"(case when isodow(day) = 1 then day - 3 else {_fri('day')} end)"


@query("t10_friday_rules", f"""
with d as (select distinct l_shipdate::date as day from lineitem)
select day, {_fri('day')} as nearest, {_pf('day', _MS, _ME, _fri('day'))} as monthly, {_pf('day', _QS, _QE, _fri('day'))} as quarterly, {_pf('day', _YS, _YE, _fri('day'))} as yearly, {_pf('day', _MS, _ME, _DEK)} as dekad from d""")
def _(t):
    d = t.lineitem.select(F.col("l_shipdate").cast("date").alias("day")).distinct()
    return d.select("day", cal.nearest_friday("day").alias("nearest"), *[cal.period_friday("day", u).alias(n) for n, u in (("monthly", "month"), ("quarterly", "quarter"), ("yearly", "year"))],
                    cal.dekad_friday("day").alias("dekad"))


_MF = _pf("day", _MS, _ME, _fri("day"))


@query("t11_collapse_to_friday", f"""
with d as (select 'C' || o_custkey as indicator, o_orderdate::date as day, sum(case when o_orderkey % 3 = 0 then 0 else o_totalprice::decimal(18,2) end)::double as value from orders group by 1, 2),
f as (select *, {_MF} as friday from d)
select indicator, friday, coalesce(max_by(value, day) filter (where value <> 0), max_by(value, day)) as value from f group by 1, 2""")
def _(t):
    zero = F.when(F.col("o_orderkey") % 3 == 0, F.lit(0).cast("decimal(18,2)")).otherwise(F.col("amount"))
    d = c.orders_day(t).groupBy(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("indicator"), "day").agg(F.sum(zero).cast("double").alias("value"))
    return al.collapse_to_friday(d, "indicator", "day", "value", cal.period_friday("day", "month"))


@query("t12_weekly_mean", ctes("flag_day") + f"""
select indicator, (period + ((5 - isodow(period) + 7) % 7)::int) as friday, {qf('avg(value)')} as value from flag_day group by 1, 2""")
def _(t):
    return al.weekly_mean(c.flag_day(t), "indicator", "period", "value").withColumn("value", f32("value"))


_WF = "({d} + ((5 - isodow({d}) + 7) % 7)::int)"
_THEO = """
, per as (select indicator, {wf} as friday, max_by(value, period) as l, min_by(value, period) as f, min(period) as first_at, count(*) as n from src where value is not null group by 1, 2),
b as (select indicator, min(period) as a, max(period) as z from src where value is not null group by 1),
g as (select indicator, unnest(generate_series({wa}::timestamp, (z - ((isodow(z) - 5 + 7) % 7)::int)::timestamp, interval 7 day))::date as friday from b),
r as (select g.indicator, g.friday, l, lead(n) over w as nn, lead(f) over w as nf, lead(first_at) over w as na from g left join per using (indicator, friday) window w as (partition by g.indicator order by g.friday))
select indicator, friday, coalesce(l, case when nn >= 2 then nf end) as value, case when l is null and nn >= 2 then na end as borrowed_from from r""".format(wf=_WF.format(d="period"), wa=_WF.format(d="a"))


@query("t13_borrowing_alignment", """
with src as (select 'C' || o_custkey as indicator, o_orderdate::date as period, sum(o_totalprice::decimal(18,2))::double as value from orders group by 1, 2)""" + _THEO)
def _(t):
    d = c.orders_day(t).groupBy(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("indicator"), F.col("day").alias("period")).agg(F.sum("amount").cast("double").alias("value"))
    return al.align_to_fridays(d, "indicator", "period", "value")


@query("t14_dekad_to_weekly", ctes("flag_day") + f"""
, k as (select indicator, period as day, value from flag_day where day(period) in (10, 20) or period = last_day(period)),
src as (select indicator, {_pf('day', _MS, _ME, _DEK)} as period, max_by(value, day) as value from k group by 1, 2)""" + _THEO)
def _(t):
    return al.dekad_to_weekly(c.flag_day(t), "indicator", "period", "value")


@query("t15_publication_shift", ctes("customer_month") + """
select indicator, period + case when substr(indicator, 2)::bigint % 5 = 0 then 0 else (substr(indicator, 2)::bigint % 40)::int end as period, value from customer_month""")
def _(t):
    m = c.customer_month(t)
    lags = t.customer.where("c_custkey % 5 <> 0").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("indicator"), (F.col("c_custkey") % 40).cast("int").alias("lag_days"))
    return al.publication_shift(m, lags, "indicator", "period")


_PRIOR = _pf("(friday - interval 1 year)::date", "date_trunc('month', (friday - interval 1 year)::date)::date", "last_day((friday - interval 1 year)::date)", _fri("(friday - interval 1 year)::date"))


@query("t16_smart_yoy_diff", ctes("flag_day") + f"""
, f as (select indicator, {_WF.format(d='period')} as friday, max_by(value, period) as value from flag_day group by 1, 2), p as (select *, {_PRIOR} as pf from f)
select p.indicator, p.friday, {q6('p.value - q.value', 2)} as yoy_diff from p left join f q on q.indicator = p.indicator and q.friday = p.pf""")
def _(t):
    f = c.flag_day(t).groupBy("indicator", cal.week_friday("period").alias("friday")).agg(F.max_by("value", "period").alias("value"))
    return al.smart_yoy_diff(f, "indicator", "friday", "value", "d").select("indicator", "friday", r6("d", 2).alias("yoy_diff"))


@query("t17_transform_chain", ctes("flag_month") + f"""
, x as (select indicator, period, value, ln(value) as l from flag_month), y as (select indicator, period, value, l - lag(l, 12) over (partition by indicator order by period) as z from x)
select indicator, {qf('avg(value)')} as before_mean, {qf('stddev_samp(value)')} as before_sd, min(value) as before_min, max(value) as before_max, {q6('avg(z)')} as after_mean, {q6('stddev_samp(z)')} as after_sd,
  {q6('min(z)')} as after_min, {q6('max(z)')} as after_max, count(*) filter (where value is null) as before_missing, count(*) filter (where z is null) as after_missing from y group by 1""")
def _(t):
    _out, stats = al.transform_variables(c.flag_month(t).select("indicator", "period", "value"), "indicator", "period", "value", ["log", "diff_yoy"], "monthly", 12)
    for x in ("before_mean", "before_sd"):
        stats = stats.withColumn(x, f32(x))
    for x in ("after_mean", "after_sd", "after_min", "after_max"):
        stats = stats.withColumn(x, r6(x))
    return stats


@query("t18_full_preparation", None)
def _(t):
    lags = t.customer.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("variable"), (F.col("c_custkey") % 30).cast("int").alias("lag_days"))
    aligned, _borrowed, _removed = al.prepare(mixed(t), "variable", "period", "value", "frequency", lags, D("1996-01-01"), D("2001-06-30"), zero="missing")
    return aligned
