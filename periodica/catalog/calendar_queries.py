"""Calendar queries: spines, complete periods, calendar lags."""

from __future__ import annotations

from pyspark.sql import functions as F

from periodica.catalog import carriers as c
from periodica.catalog.carriers import ctes
from periodica.catalog.registry import q6, query, r6
from periodica.functions import calendar as cal
from periodica.operators import spine as sp
from periodica.operators import windows as win


@query("t01_last_complete_month", ctes("customer_month") + """
select indicator, max(d) as observed_through,
  case when max(d) = last_day(max(d)) then max(d) else last_day((max(d) - interval 1 month)::date) end as cutoff
from (select 'C' || o_custkey as indicator, o_orderdate::date as d from orders) group by 1""")
def _(t):
    days = c.orders_day(t).select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("indicator"), "day", "amount")
    return sp.last_complete_by_key(days, ["indicator"], "day", "amount")


@query("t02_common_last_month", ctes("priority_day") + """
, per as (select indicator, max(period) as d from priority_day group by 1),
full_days as (select period from priority_day group by 1 having count(*) = 5)
select min(case when d = last_day(d) then d else last_day((d - interval 1 month)::date) end) as common_month,
  (select case when max(period) = last_day(max(period)) then max(period)
   else last_day((max(period) - interval 1 month)::date) end from full_days) as all_valid_month,
  (select max(m) from (
     select 'orders' as g, case when d = last_day(d) then d else last_day((d - interval 1 month)::date) end as m
       from (select least(max(period), date '2001-06-20') as d from priority_day where period <= date '2001-06-20')
     union all
     select 'lines', case when date_trunc('month', d) = date '2001-06-01' then last_day((d - interval 1 month)::date) else last_day(d) end
       from (select max(last_day(l_shipdate::date)) as d from lineitem where last_day(l_shipdate::date) <= date '2001-06-20'))) as report_month
from per""")
def _(t):
    daily = c.priority_day(t)
    today = F.lit("2001-06-20").cast("date")
    sheets = (
        daily.select(F.lit("orders").alias("sheet"), F.lit("daily").alias("frequency"), F.col("period").alias("day"), "value")
        .unionByName(c.lines_day(t).select(F.lit("lines").alias("sheet"), F.lit("monthly").alias("frequency"),
                                           F.last_day("day").alias("day"), F.col("price").cast("double").alias("value")))
    )
    return (
        sp.common_last_month(daily, ["indicator"], "period", "value")
        .withColumn("all_valid_month", sp.all_valid_last_month(daily, "period", "value", 5).scalar())
        .withColumn("report_month", sp.report_month(sheets, "sheet", "frequency", "day", "value", today).scalar())
    )


@query("t03_complete_week_calendar", ctes("line_bounds") + """
select w::date as week_start, (w + interval 6 day)::date as week_end, d as source_data_through
from line_bounds, generate_series(timestamp '1995-01-02', date_trunc('week', d)::timestamp, interval 7 day) g(w)
where w <= case when d >= date_trunc('week', d) + interval 6 day then date_trunc('week', d)
           else date_trunc('week', d) - interval 7 day end and w + interval 6 day <= cutoff""")
def _(t):
    top = c.lines_day(t).agg(F.max("day").alias("d"))
    first = F.lit("1995-01-02").cast("date")
    return top.select(
        F.explode(sp.complete_weeks(first, F.col("d"))).alias("week_start"), F.col("d").alias("source_data_through")
    ).withColumn("week_end", F.date_add("week_start", 6))


@query("j03_daily_spine", ctes("supplier_day") + """
, b as (select node, min(day) as a, max(day) as z from supplier_day group by 1),
g as (select node, unnest(generate_series(a::timestamp, z::timestamp, interval 1 day))::date as day from b)
select g.node, g.day, s.calls, s.qty from g left join supplier_day s using (node, day)""")
def _(t):
    return sp.on_spine(c.supplier_day(t).select("node", "day", "calls", "qty"), ["node"], "day", "day")


@query("j04_calendar_yoy", ctes("priority_month") + f"""
, b as (select indicator, min(period) as a, max(period) as z from priority_month group by 1),
g as (select indicator, last_day(unnest(generate_series(date_trunc('month', a)::timestamp, z::timestamp, interval 1 month))::date) as period from b),
s as (select g.indicator, g.period, m.value from g left join priority_month m using (indicator, period))
select s.indicator, s.period, s.value, p.value as prior,
  {q6('(s.value / nullif(p.value, 0) - 1) * 100')} as yoy
from s left join s p on p.indicator = s.indicator
  and year(p.period) * 12 + month(p.period) = year(s.period) * 12 + month(s.period) - 12""")
def _(t):
    full = sp.on_spine(c.priority_month(t), ["indicator"], "period", "month")
    return full.withColumn("prior", sp.calendar_lag(["indicator"], "period", "value", 12)).select(
        "indicator", "period", "value", "prior",
        r6(sp.calendar_growth(["indicator"], "period", "value", 12)).alias("yoy"),
    )


@query("j04_calendar_yoy_sparse", ctes("customer_month") + f"""
select s.indicator, s.period, s.value, p.value as prior, {q6('(s.value / nullif(p.value, 0) - 1) * 100')} as yoy
from customer_month s left join customer_month p on p.indicator = s.indicator
  and year(p.period) * 12 + month(p.period) = year(s.period) * 12 + month(s.period) - 12""")
def _(t):
    m = c.customer_month(t)
    return m.select(
        "indicator", "period", "value",
        sp.calendar_lag(["indicator"], "period", "value", 12).alias("prior"),
        r6(sp.calendar_growth(["indicator"], "period", "value", 12)).alias("yoy"),
    )


@query("j05_exact_prior_date", ctes("customer_month") + f"""
, y as (select indicator, make_date(year(period), 12, 31) as period, sum(value::decimal(18,2))::double as value from customer_month group by 1, 2)
select y.indicator, y.period, y.value, p.value as prior, {q6('(y.value / nullif(p.value, 0) - 1) * 100')} as growth
from y left join y p on p.indicator = y.indicator and p.period = (y.period - interval 1 year)::date""")
def _(t):
    y = (
        c.orders_day(t).groupBy(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("indicator"),
                                cal.year_end("day").alias("period"))
        .agg(F.sum("amount").cast("double").alias("value"))
    )
    return y.select(
        "indicator", "period", "value",
        sp.calendar_lag(["indicator"], "period", "value", 1, "year").alias("prior"),
        r6(sp.calendar_growth(["indicator"], "period", "value", 1, "year")).alias("growth"),
    )


@query("w01_row_lag_growth", ctes("flag_month") + f"""
select indicator, period, value, {q6('(value / nullif(lag(value, 4) over (partition by indicator order by period), 0) - 1) * 100')} as growth
from flag_month""")
def _(t):
    return c.flag_month(t).select("indicator", "period", "value",
                                  r6(win.row_growth(["indicator"], "period", "value", 4)).alias("growth"))


@query("c07_month_end_shift", """
select day, last_day(day) as month_end, last_day((day + interval 3 month)::date) as plus_three,
  last_day((day - interval 1 month)::date) as minus_one, last_day((strftime(day, '%Y-%m') || '-01')::date) as from_text
from (select distinct o_orderdate::date as day from orders)""")
def _(t):
    d = t.orders.select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return d.select("day", cal.month_end("day").alias("month_end"), cal.shift_month_end("day", 3).alias("plus_three"),
                    cal.shift_month_end("day", -1).alias("minus_one"),
                    cal.month_end_from_text(F.date_format("day", "yyyy-MM")).alias("from_text"))


@query("c08_calendar_keys", """
select day, ((month(day) - 1) * 3 + case when day(day) <= 10 then 1 when day(day) <= 20 then 2 else 3 end)::int as ten_day,
  quarter(day)::int as quarter, isoyear(day)::int as iso_year, week(day)::int as iso_week,
  ((day(day) - 1) // 7 + 1)::int as month_week, dayofyear(make_date(2000, month(day)::int, day(day)::int))::int as leap_day
from (select distinct l_shipdate::date as day from lineitem)""")
def _(t):
    d = t.lineitem.select(F.col("l_shipdate").cast("date").alias("day")).distinct()
    return d.select(
        "day", cal.ten_day_index("day").cast("int").alias("ten_day"), F.quarter("day").alias("quarter"),
        cal.iso_year("day").cast("int").alias("iso_year"), F.weekofyear("day").alias("iso_week"),
        cal.week_of_month("day").alias("month_week"), cal.leap_day_of_year("day").alias("leap_day"))


@query("c10_bucket_bounds", """
select day, date_trunc('week', day)::date as week_start, (date_trunc('week', day) + interval 6 day)::date as week_end,
  date_trunc('month', day)::date as month_start, last_day(day) as month_end,
  date_trunc('year', day)::date as year_start, make_date(year(day)::int, 12, 31) as year_end
from (select distinct l_shipdate::date as day from lineitem)""")
def _(t):
    d = t.lineitem.select(F.col("l_shipdate").cast("date").alias("day")).distinct()
    cols = ["day"]
    for unit in ("week", "month", "year"):
        start = cal.bucket_start("day", unit)
        cols += [start.alias(f"{unit}_start"), cal.bucket_end(start, unit).alias(f"{unit}_end")]
    return d.select(*cols)
