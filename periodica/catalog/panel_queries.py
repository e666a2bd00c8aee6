"""Domain panels: summaries, growth diagnostics, contributions, activity windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from periodica.catalog import carriers as c
from periodica.catalog.carriers import ctes
from periodica.catalog.registry import f32, q6, qf, query, r6
from periodica.functions import calendar as cal
from periodica.operators.joins import unpivot_weights
from periodica.plans import growth as gr
from periodica.plans import industrial as ind
from periodica.plans import modelling as md
from periodica.plans import ports as pt
from periodica.plans import preview as pv
from periodica.plans import prices as pr

D = lambda s: F.lit(s).cast("date")

_SUMMARY_IN = """
, s0 as (select indicator || '/d' as indicator, 'daily' as frequency, '%' as unit, 'price' as kind, period, value from flag_day
  union all select 'P' || indicator, 'daily', 'AED', 'price', period, value from priority_day
  union all select indicator, 'monthly', 'AED', 'flow', period, value from customer_month where substr(indicator, 2)::bigint % 4 = 0
  union all select indicator, 'quarterly', '%', '开工率', period, value from customer_month where substr(indicator, 2)::bigint % 4 = 1
  union all select indicator, 'yearly', '%', 'flow', period, value from customer_month where substr(indicator, 2)::bigint % 4 = 2
  union all select indicator, 'ten_day', 'AED', 'flow', period, value from customer_month where substr(indicator, 2)::bigint % 4 = 3
  union all select indicator || '/w', 'weekly', 'AED', 'flow', date_trunc('week', period)::date, sum(value::decimal(18,2))::double from flag_day group by 1, 5),
m as (select *, max(period) over (partition by indicator) as cur from s0),
r as (select *, case when day(cur) > 20 then date_trunc('month', cur)::date + 10 when day(cur) > 10 then date_trunc('month', cur)::date else (date_trunc('month', cur) - interval 1 month)::date + 20 end as ts,
   case when day(cur) > 20 then date_trunc('month', cur)::date + 19 when day(cur) > 10 then date_trunc('month', cur)::date + 9 else date_trunc('month', cur)::date - 1 end as te,
   (year(cur) - year(period)) * 12 + month(cur) - month(period) as dm, (year(cur) - year(period)) * 4 + quarter(cur) - quarter(period) as dq, year(cur) - year(period) as dy from m),
a as (select indicator, frequency, unit, kind, max(period) as latest_period, max_by(value, period) as latest,
  max_by(value, period) filter (where (frequency = 'daily' and period = cur - 1) or (frequency = 'weekly' and period = cur - 7) or (frequency = 'ten_day' and period between ts and te)
    or (frequency = 'monthly' and dm = 1) or (frequency = 'quarterly' and dq = 1) or (frequency = 'yearly' and dy = 1)) as previous,
  max_by(value, period) filter (where (frequency = 'monthly' and dm = 12) or (frequency = 'quarterly' and dq = 4) or (frequency = 'yearly' and dy = 1)) as same_last_year,
  avg(value) filter (where frequency = 'daily' and period >= cur - 7 and period < cur) as mean_7, avg(value) filter (where frequency = 'daily' and period >= cur - 30 and period < cur) as mean_30,
  max_by(value, period) filter (where frequency = 'yearly' and dy = 2) as two_years_ago, max_by(value, period) filter (where frequency = 'yearly' and dy = 3) as three_years_ago from r group by 1, 2, 3, 4)"""


def summary_input(t):
    n = F.substring("indicator", 2, 12).cast("long") % 4
    add = lambda df, f, u, k: df.select("indicator", F.lit(f).alias("frequency"), F.lit(u).alias("unit"), F.lit(k).alias("kind"), "period", "value")
    fd, m = c.flag_day(t).select("indicator", "period", "value"), c.customer_month(t)
    weekly = c.lines_day(t).groupBy(F.concat("indicator", F.lit("/w")).alias("indicator"), F.trunc("day", "WEEK").alias("period")).agg(F.sum("price").cast("double").alias("value"))
    pd = c.priority_day(t).withColumn("indicator", F.concat(F.lit("P"), "indicator"))
    frames = [add(fd.withColumn("indicator", F.concat("indicator", F.lit("/d"))), "daily", "%", "price"), add(pd, "daily", "AED", "price"), add(weekly, "weekly", "AED", "flow")]
    sparse = m.withColumn("frequency", F.when(n == 0, "monthly").when(n == 1, "quarterly").when(n == 2, "yearly").otherwise("ten_day")).select(
        "indicator", "frequency", F.when(n.isin(1, 2), "%").otherwise("AED").alias("unit"), F.when(n == 1, "开工率").otherwise("flow").alias("kind"), "period", "value")
    out = sparse
    for f in frames:
        out = out.unionByName(f)
    return out


@query("t04_indicator_summary", ctes("flag_day", "priority_day", "customer_month") + _SUMMARY_IN + f"""
select indicator, frequency, unit, kind, latest_period, latest, previous, same_last_year, {qf('mean_7')} as mean_7, {qf('mean_30')} as mean_30, two_years_ago, three_years_ago,
  {q6("case when frequency = 'yearly' then null when unit = '%' and kind <> '开工率' then latest - previous when frequency in ('monthly', 'quarterly') then (latest - previous) / nullif(previous, 0) else (latest - previous) / nullif(abs(previous), 0) end")} as growth_previous,
  {q6("case when unit = '%' and kind <> '开工率' then latest - same_last_year when frequency in ('monthly', 'quarterly') then (latest - same_last_year) / nullif(same_last_year, 0) else (latest - same_last_year) / nullif(abs(same_last_year), 0) end")} as growth_year from a""")
def _(t):
    out = pv.summary(summary_input(t), "indicator", "period", "value", "frequency", "unit", "kind")
    for col in ("mean_7", "mean_30"):
        out = out.withColumn(col, f32(col))
    for col in ("growth_previous", "growth_year"):
        out = out.withColumn(col, r6(col))
    return out


def _band_sql(kind: str, year: str, season: str) -> str:
    return f"""select '{kind}' as frequency, indicator, ({season})::int as season, min(value) filter (where {year} between 1995 and 1999) as hist_min, max(value) filter (where {year} between 1995 and 1999) as hist_max,
  {qf(f'avg(value) filter (where {year} between 1995 and 1999)')} as hist_mean, max_by(value, period) filter (where {year} = 2001) as current, max_by(value, period) filter (where {year} = 2000) as previous from flag_day group by 2, 3"""


@query("t05_seasonal_band", ctes("flag_day") + "\n" + " union all ".join([
    _band_sql("daily", "year(period)", "dayofyear(make_date(2000, month(period)::int, day(period)::int))"), _band_sql("weekly", "isoyear(period)", "week(period)"),
    _band_sql("ten_day", "year(period)", "(month(period) - 1) * 3 + case when day(period) <= 10 then 1 when day(period) <= 20 then 2 else 3 end"), _band_sql("monthly", "year(period)", "month(period)"), _band_sql("quarterly", "year(period)", "quarter(period)")]))
def _(t):
    d = c.flag_day(t)
    out = None
    for f in ("daily", "weekly", "ten_day", "monthly", "quarterly"):
        b = pv.seasonal_band(d, "indicator", "period", "value", f, 2001).withColumn("frequency", F.lit(f)).withColumn("hist_mean", f32("hist_mean"))
        out = b if out is None else out.unionByName(b)
    return out


@query("t06_cumulative_yoy", ctes("flag_month") + f"""
, y as (select indicator, period, sum(value::decimal(18,2)) over (partition by indicator, year(period) order by period)::double as ytd from flag_month)
select a.indicator, a.period, {q6('case when month(a.period) > 2 then (a.ytd - b.ytd) / nullif(b.ytd, 0) * 100 end')} as yoy, {q6('case when month(a.period) > 2 then a.ytd - b.ytd end', 2)} as yoy_diff
from y a left join y b on a.indicator = b.indicator and year(a.period) * 12 + month(a.period) - 12 = year(b.period) * 12 + month(b.period)""")
def _(t):
    from periodica.operators.windows import year_to_date

    y = c.flag_month(t).withColumn("value", F.col("value").cast("decimal(18,2)")).withColumn("ytd", year_to_date(["indicator"], "period", "value").cast("double"))
    return ind.cumulative_yoy(y.select("indicator", "period", "ytd"), ["indicator"], "period", "ytd").select("indicator", "period", r6("yoy").alias("yoy"), r6("yoy_diff", 2).alias("yoy_diff"))


@query("t19_chained_yoy", ctes("flag_month") + f"""
, x as (select indicator, period, case when year(period) = 1997 then round(qty / 100, 2) end as official, case when month(period) <> 6 or year(period) > 1998 then (qty::bigint % 13 - 6) / 10.0::double end as change,
  case when year(period) < 1999 then 'b1' else 'b2' end as base, value as idx from flag_month),
w as (select *, case when count(change) over w12 = 12 then {q6('(product(1 + change / 100) over w12 - 1) * 100', 2)} end as chained from x
  window w12 as (partition by indicator order by year(period) * 12 + month(period) range between 11 preceding and current row)),
j as (select w.*, {q6('(w.idx / nullif(p.idx, 0) - 1) * 100', 2)} as by_index from w left join x p on p.indicator = w.indicator and p.base = w.base
  and year(p.period) * 12 + month(p.period) = year(w.period) * 12 + month(w.period) - 12)
select indicator, period, coalesce(official, chained, by_index) as yoy, case when official is not null then 'official' when chained is not null then 'compounded' when by_index is not null then 'index' end as basis from j""")
def _(t):
    y = F.year("period")
    x = c.flag_month(t).select(
        "indicator", "period", F.when(y == 1997, F.round(F.col("qty") / 100, 2)).alias("official"),
        F.when((F.month("period") != 6) | (y > 1998), (F.col("qty").cast("long") % 13 - 6) / 10.0).alias("change"), F.when(y < 1999, "b1").otherwise("b2").alias("base"), F.col("value").alias("idx"))
    return pr.chained_yoy(x, ["indicator"], "period", "official", "change", "idx", "base")


@query("t20_revenue_estimate", ctes("flag_day", "priority_month") + f"""
, cut as (select case when max(period) = last_day(max(period)) then max(period) else last_day((max(period) - interval 1 month)::date) end as c from flag_day where indicator = 'AF'),
p as (select last_day(period) as period, avg(value) as price from flag_day, cut where indicator = 'AF' and period <= c group by 1),
v as (select indicator, period, avg(value) as volume from priority_month group by 1, 2),
g as (select indicator, v.period, price, volume, day(v.period) as days, price * volume * day(v.period) / 1e8 as revenue from v left join p using (period)),
y as (select *, sum(revenue) over (partition by indicator, year(period) order by period) as ytd from g)
select y.indicator, y.period, {qf('y.price')} as price, y.volume, y.days::int as days, {qf('y.revenue')} as revenue, {q6('(y.revenue / nullif(b.revenue, 0) - 1) * 100')} as yoy, {qf('y.ytd')} as ytd, {q6('(y.ytd / nullif(b.ytd, 0) - 1) * 100')} as ytd_yoy
from y left join y b on b.indicator = y.indicator and year(b.period) * 12 + month(b.period) = year(y.period) * 12 + month(y.period) - 12 where y.revenue is not null""")
def _(t):
    prices = c.flag_day(t).where("indicator = 'AF'").select(F.col("period").alias("day"), F.col("value").alias("price"))
    out = pr.revenue_estimate(prices, c.priority_month(t), ["indicator"], "day", "price", "period", "value")
    return out.select("indicator", "period", f32("price").alias("price"), "volume", "days", f32("revenue").alias("revenue"), r6("yoy").alias("yoy"), f32("ytd").alias("ytd"), r6("ytd_yoy").alias("ytd_yoy"))


_Q = """
, ql as (select indicator, (date_trunc('quarter', day) + interval 3 month - interval 1 day)::date as period, sum(price)::double as value, sum(qty)::double as qty from lines_day
  where day <= date '2001-09-30' group by 1, 2), qt as (select period, sum(value::decimal(28,2))::double as total, sum(qty::decimal(28,2))::double as total_qty from ql group by 1)"""


def quarters(t):
    q = c.lines_day(t).where(F.col("day") <= D("2001-09-30")).groupBy("indicator", cal.quarter_end("day").alias("period")).agg(
        F.sum("price").cast("double").alias("value"), F.sum("qty").cast("double").alias("qty"))
    tot = c.lines_day(t).where(F.col("day") <= D("2001-09-30")).groupBy(cal.quarter_end("day").alias("period")).agg(
        F.sum("price").cast("double").alias("total"), F.sum("qty").cast("double").alias("total_qty"))
    return q, tot


@query("t21_price_volume", ctes("lines_day") + _Q + f"""
, d as (select ql.*, value / qty * 100 as deflator, qty / total_qty as share from ql join qt using (period)),
g as (select indicator, period, {q6('(qty / nullif(lag(qty, 4) over w, 0) - 1) * 100')} as real_growth, {q6('(deflator / nullif(lag(deflator, 4) over w, 0) - 1) * 100')} as deflator_growth, {q6('share')} as share
  from d window w as (partition by indicator order by period))
select * from g where real_growth is not null and deflator_growth is not null""")
def _(t):
    q, tot = quarters(t)
    out = gr.price_volume_quadrant(q, tot.select("period", F.col("total_qty").alias("total")), "indicator", "period", "value", "qty", 6)
    return out.select("indicator", "period", *[r6(x).alias(x) for x in ("real_growth", "deflator_growth", "share")])


@query("t22_growth_contributions", ctes("lines_day") + _Q + f"""
select indicator, period, {q6('(total - lag(total, 4) over w) / lag(total, 4) over w * 100')} as total_growth, {q6('(value - lag(value, 4) over w) / lag(total, 4) over w * 100')} as contribution
from ql join qt using (period) window w as (partition by indicator order by period)""")
def _(t):
    q, tot = quarters(t)
    out = gr.growth_contributions(q, tot, "indicator", "period", "value", 4)
    return out.select("indicator", "period", r6("total_growth").alias("total_growth"), r6("contribution").alias("contribution"))


@query("t22_additivity", ctes("lines_day") + _Q + f"""
, p as (select period, sum(value::decimal(28,2))::double as parts from ql where indicator <> 'AF' or month(period) > 3 group by 1)
select period, parts, total, {q6('total - parts', 2)} as residual, abs(total - parts) <= 0.01 or abs(total - parts) / abs(total) <= 0.005 as within_tolerance from p join qt using (period)""")
def _(t):
    q, tot = quarters(t)
    parts = q.where("indicator <> 'AF' or month(period) > 3").withColumn("value", F.col("value").cast("decimal(28,2)"))
    out = gr.additivity(parts, tot, "period", "value", absolute=0.01)
    return out.select("period", F.col("parts").cast("double").alias("parts"), "total", r6("residual", 2).alias("residual"), "within_tolerance")


_RATES = _Q + """
, l as (select ql.indicator, ql.period, ql.value, total, lag(value, 4) over w as lv, lag(total, 4) over w as lt from ql join qt using (period) window w as (partition by ql.indicator order by ql.period)),
g0 as (select *, (value / nullif(lv, 0) - 1) * 100 as growth, lv / lt as base_share, (value - lv) / lt * 100 as contribution, (total - lt) / lt * 100 as total_growth from l),
g1 as (select *, case when count(growth) over wp >= 8 then avg(growth) over wp end as hm, lag(growth) over wo as pg from g0
  window wp as (partition by indicator order by period rows between unbounded preceding and 1 preceding), wo as (partition by indicator order by period)),
g2 as (select *, growth > 0 as positive, growth > hm as above_history, growth > pg as accelerating, sum(case when growth > 0 then 0 else 1 end) over (partition by indicator order by period) as brk,
  case when count(growth) over w4 = 4 then avg(growth) over w4 end as avg_4, case when count(growth) over w8 = 8 then avg(growth) over w8 end as avg_long,
  case when count(growth) over w4 = 4 then count(*) filter (where growth > 0) over w4 end as pos4, case when count(growth > hm) over w8 = 8 then count(*) filter (where growth > hm) over w8 end as above8
  from g1 window w4 as (partition by indicator order by period rows between 3 preceding and current row), w8 as (partition by indicator order by period rows between 7 preceding and current row)),
g3 as (select *, pos4 = 4 as four_positive, case when growth is not null then sum(case when growth > 0 then 1 else 0 end) over (partition by indicator, brk order by period) end as streak,
  lag(avg_4) over (partition by indicator order by period) as prior_4 from g2)"""


@query("t23_industry_states", ctes("lines_day") + _RATES + f"""
select indicator, period, {q6('growth')} as growth, {q6('avg_4')} as avg_4, {q6('avg_long')} as avg_long, streak::bigint as streak, above8::bigint as above_in_window, {q6('growth - prior_4')} as gap_prior_4,
  {q6('growth - hm')} as level_gap, {q6('growth - pg')} as momentum_gap, {q6('value / total')} as share,
  case when growth - hm is null or growth - pg is null then null when growth > hm and growth > pg then 'high_rising' when growth > hm then 'high_slowing' when growth > pg then 'low_improving' else 'low_worsening' end as state from g3""")
def _(t):
    q, tot = quarters(t)
    g = gr.growth_rates(q, tot, "indicator", "period", "value")
    nums = ("growth", "avg_4", "avg_long", "gap_prior_4", "level_gap", "momentum_gap", "share")
    return g.select("indicator", "period", *[r6(x).alias(x) for x in nums], "streak", "above_in_window", "state")


def _b(name: str) -> str:
    return (f"{q6(f'case when count({name}) = 6 then count(*) filter (where {name}) / 6.0 * 100 end')} as {name}_pct, "
            f"{q6(f'case when count({name}) = 6 and count(base_share) = 6 then coalesce(sum(base_share) filter (where {name}), 0) * 100 end')} as {name}_weighted")


@query("t23_diffusion", ctes("lines_day") + _RATES + "\nselect period, " + ", ".join(_b(n) for n in ("positive", "above_history", "accelerating", "four_positive")) + " from g3 group by 1")
def _(t):
    q, tot = quarters(t)
    d = gr.diffusion(gr.growth_rates(q, tot, "indicator", "period", "value"), "period", 6)
    return d.select("period", *[r6(x).alias(x) for x in d.columns if x != "period"])


@query("t23_concentration", ctes("lines_day") + _RATES + f"""
, s as (select period, sum(abs(contribution)) as mv, sum(contribution) as net, sum(contribution * contribution) as sq, max(total_growth) as tg, count(contribution) as n,
  max_by(indicator, contribution) filter (where contribution > 0) as tp, max(contribution) filter (where contribution > 0) as tpv, min_by(indicator, contribution) filter (where contribution < 0) as tn,
  min(contribution) filter (where contribution < 0) as tnv from g3 group by 1)
select period, {q6('net / mv * 100')} as balance, {q6('least(100, greatest(0, (sq / (mv * mv) - 1.0::double / 6) / (1 - 1.0::double / 6) * 100))')} as concentration, {q6('sq / (mv * mv)')} as hhi, {q6('mv')} as movement, {q6('tg')} as total_growth,
  tp as top_positive, {q6('tpv')} as top_positive_value, tn as top_negative, {q6('tnv')} as top_negative_value from s where n = 6 and mv > 0""")
def _(t):
    q, tot = quarters(t)
    k = gr.concentration(gr.growth_rates(q, tot, "indicator", "period", "value"), "indicator", "period", 6)
    return k.select("period", "top_positive", "top_negative", *[r6(x).alias(x) for x in ("balance", "concentration", "hhi", "movement", "total_growth", "top_positive_value", "top_negative_value")])


_W = """
, g as (select indicator, period, (value / nullif(lag(value) over (partition by indicator order by period), 0) - 1) * 100 as growth from flag_month),
wy as (select indicator, y, w from (values (1995, 0.2::double), (1998, 0.15::double), (2000, 0.18::double)) v(y, w), (select distinct indicator from flag_month where indicator <> 'NO')),
k as (select g.*, coalesce((select max_by(w, y) from wy where wy.indicator = g.indicator and y <= year(g.period)), 0)::double as weight from g where indicator <> 'NO')"""


def weighted_growth(t):
    from periodica.operators.windows import row_growth

    g = c.flag_month(t).select("indicator", "period", row_growth(["indicator"], "period", "value", 1).alias("growth"))
    w = unpivot_weights(g.where("indicator <> 'NO'").select("indicator").distinct().select(
        "indicator", F.lit(0.2).alias("weight_1995"), F.lit(0.15).alias("weight_1998"), F.lit(0.18).alias("weight_2000")), "indicator")
    return g, w


@query("t24_weighted_contributions", ctes("flag_month") + _W + f"""
select indicator, period, {q6('growth * weight')} as contribution from k""")
def _(t):
    g, w = weighted_growth(t)
    return ind.weighted_contributions(g, w, "indicator", "period", "growth").select("indicator", "period", r6("contribution").alias("contribution"))


@query("t24_contribution_check", ctes("flag_month") + _W + f"""
, tot as (select period, avg(growth) as total from g group by 1), s as (select period, coalesce(sum(growth * weight), 0) as cs from k group by 1)
select period, {q6('cs')} as contribution_sum, {q6('cs - total')} as difference, abs(cs - total) <= 0.5 as passed from tot left join s using (period)""")
def _(t):
    g, w = weighted_growth(t)
    tot = g.groupBy("period").agg(F.avg("growth").alias("total"))
    out = ind.contribution_check(ind.weighted_contributions(g, w, "indicator", "period", "growth"), tot, "period")
    return out.select("period", r6("contribution_sum").alias("contribution_sum"), r6("difference").alias("difference"), "passed")


@query("t24_sector_contributions", ctes("flag_month") + _W + f"""
, og as (select period, left(indicator, 1) as sector, avg(growth) as growth from g group by 1, 2)
select og.period, og.sector, {q6('max(og.growth) * sum(k.weight)')} as contribution from og join k on left(k.indicator, 1) = og.sector and k.period = og.period group by 1, 2""")
def _(t):
    g, w = weighted_growth(t)
    overall = g.groupBy("period", F.substring("indicator", 1, 1).alias("sector")).agg(F.avg("growth").alias("growth"))
    members = g.select("indicator", F.substring("indicator", 1, 1).alias("sector")).distinct()
    return ind.sector_contributions(overall, w, members, "indicator", "period", "sector").withColumn("contribution", r6("contribution"))


@query("t25_profit_contributions", ctes("customer_month") + f"""
, tot as (select period, sum(value::decimal(18,2))::double as total from customer_month group by 1 having sum(value) <> 0)
select a.indicator, a.period, {q6('(a.value - b.value) / t.total * 100')} as contribution from customer_month a
left join customer_month b on b.indicator = a.indicator and year(b.period) * 12 + month(b.period) = year(a.period) * 12 + month(a.period) - 12 and month(b.period) > 2
left join tot t on t.period = b.period where month(a.period) > 2""")
def _(t):
    m = c.customer_month(t).withColumn("value", F.col("value").cast("decimal(18,2)"))
    out = ind.profit_contributions(m, "indicator", "period", "value")
    return out.select("indicator", "period", r6("contribution").alias("contribution"))


@query("t26_ratio_panel", ctes("flag_month") + f"""
, y as (select indicator, period, sum(value::decimal(18,2)) over w as rev, sum(qty::decimal(18,2)) over w as pro, value * 3 + 100 as assets, value + qty as equity from flag_month window w as (partition by indicator order by period)),
d as (select *, (case when row_number() over w = 1 then rev else rev - lag(rev) over w end)::double as r, (case when row_number() over w = 1 then pro else pro - lag(pro) over w end)::double as p from y window w as (partition by indicator order by period))
select indicator, period, {q6('p / equity * 100')} as roe, {q6('p / r * 100')} as margin, {q6('r / assets')} as turnover, {q6('assets / equity')} as leverage from d where month(period) > 2""")
def _(t):
    from periodica.operators.windows import over

    m = c.flag_month(t)
    w = over(["indicator"], "period")
    y = m.select("indicator", "period", F.sum(F.col("value").cast("decimal(18,2)")).over(w).alias("rev"), F.sum(F.col("qty").cast("decimal(18,2)")).over(w).alias("pro"),
                 (F.col("value") * 3 + 100).alias("assets"), (F.col("value") + F.col("qty")).alias("equity"))
    y = y.withColumn("rev", F.col("rev").cast("decimal(28,2)")).withColumn("pro", F.col("pro").cast("decimal(28,2)"))
    out = ind.ratio_panel(y, ["indicator"], "period", "pro", "rev", "assets", "equity")
    return out.select("indicator", "period", *[r6(x).alias(x) for x in ("roe", "margin", "turnover", "leverage")])


_NODE = """
, nd as (select indicator as node, day, count(*)::double as calls, sum(case when l_linenumber <= 3 then qty end)::double as imp, sum(case when l_linenumber > 3 then qty end)::double as exp from lines_day group by 1, 2)"""


def node_days(t):
    n = F.col("l_linenumber")
    return c.lines_day(t).groupBy(F.col("indicator").alias("node"), "day").agg(
        F.count(F.lit(1)).cast("double").alias("calls"), F.sum(F.when(n <= 3, F.col("qty"))).cast("double").alias("imp"), F.sum(F.when(n > 3, F.col("qty"))).cast("double").alias("exp"))


def _ws(cond: str, v: str, n: str) -> str:
    return f"case when count(*) filter (where {cond}) = {n} and count({v}) filter (where {cond}) = {n} then sum({v}) filter (where {cond}) end"


_NOW, _BEF = "day between date '1999-03-03' - {d} + 1 and date '1999-03-03'", "day between date '1999-03-03' - 2 * {d} + 1 and date '1999-03-03' - {d}"


def _roll(d: int) -> str:
    n, b = _NOW.format(d=d), _BEF.format(d=d)
    return f"""select {d} as days, *, calls / {d} as avg_calls, (imports + exports) / {d} as avg_handled, case when calls is not null then active_days end / {d} * 100 as active_day_rate, (imports + exports) / nullif(calls, 0) as cargo_per_call,
  (exports - imports) / nullif(imports + exports, 0) * 100 as trade_balance, calls / nullif(previous_calls, 0) * 100 as activity_index from (select node, count(*) filter (where {n}) as observed_days, count(*) filter (where {b}) as previous_observed_days,
  {_ws(n, 'calls', str(d))} as calls, {_ws(b, 'calls', str(d))} as previous_calls, {_ws(n, '(calls > 0)::int', str(d))} as active_days, {_ws(n, '(calls > 0 and imp + exp = 0)::int', str(d))} as idle_cargo_days,
  {_ws(n, 'imp', str(d))} as imports, {_ws(n, 'exp', str(d))} as exports from nd where {n} or {b} group by 1)"""


_ROLL_NUM = ("avg_calls", "avg_handled", "active_day_rate", "cargo_per_call", "trade_balance", "activity_index")


@query("t27_rolling_activity", ctes("lines_day") + _NODE + f""", u as ({_roll(7)} union all {_roll(30)})
select days, node, observed_days, previous_observed_days, calls, previous_calls, active_days::bigint as active_days, idle_cargo_days::bigint as idle_cargo_days, imports, exports, {', '.join(q6(x) + ' as ' + x for x in _ROLL_NUM)} from u""")
def _(t):
    d = node_days(t)
    out = None
    for n in (7, 30):
        one = pt.rolling_activity(d, "node", "day", D("1999-03-03"), n, "calls", "imp", "exp").withColumn("days", F.lit(n))
        out = one if out is None else out.unionByName(one)
    for col in _ROLL_NUM:
        out = out.withColumn(col, r6(col))
    return out




@query("t27_to_date_activity", ctes("lines_day") + _NODE + f"""
, a as (select node, count(*) filter (where day between date '1999-06-14' and date '1999-06-17') as week_days, {_ws("day between date '1999-06-14' and date '1999-06-17'", 'calls', '4')} as week_calls, {_ws("day between date '1999-06-01' and date '1999-06-17'", 'calls', '17')} as month_calls,
  {_ws("day between date '1999-06-14' and date '1999-06-17'", 'imp', '4')} as week_imp, {_ws("day between date '1999-06-01' and date '1999-06-17'", 'imp', '17')} as month_imp from nd where day between date '1999-06-01' and date '1999-06-17' group by 1)
select *, {q6('week_imp / nullif(week_calls, 0) * 100')} as week_share_imp from a""")
def _(t):
    return pt.to_date_activity(node_days(t), "node", "day", D("1999-06-17"), "calls", ["imp"]).withColumn("week_share_imp", r6("week_share_imp"))


@query("t28_comparison_windows", ctes("lines_day") + _NODE + """
, w(win, a, b) as (values ('last_week', date '1999-03-22', date '1999-03-28'), ('week_before', date '1999-03-15', date '1999-03-21'), ('month_to_date', date '1999-03-01', date '1999-03-31'),
  ('prior_month', date '1999-02-01', date '1999-02-28'), ('same_month_last_year', date '1998-03-01', date '1998-03-31'))
select win as "window", a as first_day, b as last_day, case when count(calls) = 6 * (max(b - a) + 1) then sum(calls) end as total from w join nd on day between a and b group by 1, 2, 3""")
def _(t):
    return pt.window_totals(node_days(t), "node", "day", "calls", D("1999-03-31"), 6)


#: Weights of a local quadratic fit by window width: one row a place up to the middle, divisor last; later places mirror them.
_FITS = {3: ("1 0 0 1", "0 1 0 1"), 5: ("31 9 -3 -5 3 35", "9 13 12 6 -5 35", "-3 12 17 12 -3 35"), 7: ("32 15 3 -4 -6 -3 5 42", "5 4 3 2 1 0 -1 14", "1 3 4 4 3 1 -2 14", "-2 3 6 7 6 3 -2 21")}


def _fit_sql() -> str:
    """Lists of weights, by half the width and by place."""
    out = []
    for rows in _FITS.values():
        half = [[f"{int(x)} / {r.split()[-1]}.0::double" for x in r.split()[:-1]] for r in rows]
        out.append("[" + ", ".join(f"[{', '.join(r)}]" for r in half + [r[::-1] for r in half[-2::-1]]) + "]")
    return f"[{', '.join(out)}]"


@query("t29_search_index", ctes("customer_month") + f"""
, b as (select indicator, period, value, row_number() over (partition by indicator order by period) - 1 as i, count(*) over w as n, list(value) over (partition by indicator order by period rows between unbounded preceding and unbounded following) as l,
  min(value) over w = max(value) over w as flat from customer_month where year(period) >= 1996 window w as (partition by indicator)),
d as (select *, least(7, n) - case when least(7, n) % 2 = 0 then 1 else 0 end as wd from b),
p as (select *, greatest(0, least(i - wd // 2, n - wd)) as s from d),
f as (select indicator, period, value, case when wd < 3 or flat then value else list_inner_product(l[s + 1 : s + wd], ({_fit_sql()})[wd // 2][i - s + 1]) end as smoothed from p),
z as (select *, avg(smoothed) over (partition by indicator) as m, stddev_samp(smoothed) over (partition by indicator) as sd from f)
select indicator, period, value, {q6('smoothed')} as smoothed, {q6('case when coalesce(sd, 0) = 0 then smoothed else (smoothed - m) / sd end')} as standardised from z""")
def _(t):
    out = pr.search_index(c.customer_month(t), ["indicator"], "period", "value", 1996)
    return out.select("indicator", "period", "value", r6("smoothed").alias("smoothed"), r6("standardised").alias("standardised"))


_EDGES = ("32 15 3 -4 -6 -3 5 42", "5 4 3 2 1 0 -1 14", "1 3 4 4 3 1 -2 14")  # weights of the three end positions, then their divisor


def _edge(name: str, weights: str) -> str:
    *w, whole = weights.split()
    return "(" + " + ".join(f"({x}) * {name}{k}" for k, x in enumerate(w)) + f") / {whole}"


@query("t29_smooth_whole", ctes("flag_month") + f"""
, s as (select indicator, period, row_number() over w as i, row_number() over wr as j, (-2 * lag(value, 3) over w + 3 * lag(value, 2) over w + 6 * lag(value) over w + 7 * value
  + 6 * lead(value) over w + 3 * lead(value, 2) over w - 2 * lead(value, 3) over w) / 21 as mid, {', '.join(f'nth_value(value, {k + 1}) over wf as f{k}, nth_value(value, {k + 1}) over wb as b{k}' for k in range(7))}
  from flag_month window w as (partition by indicator order by period), wr as (partition by indicator order by period desc),
  wf as (partition by indicator order by period rows between unbounded preceding and unbounded following), wb as (partition by indicator order by period desc rows between unbounded preceding and unbounded following))
select indicator, period, {qf('case ' + ' '.join(f'when i = {k + 1} then {_edge("f", w)} when j = {k + 1} then {_edge("b", w)}' for k, w in enumerate(_EDGES)) + ' else mid end')} as smoothed from s""")
def _(t):
    return pr.smooth(c.flag_month(t), ["indicator"], "period", "value", "smoothed").select("indicator", "period", f32("smoothed").alias("smoothed"))


@query("t30_timeline_months", """
select date_trunc('month', o_orderdate)::date as month, o_orderpriority as keyword, ((avg(o_custkey::double))::float)::double as value
from orders where o_orderstatus <> 'P' and date_trunc('month', o_orderdate) < date '2001-06-01' group by 1, 2""")
def _(t):
    o = t.orders.select(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("time"), F.col("o_orderpriority").alias("keyword"),
                        F.col("o_custkey").cast("string").alias("v"), F.when(F.col("o_orderstatus") == "P", "True").otherwise("false").alias("partial"))
    out = pr.timeline_months(o, "time", "keyword", "v", "partial", D("2001-06-15"))
    return out.withColumn("value", f32("value"))


@query("t31_intervention_path", ctes("priority_month") + """
select indicator, period, (period = date '1998-03-31')::int::double as pulse, (period >= date '1998-03-31')::int::double as step, (period between date '1998-03-31' and date '1999-01-31')::int::double as temporary from priority_month""")
def _(t):
    p, a, b = F.col("period"), D("1998-03-31"), D("1999-01-31")
    return c.priority_month(t).select("indicator", "period", *[md.intervention_path(p, k, a, b).alias(k) for k in ("pulse", "step", "temporary")])


@query("t32_future_calendar", ctes("priority_month", "flag_month") + """
, l as (select indicator, max(period) as z from priority_month group by 1),
f as (select indicator, s::int as step, last_day((date_trunc('month', z) + to_months(s::int))::date) as period from l, generate_series(1, 6) g(s))
select f.indicator, f.step, f.period, x.qty as regressor from f left join (select period, qty from flag_month where indicator = 'AF') x using (period)""")
def _(t):
    x = c.flag_month(t).where("indicator = 'AF'").select("period", F.col("qty").alias("regressor"))
    return md.future_values(md.future_calendar(c.priority_month(t), "indicator", "period", 6, "month"), x, ["period"])


@query("t33_modelling_bounds", ctes("supplier_day") + """
, m as (select node, day, case when imports - 20 <= 0 then null else imports - 20 end as value from supplier_day where day between date '1996-01-01' and date '2000-12-31'),
g as (select node, node // 3 as team from (select distinct node from m) as x), z as (select team, count(*) as size from g group by 1),
f as (select team, day from m join g using (node) join z using (team) where value is not null group by team, day, size having count(distinct node) = size)
select team, min(day) as first_period, max(day) as last_period from f group by 1""")
def _(t):
    d = c.supplier_day(t).select("node", "day", (F.col("imports") - 20).alias("value"), F.floor(F.col("node") / 3).cast("long").alias("team"))
    m = md.modelling_frame(d, "node", "day", "value", D("1996-01-01"), D("2000-12-31"), True, True, None)
    return md.common_bounds(m, "node", "day", "value", ["team"])


@query("t34_forecast_calendar", ctes("customer_month") + """
, k as (select distinct indicator, period from customer_month where period <= date '1999-12-31' union select indicator, period from customer_month where period > date '1999-12-31'),
l as (select indicator, max(period) as z from k group by 1)
select indicator, period, case when period <= date '1999-12-31' then 'training' else 'holdout' end as phase from k
union all select indicator, last_day((date_trunc('month', z) + to_months(s::int))::date), 'extension' from l, generate_series(1, 3) g(s)""")
def _(t):
    m = c.customer_month(t)
    end = D("1999-12-31")
    return md.forecast_calendar(m.where(F.col("period") <= end), m, "indicator", "period", end, 3, "month")
