"""Window-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from periodica.catalog import carriers as c
from periodica.catalog.carriers import ctes
from periodica.catalog.registry import f32, q6, qf, query, r6
from periodica.operators import chunked
from periodica.operators import latest as lt
from periodica.operators import windows as win

KEY, PER = ["indicator"], "period"


@query("w02_trailing_sum", ctes("sales") + """
, pw as (select project, date_trunc('week', day)::date as week_start, count(*) as n from sales group by 1, 2),
g as (select week_start, sum(n)::bigint as n from pw group by 1)
select 'project' as level, project, week_start, n, (sum(n) over (partition by project order by week_start rows between 3 preceding and current row))::bigint as trailing_4 from pw
union all
select 'all', 'all', week_start, n, (sum(n) over (order by week_start rows between 3 preceding and current row))::bigint from g""")
def _(t):
    pw = c.sales(t).groupBy("project", F.trunc("day", "WEEK").alias("week_start")).agg(F.count(F.lit(1)).alias("n"))
    total = pw.groupBy("week_start").agg(F.sum("n").alias("n")).withColumn("project", F.lit("all"))
    both = pw.withColumn("level", F.lit("project")).unionByName(total.withColumn("level", F.lit("all")))
    return both.select("level", "project", "week_start", "n",
                       win.trailing_sum(["level", "project"], "week_start", "n", 4).alias("trailing_4"))


@query("w03_latest_per_key", ctes("positions") + """
select mmsi, observed as latest_observed, source, event_id from (select *, row_number() over (partition by mmsi
  order by observed desc, event_id desc, source) as rn from positions) where rn = 1""")
def _(t):
    p = c.positions(t)
    out = lt.latest_by(p, ["mmsi"], [("observed", False), ("event_id", False), ("source", True)], ["source", "event_id"])
    return out.select("mmsi", F.col("observed").alias("latest_observed"), "source", "event_id")


@query("w04_ordered_tracks", ctes("positions") + f"""
, cut as (select mmsi, max(observed) as last_seen from positions group by 1),
one as (select *, row_number() over (partition by mmsi, observed order by event_id desc, source) as rn from positions),
kept as (select o.mmsi, o.observed, o.lat, o.lon from one o join cut using (mmsi) where rn = 1 and o.observed <= last_seen)
select mmsi, observed, {q6('lat')} as lat, lon, row_number() over (partition by mmsi order by observed) as point_no from kept""")
def _(t):
    p = c.positions(t)
    cutoff = p.groupBy("mmsi").agg(F.max("observed").alias("last_seen"))
    return lt.tracks(p, cutoff).select("mmsi", "observed", r6("lat").alias("lat"), "lon", "point_no")


@query("w05_prior_mean", ctes("flag_month") + f"""
select indicator, period, case when count(value) over w >= 8 then {qf('avg(value) over w')} end as prior_mean
from flag_month window w as (partition by indicator order by period rows between unbounded preceding and 1 preceding)""")
def _(t):
    return c.flag_month(t).select("indicator", "period", f32(win.prior_mean(KEY, PER, "value", 8)).alias("prior_mean"))


@query("w06_full_window_rolls", ctes("customer_month") + f"""
, b as (select indicator, min(period) as a, max(period) as z from customer_month group by 1),
g as (select indicator, last_day(unnest(generate_series(date_trunc('month', a)::timestamp, z::timestamp, interval 1 month))::date) as period from b),
s as (select g.indicator, g.period, m.value from g left join customer_month m using (indicator, period))
select indicator, period, case when count(value) over w4 = 4 then {qf('avg(value) over w4')} end as avg_4,
  case when count(value) over w8 = 8 then count(*) filter (where value > 150000) over w8 end as high_in_8
from s window w4 as (partition by indicator order by period rows between 3 preceding and current row),
  w8 as (partition by indicator order by period rows between 7 preceding and current row)""")
def _(t):
    from periodica.operators.spine import on_spine

    s = on_spine(c.customer_month(t), KEY, PER, "month")
    return s.select(
        "indicator", "period", f32(win.full_window_avg(KEY, PER, "value", 4)).alias("avg_4"),
        win.full_window_count(KEY, PER, F.col("value") > 150000, F.col("value").isNotNull(), 8).alias("high_in_8"))


@query("w07_positive_streak", ctes("customer_month") + """
, g as (select indicator, period, value - lag(value) over (partition by indicator order by period) as d from customer_month),
b as (select *, sum(case when d > 0 then 0 else 1 end) over (partition by indicator order by period) as brk from g)
select indicator, period, case when d is not null then (sum(case when d > 0 then 1 else 0 end)
  over (partition by indicator, brk order by period))::bigint end as streak from b""")
def _(t):
    g = c.customer_month(t).withColumn("d", F.col("value") - F.lag("value").over(win.over(KEY, PER)))
    return win.positive_streak(g, KEY, PER, "d", "streak").select("indicator", "period", "streak")


@query("w08_year_to_date", ctes("flag_month") + f"""
, y as (select indicator, period, value, sum(value::decimal(18,2)) over (partition by indicator, year(period) order by period)::double as ytd from flag_month)
select y.indicator, y.period, y.ytd, {q6('(y.ytd / nullif(p.ytd, 0) - 1) * 100')} as ytd_yoy from y left join y p
  on p.indicator = y.indicator and year(p.period) * 12 + month(p.period) = year(y.period) * 12 + month(y.period) - 12""")
def _(t):
    from periodica.operators.spine import calendar_growth

    m = c.flag_month(t).withColumn("value", F.col("value").cast("decimal(18,2)"))
    y = m.withColumn("ytd", win.year_to_date(KEY, PER, "value").cast("double"))
    return y.select("indicator", "period", "ytd", r6(calendar_growth(KEY, PER, "ytd", 12)).alias("ytd_yoy"))


@query("w09_abs_rank", ctes("flag_month") + """
, d as (select indicator, period, value - lag(value) over (partition by indicator order by period) as change from flag_month)
select indicator, period, rank() over (partition by period order by abs(change) desc nulls last) as size_rank from d""")
def _(t):
    d = c.flag_month(t).withColumn("change", F.col("value") - F.lag("value").over(win.over(KEY, PER)))
    return d.select("indicator", "period", win.abs_rank(["period"], "change").cast("long").alias("size_rank"))


@query("w10_cumulative_to_current", ctes("flag_month") + """
, y as (select indicator, period, sum(value::decimal(18,2)) over (partition by indicator order by period) as cum from flag_month)
select indicator, period, (case when row_number() over w = 1 then cum else cum - lag(cum) over w end)::double as current_value
from y window w as (partition by indicator order by period)""")
def _(t):
    m = c.flag_month(t).withColumn("value", F.col("value").cast("decimal(18,2)"))
    y = m.withColumn("cum", F.sum("value").over(win.over(KEY, PER)))
    return y.select("indicator", "period", win.cumulative_to_current(KEY, PER, "cum").cast("double").alias("current_value"))


@query("w11_ytd_to_month", ctes("customer_month") + """
, y as (select indicator, period, sum(value::decimal(18,2)) over (partition by indicator, year(period) order by period) as ytd from customer_month)
select indicator, period, (case when month(period) = 1 then ytd
  when year(period) * 12 + month(period) - lag(year(period) * 12 + month(period)) over w = 1 then ytd - lag(ytd) over w end)::double as monthly
from y window w as (partition by indicator order by period)""")
def _(t):
    m = c.customer_month(t).withColumn("value", F.col("value").cast("decimal(18,2)"))
    y = m.withColumn("ytd", win.year_to_date(KEY, PER, "value"))
    return y.select("indicator", "period", win.ytd_to_month(KEY, PER, "ytd").cast("double").alias("monthly"))


@query("w12_newest_change", ctes("customer_month") + f"""
, r as (select *, row_number() over (partition by indicator order by period desc) as rn from customer_month),
p as (select indicator, max(period) filter (where rn = 1) as latest_period, max(value) filter (where rn = 1) as latest,
  max(value) filter (where rn = 2) as previous from r where rn <= 2 group by 1)
select p.*, {q6('(latest / nullif(previous, 0) - 1) * 100')} as change_pct, {q6('latest - previous', 4)} as change_points,
  {q6("(latest / nullif((select max_by(value, period) from customer_month x where x.indicator = p.indicator and x.period <= p.latest_period - 90), 0) - 1) * 100")} as change_90d
from p""")
def _(t):
    m = c.customer_month(t)
    a = win.newest_change(m, KEY, PER, "value")
    b = win.change_since_days(m, KEY, PER, "value", 90).select("indicator", r6("change_pct").alias("change_90d"))
    return a.join(b, KEY).select("indicator", "latest_period", "latest", "previous", r6("change_pct").alias("change_pct"),
                                 r6("change_points", 4).alias("change_points"), "change_90d")


@query("w13_date_intervals", ctes("supplier_day") + """
, d as (select node, day, (day - (row_number() over (partition by node order by day))::int) as g from supplier_day)
select node, min(day) as first_day, max(day) as last_day, count(*) as days from d group by node, g""")
def _(t):
    return win.date_intervals(c.lines_day(t).select(F.col("l_suppkey").alias("node"), "day"), ["node"], "day")


@query("w14_extreme_labels", ctes("flag_month") + """
, d as (select indicator, period, round(value - lag(value) over (partition by indicator order by period), 2) as v from flag_month)
select period, first(indicator order by v desc, indicator) filter (where v > 0) as top_positive, max(v) filter (where v > 0) as top_positive_value,
  first(indicator order by v, indicator) filter (where v < 0) as top_negative, min(v) filter (where v < 0) as top_negative_value
from d group by 1""")
def _(t):
    d = c.flag_month(t).select("indicator", "period", F.round(F.col("value") - F.lag("value").over(win.over(KEY, PER)), 2).alias("v"))
    d = d.withColumn("ord", F.ascii(F.substring("indicator", 1, 1)) * 256 + F.ascii(F.substring("indicator", 2, 1)))
    return win.extreme_labels(d, ["period"], "indicator", "ord", "v")


_T = {"d1": "diff", "d2": "second_diff", "ld": "log_diff", "y": "yoy_diff", "ly": "log_yoy_diff"}


@query("w15_difference_transforms", ctes("flag_month") + f"""
select indicator, period, {q6('value - lag(value) over w', 3)} as d1,
  {q6('value - 2 * lag(value) over w + lag(value, 2) over w', 3)} as d2, {q6('ln(value) - lag(ln(value)) over w')} as ld,
  {q6('value - lag(value, 12) over w', 3)} as y, {q6('ln(value) - lag(ln(value), 12) over w')} as ly
from flag_month window w as (partition by indicator order by period)""")
def _(t):
    cols = [r6(win.transform_series(KEY, PER, "value", kind), 6 if "log" in kind else 3).alias(n) for n, kind in _T.items()]
    return c.flag_month(t).select("indicator", "period", *cols)


@query("w16_lagged_pairs", ctes("priority_month") + f"""
, i as (select indicator, value, row_number() over (partition by indicator order by period) as i,
  count(*) over (partition by indicator) as n from priority_month),
l as (select unnest(generate_series(-6, 6))::int as lag)
select a.indicator as target, b.indicator as candidate, lag, count(*) as pairs, {q6('corr(a.value, b.value)')} as correlation
from i a cross join l join i b on b.indicator <> a.indicator and b.i = a.i - lag
where a.indicator = '1-URGENT' and abs(lag) < least(a.n, b.n) group by 1, 2, 3""")
def _(t):
    from periodica.plans.series_pairs import lagged_pairs, target_pairs

    m = c.priority_month(t).select(F.col("indicator").alias("series"), F.col("period").alias("ts"), "value")
    both = lagged_pairs(m, target_pairs(m, "1-URGENT"), 6)
    return both.groupBy("target", "candidate", "lag").agg(
        F.count(F.lit(1)).alias("pairs"), r6(F.corr("x", "y")).alias("correlation"))


@query("w17_gap_fill", ctes("customer_month") + f"""
, b as (select indicator, min(period) as a, max(period) as z from customer_month group by 1),
g as (select indicator, last_day(unnest(generate_series(date_trunc('month', a)::timestamp, z::timestamp, interval 1 month))::date) as period from b),
s as (select g.indicator, g.period, m.value, row_number() over (partition by g.indicator order by g.period) as i
  from g left join customer_month m using (indicator, period)),
f as (select *, last_value(value ignore nulls) over wb as pv, first_value(value ignore nulls) over wa as nv,
  last_value(case when value is not null then i end ignore nulls) over wb as pi,
  first_value(case when value is not null then i end ignore nulls) over wa as ni from s
  window wb as (partition by indicator order by period rows between unbounded preceding and current row),
  wa as (partition by indicator order by period rows between current row and unbounded following))
select indicator, period, coalesce(value, pv) as ffill, coalesce(value, nv) as bfill,
  {qf('coalesce(value, pv + (nv - pv) * ((i - pi)::double / (ni - pi)))')} as linear from f""")
def _(t):
    from periodica.operators.spine import on_spine

    s = on_spine(c.customer_month(t), KEY, PER, "month")
    for m in ("ffill", "bfill", "linear"):
        s = win.fill_gaps(s, KEY, PER, "value", m, m)
    return s.select("indicator", "period", "ffill", "bfill", f32("linear").alias("linear"))


@query("chunked_running_value", ctes("positions") + """
select mmsi, observed, event_id, (sum(source_no) over (partition by mmsi order by observed, event_id rows unbounded preceding))::bigint as running,
  lag(event_id) over (partition by mmsi order by observed, event_id) as previous_event from positions""")
def _(t):
    p = c.positions(t).withColumn("hour", F.date_trunc("hour", "observed"))
    order = ["observed", "event_id"]
    out = chunked.running_sum(p, ["mmsi"], "hour", order, F.col("source_no").cast("long"), "running")
    out = chunked.previous_row(out, ["mmsi"], "hour", order, ["event_id"], "prev")
    return out.select("mmsi", "observed", "event_id", "running", F.col("prev.event_id").alias("previous_event"))
