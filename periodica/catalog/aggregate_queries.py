"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from periodica.catalog import carriers as c
from periodica.catalog.carriers import ctes
from periodica.catalog.registry import f32, q6, qf, query, r6
from periodica.functions.measures import complete_sum, complete_sum_of, complete_avg, exact_median, row_sum
from periodica.operators import aggregates as ag
from periodica.operators import latest as lt
from periodica.session import cut_lineage

REGIONS = "case when lat < 24.1 then 'south' when lat < 24.3 then 'middle' else 'north' end"
CLASSES = ["view", "purchase"]


def regional(t):
    lat = F.col("lat")
    return c.reports(t).withColumn("region", F.when(lat < 24.1, "south").when(lat < 24.3, "middle").otherwise("north"))


@query("a01_complete_sum", ctes("supplier_day") + """
select node, last_day(day) as period, case when count(*) = day(last_day(min(day))) and count(imports) = count(*) then sum(imports) end as imports,
  case when count(*) = day(last_day(min(day))) then sum(qty) end as qty,
  case when count(*) = day(last_day(min(day))) and count(imports) = count(*) and count(exports) = count(*) then sum(imports) + sum(exports) end as handled
from supplier_day group by 1, 2""")
def _(t):
    d = c.supplier_day(t)
    n = F.dayofmonth(F.last_day(F.min("day")))
    return d.groupBy("node", F.last_day("day").alias("period")).agg(
        complete_sum("imports", n).alias("imports"), complete_sum("qty", n).alias("qty"),
        complete_sum_of(["imports", "exports"], n).alias("handled"))


@query("a02_daily_complete_total", ctes("flag_day") + """
select period as day, case when count(*) filter (where value >= 0 and isfinite(value)) = 6 then round(sum(value), 2) end as value,
  case when count(*) filter (where qty >= 0 and isfinite(qty)) = 6 then sum(qty) end as qty from flag_day group by 1""")
def _(t):
    d = c.flag_day(t).withColumnRenamed("period", "day")
    return ag.daily_totals(d, "day", ["value", "qty"], 6).withColumn("value", F.round("value", 2))


@query("a03_window_cells_total", ctes("flag_day") + """
select case when count(*) = 6 * 28 and count(qty) = 6 * 28 then sum(qty) end as total from flag_day
where period between date '1999-02-01' and date '1999-02-28'""")
def _(t):
    d = c.flag_day(t)
    return ag.window_total(d, "period", "qty", F.lit("1999-02-01").cast("date"), F.lit("1999-02-28").cast("date"), 6)


_BUCKET = """
, b as (select indicator, min(period) as f, max(period) as l from flag_day group by 1),
g{u} as (select indicator, date_trunc('{u}', period)::date as bucket, count(*) as n, count(distinct period) as d,
  sum(qty) as qty, count(*) filter (where qty >= 0) as ok from flag_day group by 1, 2),
r{u} as (select '{u}' as unit, indicator, bucket, greatest(bucket, f) as period_start, least((bucket + interval {e} - interval 1 day)::date, l) as period_end, n, d, ok, qty
  from g{u} join b using (indicator))"""


@query("a04_clipped_bucket_sums", ctes("flag_day") + _BUCKET.format(u="week", e="7 day") + _BUCKET.format(u="month", e="1 month").replace(", b as (select indicator, min(period) as f, max(period) as l from flag_day group by 1)", "") + _BUCKET.format(u="year", e="1 year").replace(", b as (select indicator, min(period) as f, max(period) as l from flag_day group by 1)", "") + """
select unit, indicator, bucket, period_start, period_end, case when n = period_end - period_start + 1 and ok = n then qty end as qty, n > d as duplicate_days
from (select * from rweek union all select * from rmonth union all select * from ryear)""")
def _(t):
    d = c.flag_day(t)
    out = None
    for u in ("week", "month", "year"):
        one = ag.bucket_sums(d, ["indicator"], "period", ["qty"], u).withColumn("unit", F.lit(u))
        out = one if out is None else out.unionByName(one)
    return out.select("unit", "indicator", "bucket", "period_start", "period_end", "qty", "duplicate_days")


@query("a05_distinct_by_region", ctes("reports") + f"""
, r as (select *, {REGIONS} as region, date_trunc('day', observed)::date as bucket from reports),
i as (select bucket, region, mmsi, max(case when category = 'view' then 1 else 0 end) as m from r group by 1, 2, 3),
s as (select bucket, region, sum(m)::bigint as vessels from i group by 1, 2),
g as (select region, unnest(generate_series((select min(bucket) from s)::timestamp, (select max(bucket) from s)::timestamp, interval 1 day))::date as bucket from (select distinct region from s))
select g.region, g.bucket, vessels from g left join s using (region, bucket)""")
def _(t):
    return ag.distinct_by_region(regional(t), F.col("category") == "view", "day").select("region", "bucket", "vessels")


@query("a05_distinct_by_class", ctes("reports") + """
, l as (select observed::date as bucket, mmsi, max_by(category, (observed, event_id)) as cat from reports where source_no < 2 group by 1, 2)
select bucket, case when cat in ('view', 'purchase') then cat else 'other_unknown' end as kind, count(*) as vessels from l group by 1, 2""")
def _(t):
    return ag.distinct_by_class(c.reports(t), F.col("source_no") < 2, "day", CLASSES)


@query("a06_last_sample_stock", ctes("reports") + f"""
, r as (select *, {REGIONS} as region, observed::date as day from reports),
a as (select day, max(observed) as anchor from r group by 1),
k as (select date_trunc('week', day)::date as bucket, max(day) as day, max_by(anchor, day) as anchor from a group by 1),
f as (select bucket, anchor, mmsi, max_by(region, (observed, event_id)) as region from r join k using (day)
  where observed >= anchor - interval 120 minute group by 1, 2, 3)
select bucket, anchor as sample_at, region, count(*) as vessels from f group by 1, 2, 3""")
def _(t):
    return ag.last_sample_stock(regional(t), "week")


@query("a07_status_counters", ctes("positions") + """
, l as (select * from (select *, row_number() over (partition by mmsi order by observed desc, event_id desc) as rn from positions) where rn = 1),
v as (select sog, case category when 'view' then 'tanker' when 'purchase' then 'cargo' end as category, case when user_id % 3 = 0 then 'CN' else 'AE' end as flag from l)
select count(*) filter (where sog >= 0.5) as moving, count(*) filter (where sog < 0.5) as stopped,
  count(*) filter (where category = 'tanker') as tankers, count(*) filter (where category = 'cargo') as cargo,
  count(*) filter (where coalesce(category, '') not in ('tanker', 'cargo')) as other, count(*) filter (where flag = 'CN') as flag_cn from v""")
def _(t):
    l = lt.latest_by(c.positions(t), ["mmsi"], [("observed", False), ("event_id", False)], ["sog", "category", "user_id"])
    v = l.select("sog", F.when(F.col("category") == "view", "tanker").when(F.col("category") == "purchase", "cargo").alias("category"),
                 F.when(F.col("user_id") % 3 == 0, "CN").otherwise("AE").alias("flag"))
    return ag.status_counters(v)


@query("a08_monthly_two_sources", ctes("lines_day", "orders_day", "line_bounds") + """
, ub as (select max(day) as d from orders_day where indicator = '1-URGENT'),
c as (select least((select cutoff from line_bounds), (select case when d = last_day(d) then d else last_day((d - interval 1 month)::date) end from ub)) as cutoff),
l as (select last_day(day) as period, sum(qty)::double as qty, sum(price)::double as price from lines_day where day <= (select cutoff from c) group by 1),
o as (select last_day(day) as period, sum(amount)::double as amount from orders_day where day <= (select cutoff from c) and indicator = '1-URGENT' group by 1)
select l.period, qty, price, amount from l left join o using (period)""")
def _(t):
    o = c.orders_day(t).where(F.col("indicator") == "1-URGENT").select("day", "amount")
    out = ag.monthly_two_sources(c.lines_day(t).select("day", "qty", "price"), o, "day", ["qty", "price"], ["amount"])
    return out.select("period", *[F.col(x).cast("double").alias(x) for x in ("qty", "price", "amount")])


@query("a09_monthly_sales", ctes("sales", "line_bounds") + """
select last_day(day) as period, usage, reg, count(*) as sales, sum(worth)::double as amount
from sales where day <= (select cutoff from line_bounds) group by 1, 2, 3""")
def _(t):
    return ag.monthly_sales(c.sales(t), "day", ["usage", "reg"], "worth")


@query("a10_year_median", ctes("sales") + f"""
select year(day)::int as sale_year, usage, type, count(*) as sales, sum(worth)::double as total, {q6('median(worth::double)', 3)} as median_worth
from sales group by 1, 2, 3""")
def _(t):
    s = cut_lineage(c.sales(t).select(F.year("day").alias("sale_year"), "usage", "type", "worth"), "sales")  # read three times
    keys = ["sale_year", "usage", "type"]
    sums = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("sales"), F.sum("worth").cast("double").alias("total"))
    return sums.join(exact_median(s, keys, "worth", "m"), keys).select(*keys, "sales", "total", r6("m", 3).alias("median_worth"))


@query("a11_distinct_per_month", ctes("lines_day") + """
select last_day(day) as period, case when l_returnflag = 'R' then 'import' else 'export' end as direction, count(distinct l_orderkey) as bills
from lines_day where l_returnflag in ('R', 'A') group by 1, 2""")
def _(t):
    d = c.lines_day(t).where(F.col("l_returnflag").isin("R", "A"))
    return d.groupBy(F.last_day("day").alias("period"), F.when(F.col("l_returnflag") == "R", "import").otherwise("export").alias("direction")).agg(
        F.countDistinct("l_orderkey").alias("bills"))


@query("a12_unit_converted_total", ctes("lines_day") + f"""
select period, coalesce(direction, 'all') as direction, {q6('sum(t)', 4)} as tonnes from (select last_day(day) as period, l_returnflag as direction,
  (case when l_linestatus = 'O' then qty::double * 0.45359237 else qty::double end) / 1000.0 as t from lines_day)
group by grouping sets ((period, direction), (period))""")
def _(t):
    unit = F.when(F.col("l_linestatus") == "O", "LB").otherwise("KG")
    out = ag.converted_with_total(c.lines_day(t).withColumnRenamed("l_returnflag", "direction"), F.last_day("day"), "direction", F.col("qty").cast("double"), unit)
    return out.withColumn("tonnes", r6("tonnes", 4))


@query("a13_first_appearance", ctes("orders_day") + """
, f as (select o_custkey, min(date_trunc('month', day)::date) as month from orders_day where o_custkey <> 0 and day < date '2001-07-01' group by 1),
n as (select month, count(*) as new_ids from f group by 1),
r as (select date_trunc('month', day)::date as month, count(*) as records from orders_day where day < date '2001-07-01' group by 1)
select month, records, coalesce(new_ids, 0) as new_ids, (select count(*) from orders_day where day >= date '2001-07-01') as future_rows from r left join n using (month)""")
def _(t):
    past, future = ag.split_future(c.orders_day(t), F.col("day"), F.lit("2001-06-30").cast("date"))
    month = F.trunc("day", "MM")
    rows = past.groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("records"))
    new = ag.first_appearance(past, F.col("o_custkey"), month)
    late = future.agg(F.count(F.lit(1)).alias("n")).scalar()
    return rows.join(new, "month", "left").select("month", "records", F.coalesce("new_ids", F.lit(0)).cast("long").alias("new_ids"), late.alias("future_rows"))


@query("a14_sums_with_sources", ctes("lines_day") + """
select last_day(day) as period, sum(qty)::double as qty, sum(price)::double as price,
  array_to_string(list_sort(list_distinct(list('part_' || l_linenumber))), ';') as sources
from lines_day where l_returnflag = 'R' and l_linestatus = 'O' group by 1""")
def _(t):
    d = c.lines_day(t).where((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"))
    d = d.select(F.last_day("day").alias("period"), "qty", "price", F.concat(F.lit("part_"), F.col("l_linenumber").cast("string")).alias("source"))
    out = ag.sums_with_sources(d.withColumn("qty", F.col("qty").cast("double")).withColumn("price", F.col("price").cast("double")), "period", ["qty", "price"], "source")
    return out.select("period", F.round("qty", 2).alias("qty"), F.round("price", 2).alias("price"), "sources")


@query("a15_guarded_sum", ctes("orders_day") + """
select last_day(day) as period, sum(amount)::double as value from orders_day where indicator = '2-HIGH' group by 1""")
def _(t):
    rows = c.orders_day(t).where(F.col("indicator") == "2-HIGH")
    ag.check_unique(rows, ["o_orderkey"], "orders")
    return rows.groupBy(F.last_day("day").alias("period")).agg(F.sum("amount").cast("double").alias("value"))


_EVENTS = """
, d as (select period as day, count(*) filter (where indicator = 'AF')::bigint as a, count(*) filter (where indicator like 'R%')::bigint as b,
   (sum(qty)::bigint % 7)::bigint as u, bool_or(value > 60000) as attack, bool_or(qty > 50) as alert from flag_day group by 1)"""


def daily_events(t):
    return c.flag_day(t).groupBy(F.col("period").alias("day")).agg(
        F.count_if(F.col("indicator") == "AF").alias("a"), F.count_if(F.col("indicator").startswith("R")).alias("b"),
        (F.sum("qty").cast("long") % 7).alias("u"), F.bool_or(F.col("value") > 60000).alias("attack"), F.bool_or(F.col("qty") > 50).alias("alert"))


@query("a16_monthly_event_index", ctes("flag_day", "line_bounds") + _EVENTS + f"""
, m as (select last_day(day) as period, sum(a)::bigint as a, sum(b)::bigint as b, sum(u)::bigint as u, sum(9 * ln(1 + a) + 3 * ln(1 + b) + ln(1 + u)) as il,
  count(*) filter (where attack) as attack_days, count(*) filter (where alert) as alert_days, count(*) as observed_days
  from d where day <= (select cutoff from line_bounds) group by 1 having count(*) >= day(last_day(min(day))))
select period, a, b, u, {q6('il')} as intensity_log, attack_days, alert_days, observed_days,
  {q6('100 * (il - (select min(il) from m)) / (select max(il) - min(il) from m)')} as intensity_index from m""")
def _(t):
    out = ag.monthly_events(daily_events(t), "day", ["a", "b", "u"], ["attack", "alert"])
    return out.withColumn("intensity_log", r6("intensity_log")).withColumn("intensity_index", r6("intensity_index"))


@query("a17_weighted_pressure", ctes("flag_day") + _EVENTS + f"""
select day, {q6('9 * ln(1 + a) + 3 * ln(1 + b) + ln(1 + u)')} as pressure from d""")
def _(t):
    from periodica.functions.measures import weighted_pressure

    return daily_events(t).select("day", r6(weighted_pressure(F.col("a"), F.col("b"), F.col("u"))).alias("pressure"))


@query("a18_same_day_merge", ctes("orders_day") + """
, o as (select day, o_orderkey as k, (o_orderkey % 5)::bigint as a, (o_custkey % 7)::bigint as b, o_orderstatus = 'F' as hit, indicator from orders_day),
m as (select day, max(a) as a, max(b) as b, bool_or(hit) as hit, arg_max(k, (a + b, indicator, k)) as record from o group by 1),
g as (select unnest(generate_series((select min(day) from m)::timestamp, (select max(day) from m)::timestamp, interval 1 day))::date as day)
select g.day, coalesce(a, 0)::bigint as a, coalesce(b, 0)::bigint as b, coalesce(hit, false) as hit, record,
  case when m.day is null then 'no_record' else 'observed' end as status from g left join m using (day)""")
def _(t):
    o = c.orders_day(t).select("day", F.col("o_orderkey").alias("record"), (F.col("o_orderkey") % 5).alias("a"), (F.col("o_custkey") % 7).alias("b"),
                               (F.col("o_orderstatus") == "F").alias("hit"), F.concat("indicator", F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("published"))
    return ag.merge_same_day(o, "day", ["a", "b"], ["hit"], "published", ["record"])


@query("a19_day_weighted_quarter", ctes("customer_month") + f"""
select indicator, (date_trunc('quarter', period) + interval 3 month - interval 1 day)::date as quarter,
  {qf('sum(value * day(period)) / sum(day(period))')} as value from customer_month group by 1, 2 having count(*) = 3""")
def _(t):
    return ag.quarterly_day_weighted(c.customer_month(t), ["indicator"], "period", "value").withColumn("value", f32("value"))


@query("a20_fixed_membership_mean", ctes("flag_day") + f"""
select period, case when count(value) = 6 then {qf('avg(value)')} end as mean_all from flag_day group by 1""")
def _(t):
    return c.flag_day(t).groupBy("period").agg(f32(complete_avg("value", 6)).alias("mean_all"))


@query("a21_monthly_mean", ctes("priority_day") + f"""
, cut as (select indicator, case when max(period) = last_day(max(period)) then max(period) else last_day((max(period) - interval 1 month)::date) end as c from priority_day group by 1),
m as (select indicator, last_day(period) as period, avg(value) as value from priority_day join cut using (indicator) where period <= c group by 1, 2),
s as (select max(period) as p from (select period from m group by 1 having count(*) = 5))
select indicator, period, {qf('value')} as value from m where period <= (select p from s)""")
def _(t):
    return ag.monthly_mean(c.priority_day(t), ["indicator"], "period", "value", common=True).withColumn("value", f32("value"))


@query("a22_row_sum_rules", ctes("supplier_day") + """
select node, day, case when imports is not null and exports is not null then imports + exports end as both_parts,
  case when imports is not null or exports is not null then coalesce(imports, 0) + coalesce(exports, 0) end as any_part from supplier_day""")
def _(t):
    return c.supplier_day(t).select("node", "day", row_sum(["imports", "exports"], 2).alias("both_parts"), row_sum(["imports", "exports"], 1).alias("any_part"))


_FREQ = "case (substr(indicator, 2)::bigint) % 3 when 0 then 'monthly' when 1 then 'quarterly' else 'yearly' end"


def with_frequency(t):
    n = F.substring("indicator", 2, 12).cast("long") % 3
    return c.customer_month(t).withColumn("frequency", F.when(n == 0, "monthly").when(n == 1, "quarterly").otherwise("yearly"))


@query("a23_completeness", ctes("customer_month") + f"""
, s as (select indicator, {_FREQ} as frequency, min(period) as first_period, max(period) as last_period, count(*) as valid from customer_month group by 1, 2),
e as (select *, (case frequency when 'monthly' then (year(last_period) - year(first_period)) * 12 + month(last_period) - month(first_period) + 1
  when 'quarterly' then (year(last_period) - year(first_period)) * 4 + quarter(last_period) - quarter(first_period) + 1
  else year(last_period) - year(first_period) + 1 end)::bigint as expected from s)
select *, {q6('(expected - valid) / expected * 100')} as missing_pct from e""")
def _(t):
    out = ag.completeness(with_frequency(t), ["indicator"], "period", "value", "frequency")
    return out.withColumn("missing_pct", r6("missing_pct"))


@query("a24_dictionary_counts", """
with p as (select p_name || '/' || p_brand as indicator, min(p_brand) as industry, min(p_type) as kind from part group by 1)
select 'industry' as attribute, industry as label, count(*) as indicators from p group by 2
union all select 'kind', kind, count(*) from p group by 2""")
def _(t):
    p = t.part.select(F.concat_ws("/", "p_name", "p_brand").alias("indicator"), F.col("p_brand").alias("industry"), F.col("p_type").alias("kind"))
    once = p.groupBy("indicator").agg(F.min("industry").alias("industry"), F.min("kind").alias("kind"))
    return ag.dictionary_counts(once, "indicator", ["industry", "kind"])


@query("a25_raw_variable_stats", ctes("customer_month") + f"""
, v as (select indicator, {_FREQ} as frequency, period, case when month(period) = 3 then 0 else value end as value from customer_month),
s as (select indicator, frequency, count(*) filter (where value <> 0) as valid, min(period) filter (where value <> 0) as first_period,
  max(period) filter (where value <> 0) as last_period from v group by 1, 2),
e as (select *, greatest(1, ceil((last_period - first_period + 1) / (case frequency when 'monthly' then 30 when 'quarterly' then 90 else 365 end))) as expected from s)
select indicator, frequency, valid, first_period, last_period, case when valid > 0 then {q6('greatest(0, expected - valid) / expected * 100')} else 100.0::double end as missing_pct from e""")
def _(t):
    v = with_frequency(t).withColumn("value", F.when(F.month("period") == 3, 0.0).otherwise(F.col("value")))
    return ag.raw_variable_stats(v, "indicator", "period", "value", "frequency").withColumn("missing_pct", r6("missing_pct"))


@query("a26_coverage_card", ctes("supplier_day") + f"""
, e as (select max(day) as d from supplier_day), w as (select * from supplier_day, e where day between date_trunc('week', d)::date and d)
select (select date_trunc('week', d)::date from e) as week_start, (select d from e) as week_end, sum(qty) as known_total, count(qty) as known_cells,
  ((select d - date_trunc('week', d)::date + 1 from e) * (select count(*) from supplier))::bigint as expected_cells,
  {q6("count(qty) / ((select d - date_trunc('week', d)::date + 1 from e) * (select count(*) from supplier)) * 100")} as coverage_pct, false as conflict from w""")
def _(t):
    n = t.supplier.agg(F.count(F.lit(1)).alias("n")).scalar()
    return ag.coverage_card(c.supplier_day(t), "node", "day", "qty", n).withColumn("coverage_pct", r6("coverage_pct"))


@query("a27_cohort_shares", ctes("supplier_day") + f"""
, n as (select node, sum(qty) as total, sum(imports) as imports, sum(exports) as exports from supplier_day where month(day) = 5 and year(day) = 1999 group by 1),
k as (select count(*) as cohort, sum(total) as total, sum(imports) as imports, sum(exports) as exports from n where total >= 0 and imports >= 0 and exports >= 0)
select *, {q6('imports / nullif(total, 0) * 100')} as imports_share, {q6('exports / nullif(total, 0) * 100')} as exports_share from k""")
def _(t):
    d = c.supplier_day(t).where((F.month("day") == 5) & (F.year("day") == 1999))
    n = d.groupBy("node").agg(F.sum("qty").alias("total"), F.sum("imports").alias("imports"), F.sum("exports").alias("exports"))
    out = ag.cohort_shares(n, ["imports", "exports"], "total")
    return out.withColumn("imports_share", r6("imports_share")).withColumn("exports_share", r6("exports_share"))


@query("a28_risk_per_origin", ctes("lines_day") + """
select s_suppkey as origin, (select sum(price) from lines_day where l_suppkey = s_suppkey and l_returnflag = 'R')::double as risk from supplier""")
def _(t):
    risk = c.lines_day(t).where(F.col("l_returnflag") == "R").groupBy(F.col("l_suppkey").alias("origin")).agg(F.sum("price").cast("double").alias("risk"))
    return t.supplier.select(F.col("s_suppkey").alias("origin")).join(risk, "origin", "left")


@query("a29_group_contributions", ctes("lines_day", "line_bounds") + """
, m as (select p_brand as indicator, last_day(day) as period, sum(price) as value from lines_day join part on p_partkey = l_partkey group by 1, 2),
a as (select p_brand as indicator, case when avg(p_size) > 25.5 then 'large' else 'small' end as grp from part group by 1)
select period, grp, sum(value)::double as contribution from m join a using (indicator) group by 1, 2""")
def _(t):
    part = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("indicator"), "p_size")
    m = c.lines_day(t).drop("indicator").join(part.drop("p_size"), "l_partkey").groupBy("indicator", F.last_day("day").alias("period")).agg(F.sum("price").alias("value"))
    a = part.groupBy("indicator").agg(F.when(F.avg("p_size") > 25.5, "large").otherwise("small").alias("grp"))
    return ag.group_sums(m, a, "indicator", "period", "grp", "value").withColumn("contribution", F.col("contribution").cast("double"))


_IMPACT = """
, v as (select 'C' || o_custkey as variable, c_mktsegment as industry, (amount - 250000)::decimal(18,2) as impact from orders_day join customer on c_custkey = o_custkey)"""


def impacts(t):
    cust = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("industry"))
    return c.orders_day(t).join(cust, "o_custkey").select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("variable"), "industry",
        (F.col("amount") - 250000).cast("decimal(18,2)").alias("impact"))


@query("a30_impact_rollups", ctes("orders_day") + _IMPACT + f"""
, r as (select 'industry' as level, industry as label, sum(impact) as total, avg(impact::double) as mean, count(*) as n,
  coalesce(sum(impact) filter (where impact > 0), 0) as positive, coalesce(sum(impact) filter (where impact < 0), 0) as negative from v group by 2
  union all select 'variable', variable, sum(impact), avg(impact::double), count(*), coalesce(sum(impact) filter (where impact > 0), 0),
  coalesce(sum(impact) filter (where impact < 0), 0) from v group by 2)
select level, label, total::double as total, {qf('mean')} as mean, n, positive::double as positive, negative::double as negative,
  {q6('abs(total::double) / (select sum(abs(impact)) from v)::double * 100')} as share_pct,
  row_number() over (partition by level order by abs(total) desc, label) as position from r""")
def _(t):
    v = cut_lineage(impacts(t), "impacts")  # each level reads it for its sums and for the whole
    out = None
    for level in ("industry", "variable"):
        r = ag.impact_rollup(v, level, "impact").select(F.lit(level).alias("level"), F.col(level).alias("label"), "total", F.col("n"),
            "positive", "negative", "share_pct", (F.col("total").cast("double") / F.col("n")).alias("mean"))
        r = ag.rank_by_size(r, ["level"], "total", "label", "position")
        out = r if out is None else out.unionByName(r)
    d = lambda x: F.col(x).cast("double").alias(x)
    return out.select("level", "label", d("total"), f32("mean").alias("mean"), "n", d("positive"), d("negative"), r6("share_pct").alias("share_pct"), "position")


@query("a31_movement_counts", ctes("customer_month") + """
, l as (select distinct period from customer_month order by period desc limit 2),
e as (select max(period) as b, min(period) as a from l),
d as (select indicator, c_mktsegment as grp, (sum(value) filter (where period = b)) - (sum(value) filter (where period = a)) as d
  from customer_month, e join customer on true where 'C' || c_custkey = indicator and period in (a, b) group by 1, 2)
select grp, count(*) filter (where d > 0) as up, count(*) filter (where d < 0) as down, count(d) as compared from d group by 1""")
def _(t):
    seg = t.customer.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("indicator"), F.col("c_mktsegment").alias("grp"))
    return ag.movement_counts(c.customer_month(t).join(seg, "indicator"), ["indicator"], "grp", "period", "value")


@query("a32_dictionary_coverage", ctes("customer_month") + f"""
select indicator, {_FREQ} as frequency, min(period) as first_period, least(max(period), case {_FREQ} when 'monthly' then date '2001-04-30'
  when 'quarterly' then date '2001-03-31' else date '2000-12-31' end) as last_period from customer_month group by 1, 2""")
def _(t):
    return ag.dictionary_coverage(with_frequency(t), ["indicator"], "period", "value", "frequency", F.lit("2001-05-20").cast("date"))


_FLAGS = ("AF", "AO", "NF", "NO", "RF", "RO")


@query("a33_pivot_indicators", ctes("flag_month") + """
select period, """ + ", ".join(f"max(qty) filter (where indicator = '{i}') as \"{i}\"" for i in _FLAGS) + """ from flag_month group by 1""")
def _(t):
    return ag.pivot_indicators(c.flag_month(t), "period", "indicator", "qty", list(_FLAGS))


@query("a34_identity_fill", ctes("supplier_day") + """
select node, day, coalesce(imports, qty - exports) as imports, coalesce(exports, qty - imports) as exports from supplier_day""")
def _(t):
    f = ag.fill_by_identity
    return c.supplier_day(t).select("node", "day", f(F.col("imports"), F.col("qty"), F.col("exports")).alias("imports"),
                                    f(F.col("exports"), F.col("qty"), F.col("imports")).alias("exports"))
