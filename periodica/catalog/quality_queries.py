"""Data-quality and history queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from periodica.catalog import carriers as c
from periodica.catalog.carriers import ctes
from periodica.catalog.registry import q6, query, r6
from periodica.operators import quality as qa

D = lambda s: F.lit(s).cast("date")
TS = lambda s: F.lit(s).cast("timestamp")

_VERSIONS = """
, stored as (select indicator, period, case when month(period) = 5 then null else value end as value, 'v1' as source from customer_month where month(period) <> 7),
incoming as (select indicator, period, case when month(period) % 3 = 0 then null else value + 1 end as value, 'v2' as source from customer_month where month(period) >= 5)"""


def versions(t):
    m = c.customer_month(t)
    month = F.month("period")
    stored = m.where(month != 7).select("indicator", "period", F.when(month != 5, F.col("value")).alias("value"), F.lit("v1").alias("source"))
    incoming = m.where(month >= 5).select("indicator", "period", F.when(month % 3 != 0, F.col("value") + 1).alias("value"), F.lit("v2").alias("source"))
    return stored, incoming


@query("q01_null_safe_upsert", ctes("customer_month") + _VERSIONS + """
select coalesce(o.indicator, n.indicator) as indicator, coalesce(o.period, n.period) as period,
  case when n.indicator is not null and (o.indicator is null or n.value is not null or o.value is null) then n.value else o.value end as value,
  case when n.indicator is not null and (o.indicator is null or n.value is not null or o.value is null) then n.source else o.source end as source
from stored o full join incoming n on o.indicator = n.indicator and o.period = n.period""")
def _(t):
    return qa.upsert(*versions(t), ["indicator", "period"])


@query("q02_dictionary_upsert", """
select c_custkey as name, case when c_custkey % 3 = 0 and c_nationkey <> 4 then 'new ' || c_mktsegment else c_mktsegment end as industry from customer""")
def _(t):
    cust = t.customer.select(F.col("c_custkey").alias("name"), F.col("c_mktsegment").alias("industry"), "c_nationkey")
    new = cust.where("name % 3 = 0").select("name", F.concat(F.lit("new "), "industry").alias("industry"))
    return qa.dictionary_upsert(cust.drop("c_nationkey"), new, "name", cust.where("c_nationkey = 4"))


@query("q03_key_uniqueness", """
select l_orderkey, l_linenumber, count(*) as copies from lineitem group by 1, 2 having count(*) > 1""")
def _(t):
    return qa.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("q04_missing_periods", ctes("customer_month") + """
, b as (select indicator, min(period) as a, max(period) as z from customer_month group by 1)
select indicator, last_day(unnest(generate_series(date_trunc('month', a)::timestamp, z::timestamp, interval 1 month))::date) as period from b
except all select indicator, period from customer_month""")
def _(t):
    return qa.missing_periods(c.customer_month(t), ["indicator"], "period", "month")


@query("q05_history_guard", ctes("customer_month") + _VERSIONS + """
select o.indicator, o.period, case when n.indicator is null then 'key_removed' else 'value_erased' end as problem
from stored o left join incoming n on o.indicator = n.indicator and o.period = n.period where n.indicator is null or (o.value is not null and n.value is null)""")
def _(t):
    return qa.history_failures(*versions(t), ["indicator", "period"], ["value"])


@query("q06_check_report", ctes("flag_day") + """
, m as (select indicator, last_day(period) as p, count(*) as n, count(distinct period) as d, count(qty) as v, min(qty) as lo, max(qty) as hi from flag_day group by 1, 2),
o as (select indicator, min(p) as first, max(p) as last, count(*) as months, sum(n) as rows, sum(v) as vals, min(lo) as lo, max(hi) as hi, sum(d) as days,
  (year(max(p)) - year(min(p))) * 12 + month(max(p)) - month(min(p)) + 1 as span, (2002 - year(max(p))) * 12 + 1 - month(max(p)) as lag from m group by 1)
select indicator, 'history_length' as "check", months >= 60 as passed, months::bigint as detail from o union all select indicator, 'monthly_continuity', months = span, (span - months)::bigint from o
union all select indicator, 'fresh', lag between 0 and 3, lag::bigint from o union all select indicator, 'value_range', lo >= 0 and hi <= 500, (rows - vals)::bigint from o
union all select indicator, 'unique_periods', rows = days, (rows - days)::bigint from o""")
def _(t):
    return qa.check_report(c.flag_day(t), ["indicator"], "period", "qty", D("2002-01-15"), 3, 0.0, 500.0, 60)


@query("q07_accounting_closure", ctes("supplier_day", "lines_day") + f"""
, p as (select last_day(day) as period, sum(imports) as parts from supplier_day group by 1), tot as (select last_day(day) as period, sum(qty)::double * 0.335 as total from lines_day group by 1)
select period, parts, {q6('total', 3)} as total, {q6('total - parts', 3)} as residual from p join tot using (period) where abs(total - parts) > 150""")
def _(t):
    p = c.supplier_day(t).select(F.last_day("day").alias("period"), "imports")
    tot = c.lines_day(t).groupBy(F.last_day("day").alias("period")).agg((F.sum("qty").cast("double") * 0.335).alias("total"))
    out = qa.closure_breaks(p, tot, "period", "imports", 150)
    return out.select("period", "parts", r6("total", 3).alias("total"), r6("residual", 3).alias("residual"))


@query("q08_latest_vintage", ctes("orders_day") + """
select indicator, day as period, max_by(o_orderkey, (o_orderstatus, o_orderkey)) as o_orderkey, max(o_orderstatus) as o_orderstatus,
  max_by(amount::double, (o_orderstatus, o_orderkey)) as value, min(amount) <> max(amount) as revised from orders_day group by 1, 2""")
def _(t):
    v = c.orders_day(t).select("indicator", F.col("day").alias("period"), "o_orderkey", "o_orderstatus", F.col("amount").cast("double").alias("value"))
    return qa.latest_vintage(v, ["indicator", "period"], ["o_orderstatus", "o_orderkey"], "value")


@query("q09_source_precedence", ctes("customer_month") + """
, a as (select * from customer_month where month(period) <> 3), b as (select indicator, period, case when month(period) = 8 then value + 5 else value end as value from customer_month where month(period) <> 9)
select coalesce(a.indicator, b.indicator) as indicator, coalesce(a.period, b.period) as period, case when a.indicator is not null then a.value else b.value end as value,
  a.indicator is null as secondary_only, a.indicator is not null and b.indicator is not null and a.value is distinct from b.value as conflict
from a full join b on a.indicator = b.indicator and a.period = b.period""")
def _(t):
    m = c.customer_month(t)
    b = m.where("month(period) <> 9").withColumn("value", F.when(F.month("period") == 8, F.col("value") + 5).otherwise(F.col("value")))
    return qa.combine_sources(m.where("month(period) <> 3"), b, ["indicator", "period"], "value")


@query("q09_unanimous_value", """
select o_custkey, o_orderstatus, case when min(o_orderpriority) = max(o_orderpriority) then min(o_orderpriority) end as priority,
  min(o_orderkey) as o_orderkey from orders group by 1, 2""")
def _(t):
    o = t.orders.withColumnRenamed("o_orderpriority", "priority")
    keys = ["o_custkey", "o_orderstatus"]
    return qa.unanimous(o, keys, "priority").join(qa.first_source(o, keys, "o_orderkey", []), keys)


@query("q10_reject_reasons", ctes("positions") + """
select case when category not in ('view', 'click', 'purchase', 'signup') then 'unsupported type' when user_id % 17 = 0 then 'bad id' when not (abs(lat + case when event_id % 50 = 0 then 90 else 0 end) <= 90) then 'bad position' end as reason,
  count(*) as n from positions group by 1""")
def _(t):
    from periodica.functions.geo import valid_coordinate

    p = c.positions(t).withColumn("lat", F.col("lat") + F.when(F.col("event_id") % 50 == 0, 90.0).otherwise(0.0))
    rules = [(~F.col("category").isin("view", "click", "purchase", "signup"), "unsupported type"), (F.col("user_id") % 17 == 0, "bad id"),
             (~valid_coordinate(F.col("lat"), F.col("lon")), "bad position")]
    return qa.with_reason(p, rules).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("q11_gap_audit", ctes("supplier_day") + """
, g as (select node, unnest(generate_series(timestamp '1999-01-01', timestamp '1999-03-31', interval 1 day))::date as day from (select distinct node from supplier_day)),
m as (select g.*, (node % 2 = 0 and day between date '1999-01-10' and date '1999-01-31') as ok from g left join supplier_day s using (node, day) where s.node is null),
k as (select node, count(*) as missing, count(*) filter (where ok) as source_missing from m group by 1)
select e.node, 90::bigint as expected, 90 - coalesce(missing, 0) as stored, coalesce(source_missing, 0) as source_missing, coalesce(missing - source_missing, 0) as unverified_missing,
  case when coalesce(missing - source_missing, 0) > 0 then 'unverified_gaps' when coalesce(missing, 0) > 0 then 'source_gaps' else 'complete' end as status from (select distinct node from supplier_day) e left join k using (node)""")
def _(t):
    s = t.supplier
    v = s.select(F.col("s_suppkey").alias("node"), D("1999-01-10").alias("first_gap"), D("1999-01-31").alias("last_gap"),
                 F.when(F.col("s_suppkey") % 2 == 0, TS("1999-03-30")).otherwise(TS("1998-01-01")).alias("checked_at"))
    return qa.gap_audit(c.supplier_day(t), "node", "day", D("1999-01-01"), D("1999-03-31"), v, TS("1999-04-02"), 7)


@query("q12_continuous_sampling", """
with r as (select ts, event_type <> 'none' as ok from events where ts >= timestamp '2024-01-10' - interval 3600 second and ts <= timestamp '2024-01-12'),
g as (select *, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) over (order by ts) as gap from r)
select min(ts) <= timestamp '2024-01-10' and max(ts) >= timestamp '2024-01-12' - interval 3600 second and max(gap) <= 3600 and bool_and(ok) as continuous, """ + q6("max(gap)") + """ as largest_gap from g""")
def _(t):
    e = t.events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return qa.continuous_sampling(e, "ts", F.col("event_type") != "none", TS("2024-01-10"), TS("2024-01-12"), 3600).withColumn("largest_gap", r6("largest_gap"))


@query("q13_progress_guard", """
with b as (select 'orders' as source, count(*) as rows, max(o_orderdate)::date as latest from orders union all select 'lineitem', count(*), max(l_shipdate)::date from lineitem
  union all select 'events', count(*), max(ts)::date from events),
a as (select 'orders' as source, count(*) as rows, max(o_orderdate)::date as latest from orders where o_orderstatus <> 'P' union all select 'lineitem', count(*), (max(l_shipdate) - interval 1 day)::date from lineitem
  union all select 'events', count(*), max(ts)::date from events)
select source, case when a.rows < b.rows then 'fewer_rows' else 'date_regressed' end as problem from a join b using (source) where a.rows < b.rows or a.latest < b.latest""")
def _(t):
    o, l = c.orders_day(t), c.lines_day(t)
    e = t.events.select(F.col("ts").cast("date").alias("day"))
    s = qa.progress_summary
    before = s(o, "orders", "day").unionByName(s(l, "lineitem", "day")).unionByName(s(e, "events", "day"))
    after = s(o.where("o_orderstatus <> 'P'"), "orders", "day").unionByName(s(l.withColumn("day", F.date_sub("day", 1)), "lineitem", "day")).unionByName(s(e, "events", "day"))
    return qa.progress_failures(before, after)


@query("q14_series_validation", ctes("customer_month") + """
, v as (select indicator, case when substr(indicator, 2)::bigint % 10 = 0 then 7.0 else value end as value from customer_month)
select indicator, count(value) as valid, case when count(value) < 8 then 'insufficient_data' when var_samp(value) = 0 then 'no_variance' else 'ok' end as verdict from v group by 1""")
def _(t):
    n = F.substring("indicator", 2, 12).cast("long")
    v = c.customer_month(t).withColumn("value", F.when(n % 10 == 0, 7.0).otherwise(F.col("value")))
    return qa.validate_series(v, ["indicator"], "value", 8)


@query("q15_all_or_nothing", ctes("flag_day") + """
, r as (select *, period::timestamp + interval 1 day as fetched from flag_day where period between date '1997-05-01' and date '1997-05-10')
select 'whole' as kind, indicator, period, qty from r where (select count(distinct (indicator, period)) from r) = 6 * 10
union all select 'stored', indicator, period, qty from r""")
def _(t):
    d = c.flag_day(t).withColumn("fetched", F.timestamp_seconds((F.unix_date("period") + 1) * 86400))
    a, b = D("1997-05-01"), D("1997-05-10")
    whole = qa.all_or_nothing(d, "indicator", "period", a, b, F.lit(6), "fetched", TS("1997-05-11"))
    stored = d.where(F.col("period").between(a, b))
    cols = ["indicator", "period", "qty"]
    return whole.select(F.lit("whole").alias("kind"), *cols).unionByName(stored.select(F.lit("stored").alias("kind"), *cols))


@query("q16_newest_source", ctes("orders_day") + """
, p as (select o_custkey % 50 as source, max(day) as newest from orders_day group by 1) select source, newest from p order by newest desc, source desc limit 1""")
def _(t):
    return qa.newest_source(c.orders_day(t).withColumn("source", F.col("o_custkey") % 50), "source", "day")


@query("q17_processing_log", ctes("flag_day", "supplier_day") + """
select 'removed' as step, 'S' || node as variable, 'all_missing' as detail from supplier_day group by node having count(case when node % 7 = 3 then null else imports end) = 0
union all select 'replaced', indicator, count(*)::varchar from flag_day where indicator = 'RF' and qty between 20 and 30 group by 2""")
def _(t):
    from periodica.catalog.filter_queries import RULES
    from periodica.operators import filters as fl

    v = c.supplier_day(t).select(F.concat(F.lit("S"), F.col("node").cast("string")).alias("variable"), F.when(F.col("node") % 7 != 3, F.col("imports")).alias("value"))
    _, log = fl.drop_empty(v, "variable", "value")
    hit = fl.preview_rule(c.flag_day(t), RULES[4], "indicator", "period", "qty").groupBy(F.col("indicator").alias("variable")).agg(F.count(F.lit(1)).cast("string").alias("detail"))
    return qa.processing_log([("removed", log.withColumnRenamed("reason", "detail")), ("replaced", hit)], ["variable", "detail"])


@query("q18_measurement_issues", ctes("supplier_day") + """
, r as (select s_suppkey as node, date '1996-01-01' as f, date '1996-06-30' as l, 'meter fault' as reason from supplier where s_suppkey % 10 = 0
  union all select s_suppkey, date '1996-06-01', date '1997-12-31', 'allocated share' from supplier where s_suppkey % 15 = 0)
select d.node, d.day, d.qty, min(r.reason) as reason from supplier_day d left join r on r.node = d.node and d.day between f and l group by 1, 2, 3""")
def _(t):
    s = t.supplier
    rule = lambda k, a, b, text: s.where(f"s_suppkey % {k} = 0").select(F.col("s_suppkey").alias("node"), D(a).alias("from_day"), D(b).alias("to_day"), F.lit(text).alias("reason"))
    rules = rule(10, "1996-01-01", "1996-06-30", "meter fault").unionByName(rule(15, "1996-06-01", "1997-12-31", "allocated share"))
    return qa.measurement_issues(c.supplier_day(t).select("node", "day", "qty"), rules, ["node"], "day")
