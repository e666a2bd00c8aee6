"""Projection, filter and predicate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from periodica.catalog import carriers as c
from periodica.catalog.carriers import ctes
from periodica.catalog.registry import query
from periodica.operators import filters as fl
from periodica.operators.filters import ReplacementRule


@query("f01_compare_filter", """
select 'ge' as test, count(*) as n from lineitem where l_quantity >= 25 union all select 'lt', count(*) from lineitem where l_discount < 0.05
union all select 'ne', count(*) from lineitem where l_tax <> 0.02 or l_tax is null""")
def _(t):
    li = t.lineitem
    tests = [("ge", "l_quantity", "≥", 25.0), ("lt", "l_discount", "<", 0.05), ("ne", "l_tax", "≠", 0.02)]
    hit = li.select(*[fl.compare(col, op, v).alias(n) for n, col, op, v in tests]).agg(*[F.count_if(n).alias(n) for n, *_ in tests])
    return hit.unpivot([], ["ge", "lt", "ne"], "test", "n")


@query("f02_last_periods", ctes("priority_day", "priority_month") + """
, l as (select distinct period from priority_month order by 1 desc limit 3)
select 'last' as kind, indicator, period, value from priority_month where period >= (select min(period) from l)
union all select 'custom', indicator, period, value from priority_day where period between date '1998-04-01' and date '1998-09-30'""")
def _(t):
    a = fl.last_periods(c.priority_month(t), "period", 3).withColumn("kind", F.lit("last"))
    b = fl.custom_window(c.priority_day(t), "period", "1998Q2", "1998Q3", "quarter").withColumn("kind", F.lit("custom"))
    return a.unionByName(b).select("kind", "indicator", "period", "value")


@query("f03_trailing_years", ctes("priority_day") + """
select '3y' as kind, indicator, period, value from priority_day where period >= (select (max(period) - interval 36 month)::date from priority_day)
union all select 'custom', indicator, period, value from priority_day where period between date '1997-02-01' and date '1997-05-31'""")
def _(t):
    d = c.priority_day(t)
    a = fl.trailing_years(d, "period", 3).withColumn("kind", F.lit("3y"))
    b = fl.custom_window(d, "period", "1997-02", "1997-05", "month").withColumn("kind", F.lit("custom"))
    return a.unionByName(b).select("kind", "indicator", "period", "value")


@query("f04_rolling_window", ctes("flag_day") + """
, e as (select max(period) as b, min(period) as a from flag_day)
select 'w' as kind, count(*) as n, min(period) as first_day from flag_day, e where period >= greatest(a, b - 6)
union all select 'm1', count(*), min(period) from flag_day, e where period >= greatest(a, (b - interval 1 month)::date + 1)
union all select 'y1', count(*), min(period) from flag_day, e where period >= greatest(a, (b - interval 12 month)::date + 1)
union all select 'y10', count(*), min(period) from flag_day, e where period >= greatest(a, (b - interval 120 month)::date + 1)""")
def _(t):
    rows = fl.in_windows(c.flag_day(t), "period", {"w": None, "m1": 1, "y1": 12, "y10": 120}, "kind")
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("period").alias("first_day"))


@query("f05_month_span", ctes("orders_day") + """
select o_orderkey, day from orders_day where date_trunc('month', day) between date '1999-11-01' and date '2000-02-01'
union all select o_orderkey, day from orders_day where date_trunc('month', day) <= date '1995-03-01'""")
def _(t):
    o = c.orders_day(t)
    return fl.month_span(o, "day", "1999-11", "2000-02").select("o_orderkey", "day").unionByName(
        fl.month_span(o, "day", None, "1995-03").select("o_orderkey", "day"))


@query("f06_trim_to_valid", ctes("supplier_day") + """
, b as (select node, min(day) as a, max(day) as z from supplier_day where imports is not null group by 1)
select s.node, s.day, s.imports from supplier_day s join b using (node) where s.day between a and z""")
def _(t):
    return fl.trim_to_valid(c.supplier_day(t), ["node"], "day", ["imports"]).select("node", "day", "imports")


@query("f07_zero_negative", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, nullif(l_tax, 0) as zero_missing, case when l_tax = 0 then 1.0::double else l_tax end as zero_one,
  case when l_tax - 0.04 < 0 then null else l_tax - 0.04 end as negative_missing, case when l_tax - 0.04 < 0 then 1.0::double else l_tax - 0.04 end as negative_one from lineitem""")
def _(t):
    r = fl.replace_zero_negative
    d = F.col("l_tax") - 0.04
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r("l_tax", "missing").alias("zero_missing"), r("l_tax", "adjust").alias("zero_one"),
                             r(d, negative="missing").alias("negative_missing"), r(d, negative="adjust").alias("negative_one"))


RULES = [
    ReplacementRule("AF", "months", months=(1, 2)),
    ReplacementRule("AO", "weeks_yearly", weeks=(1, 52, 53), replace_with=0.0),
    ReplacementRule("NF", "weeks_monthly", weeks=(5,), replace_with=-1.0),
    ReplacementRule("NO", "date_range", start="1998-01-01", end="1998-06-30"),
    ReplacementRule("RF", "condition", condition="between", value=20.0, value2=30.0, replace_with=25.0),
    ReplacementRule("RF", "condition", condition="gt", value=400.0),
    ReplacementRule("RO", "condition", condition="isnull", replace_with=0.0),
]
_RULED = """case when indicator = 'AF' and month(period) in (1, 2) then null when indicator = 'AO' and week(period) in (1, 52, 53) then 0
  when indicator = 'NF' and (day(period) - 1) // 7 + 1 = 5 then -1 when indicator = 'NO' and period between date '1998-01-01' and date '1998-06-30' then null
  when indicator = 'RF' and qty between 20 and 30 then 25 when indicator = 'RF' and qty > 400 then null else qty end"""


@query("f08_replacement_rules", ctes("flag_day") + f"select indicator, period, ({_RULED})::double as qty from flag_day")
def _(t):
    return fl.apply_rules(c.flag_day(t).select("indicator", "period", "qty"), RULES, "indicator", "period", "qty")


@query("f08_rule_preview", ctes("flag_day") + """
select indicator, period, qty as old_value, 25.0::double as new_value from flag_day where indicator = 'RF' and qty between 20 and 30
union all select indicator, period, qty, null from flag_day where indicator = 'AF' and month(period) in (1, 2)""")
def _(t):
    d = c.flag_day(t)
    p = lambda r: fl.preview_rule(d, r, "indicator", "period", "qty")
    return p(RULES[4]).unionByName(p(RULES[0]))


@query("f09_drop_empty", ctes("supplier_day") + """
, v as (select case when node % 10 = 9 then 'Unnamed: ' || node else 'S' || node end as series, day, case when node % 7 = 3 then null else imports end as value from supplier_day)
select series, count(value) as kept, case when lower(series) like 'unnamed%' then 'unnamed' when count(value) = 0 then 'all_missing' end as reason from v group by 1""")
def _(t):
    n = F.col("node")
    v = c.supplier_day(t).select(F.when(n % 10 == 9, F.concat(F.lit("Unnamed: "), n.cast("string"))).otherwise(F.concat(F.lit("S"), n.cast("string"))).alias("series"),
                                 "day", F.when(n % 7 != 3, F.col("imports")).alias("value"))
    kept, log = fl.drop_empty(v, "series", "value")
    names = v.groupBy("series").agg(F.count("value").alias("kept"))
    return names.join(log, "series", "left")


@query("f09_duplicate_columns", ctes("supplier_day") + """
, v as (select 'S' || (node % 40) as series, node as position, day, case when node % 7 = 3 then null else imports end as value from supplier_day
  union all select 'T' || node, node + 1000, day, case when node % 7 = 3 then null else imports end from supplier_day where node % 6 = 1 and node <= 40),
f as (select series, min(position) as first from v group by 1),
kept as (select v.* from v join f using (series) where position = first),
content as (select series, string_agg(day || '=' || value, ';' order by day) as body from kept where value is not null group by 1),
copies as (select series, min(series) over (partition by body) as kept from content)
select distinct v.series, v.position::bigint as position, v.series as kept, 'duplicate_column' as reason from v join f using (series) where v.position > first
union all select series, null, kept, 'same_content' from copies where series <> kept""")
def _(t):
    node, value = F.col("node"), F.when(F.col("node") % 7 != 3, F.col("imports")).alias("value")
    d = c.supplier_day(t)
    named = d.select(F.concat(F.lit("S"), (node % 40).cast("string")).alias("series"), node.cast("long").alias("position"), "day", value)
    again = d.where((node % 6 == 1) & (node <= 40)).select(F.concat(F.lit("T"), node.cast("string")).alias("series"), (node + 1000).cast("long").alias("position"), "day", value)
    kept, names = fl.drop_repeated_names(named.unionByName(again), "series", "position")
    copies = fl.same_content(kept, "series", "day", "value")
    return names.unionByName(copies.withColumn("position", F.lit(None).cast("long")))


@query("f10_label_selection", """
select event_id from events where coalesce(nullif(case when user_id % 4 = 0 then '' when user_id % 4 = 1 then 'CN' else event_type end, ''), 'unknown') in ('unknown', 'CN', 'view')
  and coalesce(case when event_id % 5 = 0 then null else event_type end, 'unknown') in ('unknown', 'click')""")
def _(t):
    flag = F.when(F.col("user_id") % 4 == 0, "").when(F.col("user_id") % 4 == 1, "CN").otherwise(F.col("event_type"))
    dest = F.when(F.col("event_id") % 5 != 0, F.col("event_type"))
    return t.events.where(fl.matches_selection(F.lit(None).cast("string"), flag, dest, ["unknown", "CN", "view"], ["unknown", "click"])).select("event_id")


@query("f11_pair_either_way", """
select c_custkey, s_suppkey from customer join supplier on c_custkey % 1000 = s_suppkey join nation cn on cn.n_nationkey = c_nationkey join nation sn on sn.n_nationkey = s_nationkey
where list_sort([cn.n_name, sn.n_name]) = ['NATION_3', 'NATION_7'] or list_sort([cn.n_name, sn.n_name]) = ['NATION_1', 'NATION_2']""")
def _(t):
    cn = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("origin"))
    sn = t.nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("dest"))
    legs = t.customer.withColumn("s_suppkey", F.col("c_custkey") % 1000).join(t.supplier, "s_suppkey").join(cn, "c_nationkey").join(sn, "s_nationkey")
    o, d = F.col("origin"), F.col("dest")
    return legs.where(fl.is_pair(o, d, ("NATION_3", "NATION_7")) | fl.is_pair(o, d, ("NATION_1", "NATION_2"))).select("c_custkey", "s_suppkey")


_O = "case when o_custkey % 3 = 0 then 'Dubai Intl ' || o_orderpriority when o_custkey % 3 = 1 then 'Al Maktoum' else 'Rotterdam' end"
_D = "case when o_orderkey % 4 = 0 then 'ae-' || o_orderstatus when o_orderkey % 4 = 1 then 'DXB' else 'Delhi' end"


@query("f12_direction_marks", f"""
with x as (select upper({_O}) as o, upper({_D}) as d from orders),
m as (select (o like 'AE%' or o like '%DUBAI%' or o like '%DXB%' or o like '%DWC%' or o like '%AL MAKTOUM%') as oh,
  (d like 'AE%' or d like '%DUBAI%' or d like '%DXB%' or d like '%DWC%' or d like '%AL MAKTOUM%') as dh from x)
select case when oh and dh then 'domestic' when dh then 'import' when oh then 'export' else 'transit' end as direction, count(*) as n from m group by 1""")
def _(t):
    k, u = F.col("o_orderkey") % 4, F.col("o_custkey") % 3
    o = F.when(u == 0, F.concat(F.lit("Dubai Intl "), "o_orderpriority")).when(u == 1, "Al Maktoum").otherwise("Rotterdam")
    d = F.when(k == 0, F.concat(F.lit("ae-"), "o_orderstatus")).when(k == 1, "DXB").otherwise("Delhi")
    none = F.lit(None).cast("string")
    return t.orders.groupBy(fl.direction_of(o, none, d, none).alias("direction")).agg(F.count(F.lit(1)).alias("n"))


@query("f13_ship_class", """
with e as (select (user_id % 105)::int as code from events)
select code, case when code between 80 and 89 then 'tanker' when code between 70 and 79 then 'cargo' when code between 60 and 69 then 'passenger' when code = 30 then 'fishing'
  when code in (31, 32, 50, 51, 52, 53, 54, 55, 58) then 'tug' when code in (36, 37) then 'pleasure' when code between 1 and 99 then 'other' else 'unknown' end as category, count(*) as n
from e group by 1, 2""")
def _(t):
    e = t.events.select((F.col("user_id") % 105).cast("int").alias("code"))
    return e.groupBy("code", fl.ship_class(F.col("code")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("f14_retired_exclusion", ctes("customer_month") + """
select indicator, period, value from customer_month where indicator not in (select 'C' || c_custkey from customer where c_mktsegment = 'MACHINERY')""")
def _(t):
    retired = t.customer.where("c_mktsegment = 'MACHINERY'").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("indicator"))
    return fl.exclude_listed(c.customer_month(t), retired, ["indicator"])


@query("f15_monthly_cleanup", ctes("flag_day") + """
, f as (select indicator, date_trunc('month', period)::date as period, min_by(case when qty < 40 then 0 else qty end, period) as value from flag_day where year(period) >= 1996 group by 1, 2)
select indicator, period, case when indicator = 'AF' and month(period) in (1, 2) then null else nullif(value, 0) end as value from f""")
def _(t):
    d = c.flag_day(t).select("indicator", F.col("period").alias("day"), F.when(F.col("qty") < 40, 0.0).otherwise(F.col("qty")).alias("value"))
    return fl.monthly_cleanup(d, ["indicator"], "day", "value", "AF", from_year=1996).select("indicator", "period", "value")


@query("f16_disjoint_windows", ctes("supplier_day") + """
select node, day, qty from supplier_day where (day between date '1996-01-10' and date '1996-01-20' or day between date '1999-06-01' and date '1999-06-05')
union all select node, day, qty from supplier_day where day between date '2001-01-01' and date '2001-01-31' and day::timestamp + to_hours((node % 48)::int) > timestamp '2001-01-15'""")
def _(t):
    d = c.supplier_day(t)
    a = fl.in_periods(d, "day", [("1996-01-10", "1996-01-20"), ("1999-06-01", "1999-06-05"), ("2000-02-02", "2000-01-01")])
    fetched = F.timestamp_seconds(F.unix_date("day") * 86400 + F.col("node") % 48 * 3600)
    b = fl.fetched_since(fl.in_periods(d, "day", [("2001-01-01", "2001-01-31")]).withColumn("fetched", fetched), "fetched", F.lit("2001-01-15").cast("timestamp"))
    return a.select("node", "day", "qty").unionByName(b.select("node", "day", "qty"))
