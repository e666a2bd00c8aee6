"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from periodica.catalog import carriers as c
from periodica.catalog.carriers import ctes
from periodica.catalog.registry import q6, query, r6
from periodica.functions import geo
from periodica.operators import joins as jn
from periodica.operators import spine as sp

D = lambda s: F.lit(s).cast("date")


@query("j01_align_components", ctes("flag_month", "priority_month") + """
, tot as (select period, sum(value::decimal(18,2))::double as total from priority_month group by 1)
select indicator, period, value, total from flag_month join tot using (period)""")
def _(t):
    tot = c.priority_month(t).groupBy("period").agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))
    return jn.align_components(tot, c.flag_month(t).select("indicator", "period", "value"), "period")


@query("j02_outer_pair", ctes("customer_month") + """
select coalesce(a.k, b.k) as k, coalesce(a.period, b.period) as period, a.value as x, b.value as y
from (select substr(indicator, 2)::bigint // 2 as k, period, value from customer_month where substr(indicator, 2)::bigint % 2 = 0) a
full join (select substr(indicator, 2)::bigint // 2 as k, period, value from customer_month where substr(indicator, 2)::bigint % 2 = 1) b on a.k = b.k and a.period = b.period""")
def _(t):
    n = F.substring("indicator", 2, 12).cast("long")
    m = c.customer_month(t).select(F.floor(n / 2).cast("long").alias("k"), (n % 2).alias("odd"), "period", "value")
    return jn.outer_pair(m.where("odd = 0").drop("odd"), m.where("odd = 1").drop("odd"), ["k", "period"], "x", "y")


@query("j06_nearest_prior", ctes("customer_month") + """
, o as (select 'C' || o_custkey as indicator, o_orderdate::date as period, sum(o_totalprice::decimal(18,2))::double as value from orders group by 1, 2),
m as (select a.indicator, a.period, min_by(b.value, (abs(b.period - (a.period - interval 12 month)::date), -(b.period - date '1970-01-01'))) as prior
  from o a join o b on a.indicator = b.indicator and abs(b.period - (a.period - interval 12 month)::date) <= 30 group by 1, 2)
select o.indicator, o.period, o.value, prior from o left join m using (indicator, period)""")
def _(t):
    o = c.orders_day(t).groupBy(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("indicator"), F.col("day").alias("period")).agg(
        F.sum("amount").cast("double").alias("value"))
    return jn.nearest_prior(o, ["indicator"], "period", "value")


@query("j07_weight_for_year", ctes("flag_month") + """
, wts as (select indicator, 1996 as y, case when indicator like 'A%' then 0.2 else 0.1 end::double as weight from (select distinct indicator from flag_month)
  union all select indicator, 1998, 0.3::double from (select distinct indicator from flag_month) where indicator like '%O'
  union all select indicator, 2000, 0.15::double from (select distinct indicator from flag_month))
select indicator, period, coalesce((select max_by(weight, y) from wts w where w.indicator = f.indicator and y <= year(period)), 0)::double as weight from flag_month f""")
def _(t):
    m = c.flag_month(t).select("indicator", "period")
    w = m.select("indicator").distinct().select(
        "indicator", F.when(F.col("indicator").startswith("A"), 0.2).otherwise(0.1).alias("weight_1996"),
        F.when(F.col("indicator").endswith("O"), 0.3).alias("weight_1998"), F.lit(0.15).alias("weight_2000"))
    return jn.weight_for_year(m, jn.unpivot_weights(w, "indicator"), "indicator", "period")


@query("j08_backward_asof", ctes("orders_day", "priority_month") + """
select o_orderkey, o.indicator, day, value as nowcast from orders_day o asof left join priority_month m on o.indicator = m.indicator and o.day >= m.period""")
def _(t):
    o = c.orders_day(t).select("o_orderkey", "indicator", "day")
    return jn.backward_asof(o, c.priority_month(t), ["indicator"], "day", "period", "value", "nowcast")


@query("j09_nearest_day", ctes("flag_day") + """
, full_days as (select period from flag_day group by 1 having count(distinct indicator) = 6)
select (select min_by(period, (abs(period - date '1994-12-20'), period)) from flag_day) as nearest_any,
  (select min_by(period, (abs(period - date '2001-11-01'), period)) from full_days) as nearest_common""")
def _(t):
    d = c.flag_day(t)
    a = jn.nearest_day(d, "period", D("1994-12-20")).withColumnRenamed("nearest", "nearest_any")
    b = jn.nearest_day(jn.common_days(d, "indicator", "period", 6), "period", D("2001-11-01"))
    return a.withColumn("nearest_common", b.scalar())


@query("j10_nearest_both_sides", ctes("supplier_day") + """
select max(day) filter (where day <= date '1999-02-14') as before, min(day) filter (where day >= date '1999-02-14') as after from supplier_day where imports >= 40""")
def _(t):
    return jn.nearest_both_sides(c.supplier_day(t), "day", D("1999-02-14"), F.col("imports") >= 40)


@query("j11_dictionary_join", ctes("customer_month") + """
select indicator, period, value, c_mktsegment as industry from customer_month join customer on 'C' || c_custkey = indicator""")
def _(t):
    dim = t.customer.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("indicator"), F.col("c_mktsegment").alias("industry"))
    return jn.attach_dimension(c.customer_month(t), dim, "indicator")


@query("j12_substring_match", """
with n as (select p_brand || ' ' || p_type || ' ' || p_name as name, min(p_partkey) as ord from part group by 1),
tk as (select distinct split_part(p_name, ' ', 2) as token from part union select distinct p_brand from part),
h as (select token, min_by(name, ord) as matched, min(ord) as matched_order from tk join n on contains(name, token) group by 1)
select *, 'exact' as pass from h""")
def _(t):
    from periodica.functions.text import normalise_name

    n = t.part.groupBy(F.concat_ws(" ", "p_brand", "p_type", "p_name").alias("name")).agg(F.min("p_partkey").alias("ord"))
    tk = t.part.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("token")).union(t.part.select("p_brand")).distinct()
    return jn.name_match(tk, n, "token", "name", "ord", normalise_name)


BOXES = [("strait", 24.0, 24.12, 53.5, 55.0), ("gulf", 24.1, 24.3, 53.5, 54.6), ("bay", 24.0, 24.4, 54.9, 56.0)]
RING_IN = geo.inset_box(24.10037, 24.30037, 53.9, 54.6, 0.02)
RING_OUT = geo.inset_box(24.10037, 24.30037, 53.9, 54.6, -0.02)


@query("j13_point_in_box", ctes("positions") + """
select event_id, case when lat between 24.0 and 24.12 and lon between 53.5 and 55.0 then 'strait' when lat between 24.1 and 24.3 and lon between 53.5 and 54.6 then 'gulf'
  when lat between 24.0 and 24.4 and lon between 54.9 and 56.0 then 'bay' end as region from positions""")
def _(t):
    return c.positions(t).select("event_id", geo.region_of(F.col("lat"), F.col("lon"), BOXES).alias("region"))


@query("j14_ring_side", ctes("positions") + """
select event_id, case when lat > 24.12037 and lat < 24.28037 and lon > 53.92 and lon < 54.58 then true
  when not (lat > 24.08037 and lat < 24.32037 and lon > 53.88 and lon < 54.62) then false end as inside from positions""")
def _(t):
    return c.positions(t).select("event_id", geo.side_of(F.col("lat"), F.col("lon"), RING_IN, RING_OUT).alias("inside"))


@query("j15_snapshot_enrich", ctes("supplier_day") + """
, d as (select node, sum(qty) as day_qty from supplier_day where day = date '1999-03-03' group by 1),
r as (select node, sum(qty) as week_qty from supplier_day where day between date '1999-02-25' and date '1999-03-03' group by 1)
select s_suppkey as node, s_name, day_qty, d.node is not null as has_day, week_qty, r.node is not null as has_week
from supplier left join d on d.node = s_suppkey left join r on r.node = s_suppkey""")
def _(t):
    f = c.supplier_day(t)
    d = f.where(F.col("day") == D("1999-03-03")).groupBy("node").agg(F.sum("qty").alias("day_qty"))
    r = f.where(F.col("day").between(D("1999-02-25"), D("1999-03-03"))).groupBy("node").agg(F.sum("qty").alias("week_qty"))
    return jn.decorate(t.supplier.select(F.col("s_suppkey").alias("node"), "s_name"), "node", [(d, "has_day"), (r, "has_week")])


@query("j16_first_days_count", ctes("lines_day", "line_bounds") + """
, x as (select l_partkey as part, day from lines_day where day <= (select cutoff from line_bounds)), f as (select part, min(day) as first_day from x group by 1)
select f.part, f.first_day, count(x.day) as count_first_days from f left join x on x.part = f.part and x.day between f.first_day and f.first_day + 27 group by 1, 2""")
def _(t):
    x = c.lines_day(t).select(F.col("l_partkey").alias("part"), "day")
    return jn.first_days_count(x, "part", "day", 28, c.line_cutoff(t))


@query("j17_dense_grid", ctes("sales", "line_bounds") + """
, k as (select w::date as week_start from line_bounds, generate_series(timestamp '1995-01-02', date_trunc('week', d)::timestamp, interval 7 day) g(w)
  where w <= case when d >= date_trunc('week', d) + interval 6 day then date_trunc('week', d) else date_trunc('week', d) - interval 7 day end and w + interval 6 day <= cutoff),
n as (select project, date_trunc('week', day)::date as week_start, count(*) as sales from sales group by 1, 2)
select p.project, k.week_start, coalesce(n.sales, 0) as sales from (select distinct project from sales) p cross join k left join n using (project, week_start)""")
def _(t):
    n = c.sales(t).groupBy("project", F.trunc("day", "WEEK").alias("week_start")).agg(F.count(F.lit(1)).alias("sales"))
    weeks = c.lines_day(t).agg(F.max("day").alias("d")).select(sp.complete_weeks(D("1995-01-02"), F.col("d")).alias("w"))
    return jn.dense_grid(n, "project", weeks, "week_start", "sales").select("project", "week_start", "sales")


@query("j18_lost_keys", ctes("customer_month") + """
select indicator, period from customer_month where not (month(period) <> 2 or value > 100000)""")
def _(t):
    m = c.customer_month(t)
    return jn.lost_keys(m, m.where("month(period) <> 2 or value > 100000"), ["indicator", "period"])


@query("j19_not_exists", """
select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P') and c_nationkey not in (select n_nationkey from nation where n_regionkey = 1)""")
def _(t):
    o = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    n = t.nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return t.customer.join(o, "c_custkey", "left_anti").join(n, "c_nationkey", "left_anti").select("c_custkey")


@query("j20_changed_rows", ctes("customer_month") + """
select indicator, period, round(value, 1) as value from customer_month where month(period) = 4 or round(value, 1) <> value""")
def _(t):
    m = c.customer_month(t)
    stored = m.where("month(period) <> 4")
    return jn.changed_rows(stored, m.withColumn("value", F.round("value", 1)), ["indicator", "period"], "value")


@query("j21_latest_attach", ctes("supplier_day") + """
, l as (select node, max(day) as day, max_by(qty, day) as qty from supplier_day where qty > 60 group by 1)
select s_suppkey as node, s_name, l.day, l.qty from supplier left join l on node = s_suppkey""")
def _(t):
    h = c.supplier_day(t).where("qty > 60")
    return jn.latest_attach(t.supplier.select(F.col("s_suppkey").alias("node"), "s_name"), h, "node", "day", ["qty"])


@query("j22_hierarchy_closure", """
with recursive e as (select c_custkey // 2 as parent, c_custkey as child from customer where c_custkey > 1),
r as (select parent as ancestor, child as descendant, 1 as depth from e union all select r.ancestor, e.child, r.depth + 1 from r join e on e.parent = r.descendant)
select ancestor, descendant, depth from r""")
def _(t):
    k = F.col("c_custkey")
    return jn.closure(t.customer.where(k > 1).select(F.floor(k / 2).cast("long").alias("parent"), k.alias("child")))


_SETS = """
with m as (select distinct 'A' || (c_custkey % 40) as scope, c_nationkey as member from customer
  union select 'R' || n_regionkey, n_nationkey from nation union select 'N' || n_nationkey, n_nationkey from nation),
s as (select scope, count(*) as size from m group by 1),
p as (select x.scope as a, y.scope as b, sx.size as na, sy.size as nb, count(*) as overlap from m x join m y using (member) join s sx on sx.scope = x.scope join s sy on sy.scope = y.scope
  where sx.size < sy.size or (sx.size = sy.size and x.scope < y.scope) group by all)
select *, case when overlap = na and na = nb then 'equal' when overlap = na then 'contained' else 'crossing' end as relation from p"""


@query("j23_set_relations", _SETS)
def _(t):
    n = t.nation
    m = (
        t.customer.select(F.concat(F.lit("A"), (F.col("c_custkey") % 40).cast("string")).alias("scope"), F.col("c_nationkey").alias("member"))
        .union(n.select(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")), "n_nationkey"))
        .union(n.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")), "n_nationkey")).distinct()
    )
    return jn.set_relations(m, [])


@query("j24_merge_frames", ctes("flag_month", "priority_month") + """
, u as (select indicator, period, value, 0 as o from flag_month union all select indicator, period, -value, 1 from flag_month where month(period) = 6
  union all select indicator, period, value, 2 from priority_month)
select indicator, period, max_by(value, o) as value from u group by 1, 2""")
def _(t):
    f = c.flag_month(t).select("indicator", "period", "value")
    june = f.where("month(period) = 6").withColumn("value", -F.col("value"))
    return jn.merge_frames([f, june, c.priority_month(t)], "indicator", "period", "value")


_PAIRS = """
, s as (select substr(indicator, 2)::bigint as n, period as ts, value from customer_month),
p as (select c_custkey as target, c_custkey + 1 as candidate from customer where c_custkey % 2 = 0)"""


def customer_pairs(t):
    s = c.customer_month(t).select(F.substring("indicator", 2, 12).cast("long").alias("series"), F.col("period").alias("ts"), "value")
    p = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("target"), (F.col("c_custkey") + 1).alias("candidate"))
    return s, p


@query("j25_pair_alignment", ctes("customer_month") + _PAIRS + """
, b as (select n, min(ts) as a, max(ts) as z from s group by 1),
r as (select target, candidate, greatest(x.a, y.a) as f, least(x.z, y.z) as l from p join b x on x.n = target join b y on y.n = candidate),
g as (select r.target, r.candidate, count(*) filter (where s.n = r.target) as own_points, count(*) filter (where s.n = r.candidate) as other_points
  from r join s on (s.n = r.target or s.n = r.candidate) and ts between f and l group by 1, 2),
k as (select target, candidate, count(*) as common_points from p join s x on x.n = target join s y on y.n = candidate and y.ts = x.ts group by 1, 2)
select target, candidate, own_points, other_points, coalesce(common_points, 0) as common_points from g left join k using (target, candidate)""")
def _(t):
    s, p = customer_pairs(t)
    g = jn.align_pairs(s, p, strict=False).groupBy("target", "candidate").agg(
        F.count_if(F.col("side") == "target").alias("own_points"), F.count_if(F.col("side") == "candidate").alias("other_points"))
    k = jn.align_pairs(s, p, strict=True).groupBy("target", "candidate").agg(F.count(F.lit(1)).alias("common_points"))
    return g.join(k, ["target", "candidate"], "left").withColumn("common_points", F.coalesce("common_points", F.lit(0)))
