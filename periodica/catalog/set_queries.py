"""Sort, top-k and set-operation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from periodica.catalog import carriers as c
from periodica.catalog.carriers import ctes
from periodica.catalog.registry import q6, query, r6
from periodica.operators import latest as lt
from periodica.operators import setops as so
from periodica.operators import topk as tk


@query("o01_preview", """
select * from ((select 'head' as view, o_orderkey from orders order by o_orderkey limit 10) union all (select 'tail', o_orderkey from orders order by o_orderkey desc limit 10))""")
def _(t):
    k = t.orders.select("o_orderkey")
    v = lambda name: tk.preview(k, ["o_orderkey"], name, 10).select(F.lit(name).alias("view"), "o_orderkey")
    return v("head").unionByName(v("tail"))


_YEAR = ", y as (select p_brand as industry, make_date(year(day), 12, 31) as period, sum(price) as value from lines_day join part on p_partkey = l_partkey group by 1, 2)"


def brand_year(t):
    part = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("industry"))
    return c.lines_day(t).join(part, "l_partkey").groupBy("industry", F.make_date(F.year("day"), F.lit(12), F.lit(31)).alias("period")).agg(F.sum("price").alias("value"))


@query("o02_top_by_latest", ctes("lines_day") + _YEAR + """
, top as (select industry from y where period = (select max(period) from y) order by value desc, industry limit 5)
select industry, period, value::double as value from y where industry in (select industry from top)""")
def _(t):
    return tk.top_by_latest(brand_year(t), "industry", "period", "value").withColumn("value", F.col("value").cast("double"))


@query("o03_pool_others", ctes("lines_day") + _YEAR + """
, s as (select y.*, value::double / (sum(value) over (partition by period))::double as share from y),
top as (select industry from s group by 1 order by avg(share) desc, industry limit 5)
select period, case when industry in (select industry from top) then industry else 'other' end as industry, sum(value)::double as value from s group by 1, 2""")
def _(t):
    from pyspark.sql import Window

    total = F.sum("value").over(Window.partitionBy("period"))
    s = brand_year(t).withColumn("share", F.col("value").cast("double") / total.cast("double"))
    return tk.pool_others(s, "industry", "period", "share", "value").withColumn("value", F.col("value").cast("double"))


@query("o04_most_recent_keys", """
select user_id, max(ts) as last_seen from events group by 1 order by 2 desc, 1 limit 1000""")
def _(t):
    return tk.most_recent_keys(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", 1000)


@query("o05_composite_order", ctes("supplier_day") + """
, d as (select node, sum(qty) as qty from supplier_day where day = date '1999-03-03' group by 1)
select s_suppkey as node, s_name, qty, qty is not null as has_data from supplier left join d on node = s_suppkey order by (qty is not null) desc, coalesce(qty, 0) desc, s_name""")
def _(t):
    d = c.supplier_day(t).where(F.col("day") == F.lit("1999-03-03").cast("date")).groupBy("node").agg(F.sum("qty").alias("qty"))
    p = t.supplier.select(F.col("s_suppkey").alias("node"), "s_name").join(d, "node", "left").withColumn("has_data", F.col("qty").isNotNull())
    return tk.composite_order(p, "has_data", "qty", "s_name")


@query("u01_shared_bounds", """
select least((select min(o_orderdate)::date from orders), (select min(l_shipdate)::date from lineitem)) as first_day,
  greatest((select max(o_orderdate)::date from orders), (select max(l_shipdate)::date from lineitem)) as last_day""")
def _(t):
    return so.shared_bounds([(c.orders_day(t), "day"), (c.lines_day(t), "day")])


@query("u02_except_keys", """
select distinct o_custkey as k from orders where o_orderstatus = 'P' except select distinct o_custkey from orders where o_orderstatus = 'F'""")
def _(t):
    o = t.orders.select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return so.lost_rows(o.where("o_orderstatus = 'P'"), o.where("o_orderstatus = 'F'"), ["k"])


@query("u03_bag_difference", """
with a as (select l_orderkey, l_linenumber from lineitem), b as (select l_orderkey, case when l_tax = 0.08 then 9 else l_linenumber end as l_linenumber from lineitem),
u as (select *, 1 as s from a union all select *, -1 from b)
select l_orderkey, l_linenumber, sum(s)::bigint as surplus from u group by 1, 2 having sum(s) <> 0""")
def _(t):
    a = t.lineitem.select("l_orderkey", "l_linenumber")
    b = t.lineitem.select("l_orderkey", F.when(F.col("l_tax") == 0.08, 9).otherwise(F.col("l_linenumber")).cast("int").alias("l_linenumber"))
    return so.bag_difference(a, b)


@query("u04_common_days", ctes("flag_day") + """
select period from flag_day where qty > 20 group by 1 having count(distinct indicator) = 6""")
def _(t):
    from periodica.operators.joins import common_days

    return common_days(c.flag_day(t).where("qty > 20"), "indicator", "period", 6)


@query("u05_merge_snapshots", ctes("reports") + """
, a as (select mmsi, case when event_id % 11 = 0 then null else observed end as observed, observed as received, event_id from reports where source_no = 0),
b as (select mmsi, observed, observed as received, event_id from reports where source_no > 0), u as (select * from a union all select * from b)
select mmsi, (r).observed as observed, (r).received as received, (r).event_id as event_id from (select mmsi, max_by(struct_pack(observed := observed, received := received, event_id := event_id),
  (coalesce(observed, received), received)) as r from u group by 1)""")
def _(t):
    r = c.reports(t)
    a = r.where("source_no = 0").select("mmsi", F.when(F.col("event_id") % 11 != 0, F.col("observed")).alias("observed"), F.col("observed").alias("received"), "event_id")
    b = r.where("source_no > 0").select("mmsi", "observed", F.col("observed").alias("received"), "event_id")
    return lt.merge_snapshots([a, b], "mmsi", "observed", "received", ["event_id"])
