"""Observation frames derived from the star-schema tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from periodica.catalog.registry import Tables
from periodica.functions.calendar import last_complete_month

MONEY = "decimal(18,2)"


def orders_day(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        F.col("o_orderpriority").alias("indicator"),
        F.col("o_orderdate").cast("date").alias("day"),
        F.col("o_totalprice").cast(MONEY).alias("amount"),
    )


def order_cutoff(t: Tables):
    """Last complete month of the order table as a scalar subquery."""
    return (
        t.orders.agg(F.max(F.col("o_orderdate").cast("date")).alias("d"))
        .select(last_complete_month("d").alias("d")).scalar()
    )


def priority_day(t: Tables) -> DataFrame:
    return (
        orders_day(t).groupBy("indicator", F.col("day").alias("period"))
        .agg(F.sum("amount").cast("double").alias("value"))
    )


def priority_month(t: Tables) -> DataFrame:
    return (
        orders_day(t).where(F.col("day") <= order_cutoff(t))
        .groupBy("indicator", F.last_day("day").alias("period"))
        .agg(F.sum("amount").cast("double").alias("value"))
    )


def customer_month(t: Tables) -> DataFrame:
    """Sparse series: most customers skip months, so calendar gaps are common."""
    return (
        orders_day(t).groupBy(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("indicator"),
                              F.last_day("day").alias("period"))
        .agg(F.sum("amount").cast("double").alias("value"))
    )


def lines_day(t: Tables) -> DataFrame:
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus",
        F.concat("l_returnflag", "l_linestatus").alias("indicator"),
        F.col("l_shipdate").cast("date").alias("day"),
        F.col("l_quantity").cast(MONEY).alias("qty"),
        F.col("l_extendedprice").cast(MONEY).alias("price"),
    )


def line_cutoff(t: Tables):
    return (
        t.lineitem.agg(F.max(F.col("l_shipdate").cast("date")).alias("d"))
        .select(last_complete_month("d").alias("d")).scalar()
    )


def flag_day(t: Tables) -> DataFrame:
    return (
        lines_day(t).groupBy("indicator", F.col("day").alias("period"))
        .agg(F.sum("price").cast("double").alias("value"), F.sum("qty").cast("double").alias("qty"))
    )


def flag_month(t: Tables) -> DataFrame:
    return (
        lines_day(t).where(F.col("day") <= line_cutoff(t))
        .groupBy("indicator", F.last_day("day").alias("period"))
        .agg(F.sum("price").cast("double").alias("value"), F.sum("qty").cast("double").alias("qty"))
    )


def supplier_day(t: Tables) -> DataFrame:
    return (
        lines_day(t).groupBy(F.col("l_suppkey").alias("node"), "day")
        .agg(F.count(F.lit(1)).cast("double").alias("calls"), F.sum("qty").cast("double").alias("qty"),
             F.sum(F.when(F.col("l_returnflag") == "R", F.col("qty"))).cast("double").alias("imports"),
             F.sum(F.when(F.col("l_returnflag") != "R", F.col("qty"))).cast("double").alias("exports"))
    )


def sales(t: Tables) -> DataFrame:
    """Transactions by project (brand)."""
    lines = lines_day(t)
    part = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    return lines.join(part, "l_partkey").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                    F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("sale_id"),
        F.col("p_brand").alias("project"), F.col("p_type").alias("type"), "day",
        F.col("l_returnflag").alias("usage"), F.col("l_linestatus").alias("reg"), F.col("price").alias("worth"),
    )


def positions(t: Tables, keep_ts: bool = False, events: DataFrame | None = None) -> DataFrame:
    """Vessel reports: event time replayed at sixty times speed on coherent tracks."""
    origin = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    sec = F.floor(
        (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(origin.cast("timestamp"))) / 60000000
    ).cast("long")
    phase = (F.col("sec") + F.col("user_id") * 420) % 7200
    return (
        (t.events if events is None else events).withColumn("sec", sec)
        .withColumn("tri", F.least(phase, 7200 - phase).cast("double"))
        .select(
            (F.col("user_id") + 100000000).cast("string").alias("mmsi"),
            F.timestamp_seconds(F.col("sec") + 1704067200).alias("observed"),
            (F.lit(24.0) + F.col("tri") / 3600.0 * 0.4).alias("lat"),
            (F.lit(54.0) + (F.col("user_id") % 4).cast("double") * 0.5).alias("lon"),
            (F.col("event_id") % 3).cast("int").alias("source_no"),
            F.concat(F.lit("src"), (F.col("event_id") % 3).cast("string")).alias("source"),
            F.col("event_type").alias("category"),
            (F.col("value") / 10).alias("sog"),
            "event_id", "user_id", *([F.col("ts").cast("timestamp").alias("ts")] if keep_ts else []),
        )
    )


def reports(t: Tables, events: DataFrame | None = None) -> DataFrame:
    """The same reports at their real event time."""
    return positions(t, keep_ts=True, events=events).drop("observed").withColumnRenamed("ts", "observed")


def event_stream(t: Tables) -> DataFrame:
    """The event table as a stream of files; the glob matches one file or a folder of parts."""
    return t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events.parque[t]")


# SQL twins; each value is one CTE.
CTE = {
    "orders_day": """orders_day as (select o_orderkey, o_custkey, o_orderstatus, o_orderpriority as indicator,
        o_orderdate::date as day, o_totalprice::decimal(18,2) as amount from orders)""",
    "order_bounds": """order_bounds as (select max(day) as d, case when max(day) = last_day(max(day)) then max(day)
        else last_day((max(day) - interval 1 month)::date) end as cutoff from (select o_orderdate::date as day from orders))""",
    "priority_day": """priority_day as (select o_orderpriority as indicator, o_orderdate::date as period,
        sum(o_totalprice::decimal(18,2))::double as value from orders group by 1, 2)""",
    "priority_month": """priority_month as (select o_orderpriority as indicator, last_day(o_orderdate::date) as period,
        sum(o_totalprice::decimal(18,2))::double as value from orders
        where o_orderdate::date <= (select cutoff from order_bounds) group by 1, 2)""",
    "customer_month": """customer_month as (select 'C' || o_custkey as indicator, last_day(o_orderdate::date) as period,
        sum(o_totalprice::decimal(18,2))::double as value from orders group by 1, 2)""",
    "lines_day": """lines_day as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus,
        l_returnflag || l_linestatus as indicator, l_shipdate::date as day, l_quantity::decimal(18,2) as qty,
        l_extendedprice::decimal(18,2) as price from lineitem)""",
    "line_bounds": """line_bounds as (select max(day) as d, case when max(day) = last_day(max(day)) then max(day)
        else last_day((max(day) - interval 1 month)::date) end as cutoff from (select l_shipdate::date as day from lineitem))""",
    "flag_day": """flag_day as (select l_returnflag || l_linestatus as indicator, l_shipdate::date as period,
        sum(l_extendedprice::decimal(18,2))::double as value, sum(l_quantity::decimal(18,2))::double as qty
        from lineitem group by 1, 2)""",
    "flag_month": """flag_month as (select l_returnflag || l_linestatus as indicator, last_day(l_shipdate::date) as period,
        sum(l_extendedprice::decimal(18,2))::double as value, sum(l_quantity::decimal(18,2))::double as qty
        from lineitem where l_shipdate::date <= (select cutoff from line_bounds) group by 1, 2)""",
    "supplier_day": """supplier_day as (select l_suppkey as node, l_shipdate::date as day, count(*)::double as calls,
        sum(l_quantity::decimal(18,2))::double as qty,
        (sum(l_quantity::decimal(18,2)) filter (where l_returnflag = 'R'))::double as imports,
        (sum(l_quantity::decimal(18,2)) filter (where l_returnflag <> 'R'))::double as exports
        from lineitem group by 1, 2)""",
    "sales": """sales as (select l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as sale_id,
        p_brand as project, p_type as type, l_shipdate::date as day, l_returnflag as usage, l_linestatus as reg,
        l_extendedprice::decimal(18,2) as worth from lineitem join part on p_partkey = l_partkey)""",
    "positions": """positions as (select (user_id + 100000000)::varchar as mmsi,
        make_timestamp((sec + 1704067200) * 1000000) as observed,
        24.0::double + least((sec + user_id * 420) % 7200, 7200 - (sec + user_id * 420) % 7200)::double / 3600.0::double * 0.4::double as lat,
        54.0::double + (user_id % 4)::double * 0.5::double as lon, (event_id % 3)::int as source_no,
        'src' || (event_id % 3) as source, event_type as category, value / 10 as sog, event_id, user_id
        from (select *, ((epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 60000000)::bigint as sec from events))""",
}
CTE["reports"] = CTE["positions"].replace("positions as (", "reports as (").replace(
    "make_timestamp((sec + 1704067200) * 1000000) as observed", "ts as observed")
NEEDS = {"priority_month": ["order_bounds"], "flag_month": ["line_bounds"]}


def ctes(*names: str) -> str:
    """``with a as (...), b as (...)`` for the named carriers."""
    ordered: list[str] = []
    for name in names:
        for n in [*NEEDS.get(name, []), name]:
            if n not in ordered:
                ordered.append(n)
    return "with recursive " + ",\n".join(CTE[n] for n in ordered)
