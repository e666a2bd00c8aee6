"""Source and sink queries over files and documents derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from periodica.catalog import carriers as c
from periodica.catalog.carriers import ctes
from periodica.catalog.registry import q6, query, r6
from periodica.session import shared_dir
from periodica.sources import deliveries as dl
from periodica.sources import delimited as de
from periodica.sources import nested as ne
from periodica.sources import positions as ps
from periodica.sources import protocol as pr

TS = lambda s: F.lit(s).cast("timestamp")


def landed_csv(t, df, label: str, header: bool = True, **options) -> str:
    path = shared_dir(t.spark, label)
    df.write.mode("overwrite").option("header", header).options(**options).csv(path)
    return path


@query("s01_row_addressed_scan", """
select o_orderkey::varchar as o_orderkey, o_custkey::varchar as o_custkey, strftime(o_orderdate, '%Y-%m-%d') as day, o_orderpriority as "订单优先级" from orders""")
def _(t):
    src = t.orders.select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderpriority").alias("订单优先级"))
    return de.read_rows(t.spark, landed_csv(t, src, "s01"), 0, 1)


@query("s01_quoted_breaks", """
select doc_id::varchar as doc_id, lang, nullif(text, '') as text, n_chars::varchar as n_chars from documents""")
def _(t):
    src = t.documents.select("doc_id", "lang", "text", "n_chars")
    options = {"escape": '"', "quoteAll": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    return de.read_rows(t.spark, landed_csv(t, src, "s01q", **options), 0, 1)


@query("s02_type_inference", """
select o_orderdate as day, o_orderkey::double as o_orderkey, o_totalprice, o_orderpriority from orders""")
def _(t):
    src = t.orders.select(F.date_format("o_orderdate", "yyyy/M/d").alias("day"), "o_orderkey", "o_totalprice", "o_orderpriority")
    out = de.infer_types(de.read_rows(t.spark, landed_csv(t, src, "s02"), 0, 1))
    return out.withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("s03_column_discovery", """
select 'l_shipdate' as time_column, 8::bigint as numeric_columns, count(*) as n from lineitem""")
def _(t):
    li = t.lineitem
    return li.agg(F.lit(de.identify_time_column(li)).alias("time_column"), F.lit(len(de.numeric_variables(li))).cast("long").alias("numeric_columns"), F.count(F.lit(1)).alias("n"))


def sheet_input(t):
    """A wide text sheet with one column per indicator, and its metadata rows."""
    cols = ["AF", "AO", "NF", "NO", "RF", "RO"]
    d = c.flag_day(t)
    wide = d.groupBy("period").pivot("indicator", cols).agg(F.first(F.when(F.col("qty") > 30, F.col("qty")).otherwise(0.0)))
    text = wide.select(F.date_format("period", "yyyy-MM-dd").alias("日期"), *[F.col(x).cast("string").alias(x) for x in cols])
    meta = d.select("indicator").distinct().select(
        F.col("indicator").alias("column"), F.concat(F.lit("指标：（"), F.col("indicator"), F.lit("）")).alias("name"), F.lit("日").alias("frequency"),
        F.when(F.col("indicator").startswith("A"), "件").otherwise("箱").alias("unit"), F.lit("港务").alias("source"), F.lit("2001-12-01").alias("updated"))
    return pr.to_long(text, "日期", cols), meta


@query("s04_protocol_sheet", ctes("flag_day") + """
-- the sheet has a cell for every day and column; days without a figure stay as empty cells
select '指标: (' || i.indicator || ')' as indicator, 'daily' as frequency, d.period, case when qty > 30 then qty end as value
from (select distinct indicator from flag_day where indicator <> 'RO') i cross join (select distinct period from flag_day) d left join flag_day f on f.indicator = i.indicator and f.period = d.period""")
def _(t):
    long, meta = sheet_input(t)
    registered = meta.where("column <> 'RO'").select("name", F.lit("flow").alias("type"))
    good, problems = pr.parse_sheet(long, meta, registered)
    pr.require_valid(problems)
    return good.select("indicator", "frequency", "period", "value")


@query("s05_target_series", ctes("flag_day") + """
select case indicator when 'AF' then 'first' else 'second' end as display, period, qty as value from flag_day where indicator in ('AF', 'NO') and qty > 30""")
def _(t):
    long, meta = sheet_input(t)
    targets = meta.where("column in ('AF', 'NO')").select(F.when(F.col("column") == "AF", "first").otherwise("second").alias("display"), "name", "unit")
    values, problems = pr.read_targets(long, meta, targets, ["日", "日度"])
    pr.require_valid(problems)
    return values


@query("s06_sharded_scan", """
select c_custkey::varchar as c_custkey, c_name, c_mktsegment from customer""")
def _(t):
    cols = ["c_custkey", "c_name", "c_mktsegment"]
    path = landed_csv(t, t.customer.select(*cols), "s06", compression="gzip")
    rows, _counts = de.read_shards(t.spark, path, cols)
    return rows


@query("s06_json_envelopes", """
select c_nationkey, c_custkey, c_mktsegment from customer""")
def _(t):
    rec = F.struct("c_nationkey", "c_custkey", "c_mktsegment")
    # An envelope holds the records of one source row block; blocks are small by construction.
    env = t.customer.groupBy("c_nationkey", F.floor(F.col("c_custkey") / 200).alias("b")).agg(F.collect_list(rec).alias("r"))
    body = F.when(F.col("b") % 2 == 0, F.to_json(F.struct(F.col("r").alias("data")))).otherwise(F.to_json(F.struct(F.col("r").alias("items"))))
    path = shared_dir(t.spark, "s06j")
    env.select(body.alias("value")).write.text(path, compression="gzip")
    record = T.StructType([T.StructField("c_nationkey", T.IntegerType()), T.StructField("c_custkey", T.LongType()), T.StructField("c_mktsegment", T.StringType())])
    return de.read_envelopes(t.spark, path, record)


@query("s07_typed_transactions", ctes("sales") + """
select sale_id as transaction_id, case when usage = 'N' then null else worth::decimal(24,2) end as actual_worth, case when reg = 'O' then day end as instance_date, day::timestamp as load_timestamp,
  substr(project, 7) as project_number, type as property_type_en from sales""")
def _(t):
    s = c.sales(t).select(
        F.col("sale_id").alias("transaction_id"), F.when(F.col("usage") == "N", "n/a").otherwise(F.col("worth").cast("string")).alias("actual_worth"), F.when(F.col("reg") == "O", F.col("day").cast("string")).otherwise("not a date").alias("instance_date"),
        F.date_format("day", "yyyy-MM-dd HH:mm:ss").alias("load_timestamp"), F.concat(F.substring("project", 7, 5), F.lit(".0")).alias("project_number"), F.col("type").alias("property_type_en"),
        F.lit("").alias("property_usage_en"), F.lit("").alias("reg_type_en"), F.lit("Sales").alias("trans_group_en"))
    rows, _counts = de.read_shards(t.spark, landed_csv(t, s, "s07"), s.columns)
    out = de.typed_transactions(rows)
    return out.select("transaction_id", "actual_worth", "instance_date", F.col("load_timestamp").cast("timestamp_ntz").alias("load_timestamp"), "project_number", "property_type_en")


@query("s08_date_quality", """
select count(*) as rows, count(*) filter (where o_orderkey % 50 = 1) as before_1900, count(*) filter (where o_orderkey % 50 = 2) as unparseable, date '1899-01-01' as first_date,
  max(o_orderdate::date) filter (where o_orderkey % 50 not in (1, 2)) as last_date, min(o_orderdate::date) filter (where o_orderkey % 50 not in (1, 2)) as first_since_1900 from orders""")
def _(t):
    k = F.col("o_orderkey") % 50
    text = F.when(k == 1, "1899-01-01").when(k == 2, "not a date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return de.date_quality(t.orders.select(text.alias("instance_date")), "instance_date")


@query("s09_sdmx_slice", ctes("flag_month") + """
select period, case indicator when 'AF' then 'index a' else 'index n' end as indicator, value, case when year(period) < 1998 then '2021' else '2024' end as base from flag_month where indicator in ('AF', 'NF')""")
def _(t):
    m = c.flag_month(t).select(F.date_format("period", "yyyy-MM").alias("TIME_PERIOD"), F.col("indicator").alias("DIV"), F.col("value").cast("decimal(18,2)").cast("string").alias("OBS_VALUE"), F.lit("AE").alias("REF_AREA"), F.lit("M").alias("FREQ"),
                               F.lit("INDX").alias("UNIT_MEASURE"), F.when(F.year("period") < 1998, "2021").otherwise("2024").alias("base"))
    rows = t.spark.read.option("header", True).csv(landed_csv(t, m, "s09"))
    from periodica.functions.calendar import month_end_from_text

    good, problems = de.sdmx_slice(rows, {"REF_AREA": "AE", "FREQ": "M"}, "DIV", {"AF": "index a", "NF": "index n"}, ("UNIT_MEASURE", "INDX"), month_end_from_text("TIME_PERIOD"), ["period", "indicator", "base"], positive=True)
    pr.require_valid(problems)
    return good.select("period", "indicator", "value", "base")


@query("s10_parallel_arrays", ctes("customer_month") + """
select period, 'over' as indicator, value from customer_month union all select period, 'half', value / 2 from customer_month""")
def _(t):
    # One document per series; a series is as long as its calendar.
    m = c.customer_month(t)
    doc = m.groupBy("indicator").agg(F.array_sort(F.collect_list(F.struct("period", "value"))).alias("s"))
    body = F.to_json(F.struct(F.transform("s", lambda x: F.date_format(x["period"], "dd MMM yyyy")).alias("dates"), F.transform("s", lambda x: x["value"]).alias("on"), F.transform("s", lambda x: x["value"] / 2).alias("half")))
    return ne.parallel_series(doc.select(body.alias("j")), "j", "dates", {"on": "over", "half": "half"}, "dd MMM yyyy")


@query("s10_record_series", ctes("customer_month") + """
select period, value from customer_month""")
def _(t):
    m = c.customer_month(t)
    doc = m.groupBy("indicator").agg(F.collect_list(F.struct(F.lit("EFFR").alias("type"), F.date_format("period", "yyyy-MM-dd").alias("effectiveDate"), F.col("value").alias("percentRate"))).alias("refRates"))
    docs = doc.select(F.to_json(F.struct("refRates")).alias("j"))
    return ne.record_series(docs, "j", "$.refRates", "type string, effectiveDate string, percentRate double", F.col("effectiveDate").cast("date"), F.col("percentRate"), F.col("type") == "EFFR")


@query("s11_fact_columns", ctes("supplier_day") + """
select node, day, calls, case when node % 4 = 0 then null else qty end as qty from supplier_day""")
def _(t):
    f = c.supplier_day(t).select("node", "day", F.to_json(F.struct(F.col("calls").alias("portcalls"), F.when(F.col("node") % 4 == 0, "n/a").otherwise(F.col("qty").cast("string")).alias("n_total"))).alias("payload"))
    return ne.fact_columns(f, "payload", {"calls": "$.portcalls", "qty": "$.n_total"}).drop("payload")


def messages(t):
    """One raw message per event: three position types, a static type and an unknown one."""
    p = c.reports(t).withColumn("lat", F.col("lat") + F.when(F.col("event_id") % 40 == 0, 90.0).otherwise(0.0))
    kind = F.when(F.col("category") == "view", "PositionReport").when(F.col("category") == "click", "StandardClassBPositionReport").when(F.col("category") == "purchase", "ShipStaticData").when(F.col("category") == "signup", "LongRangeAisBroadcastMessage").otherwise("SafetyBroadcast")
    body = F.struct(F.when(F.col("event_id") % 7 == 0, 102.3).otherwise(F.col("sog")).alias("Sog"), F.when(F.col("event_id") % 3 == 0, 511).otherwise((F.col("event_id") % 360).cast("int")).alias("TrueHeading"),
                    ((F.col("event_id") * 7) % 3700 / 10).alias("Cog"), (F.col("user_id") % 105).alias("Type"), F.concat(F.lit("CALL@"), F.col("user_id").cast("string")).alias("CallSign"))
    meta = F.struct(F.when(F.col("user_id") % 31 == 0, F.lit(7).cast("long")).otherwise(F.col("mmsi").cast("long")).alias("MMSI"), F.date_format("observed", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("time_utc"), F.col("lat").alias("Latitude"), F.col("lon").alias("Longitude"))
    j = F.to_json(F.struct(kind.alias("MessageType"), meta.alias("MetaData"), F.map_from_arrays(F.array(kind), F.array(body)).alias("Message")))
    return p.select("event_id", j.alias("content"), F.col("observed").alias("received"))


_MSG = ctes("reports") + """
, m as (select *, lat + case when event_id % 40 = 0 then 90 else 0 end as la, case category when 'view' then 'PositionReport' when 'click' then 'StandardClassBPositionReport' when 'purchase' then 'ShipStaticData' when 'signup' then 'LongRangeAisBroadcastMessage' else 'SafetyBroadcast' end as mt from reports),
r as (select *, case when mt = 'SafetyBroadcast' then 'unsupported_type' when user_id % 31 = 0 then 'invalid_id' when mt <> 'ShipStaticData' and abs(la) > 90 then 'invalid_position' end as reason from m)"""


@query("s12_normalise_messages", _MSG + f"""
select mmsi, observed, mt as message_type, case when mt = 'ShipStaticData' then 'static' else 'position' end as kind, {q6("case when mt <> 'ShipStaticData' then la end")} as lat, case when mt <> 'ShipStaticData' and event_id % 7 <> 0 and sog < 102.3 then sog end as sog,
  {q6("case when mt <> 'ShipStaticData' then case when event_id % 3 <> 0 then event_id % 360 when (event_id * 7) % 3700 / 10 < 360 then (event_id * 7) % 3700 / 10 end end")} as course, (user_id % 105)::int as ship_type,
  case when mt = 'ShipStaticData' then 'CALL' || user_id end as call_sign from r where reason is null""")
def _(t):
    good, _bad = ps.normalise_messages(messages(t), "content", "received")
    return good.select("mmsi", F.col("observed"), "message_type", "kind", r6("lat").alias("lat"), "sog", r6("course").alias("course"), "ship_type", "call_sign")


@query("s12_rejected_messages", _MSG + " select reason, count(*) as n from r where reason is not null group by 1")
def _(t):
    _good, bad = ps.normalise_messages(messages(t), "content", "received")
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("s13_archived_reports", ctes("reports") + """
select mmsi, observed, event_id % 5 <> 0 as moving, source, case event_id % 4 when 0 then 'tanker' when 1 then 'cargo' when 2 then 'tug' else 'unknown' end as category
from reports where user_id % 17 <> 0 and observed <= timestamp '2024-01-25 00:05:00' and event_id % 9 <> 0 and event_id % 22 <> 0""")
def _(t):
    r = c.reports(t).select(
        F.when(F.col("user_id") % 17 != 0, F.col("mmsi")).alias("MMSI"), F.date_format("observed", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("received_at"), F.when(F.col("event_id") % 11 != 0, F.date_format("observed", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("AIS报告时间 UTC"), (F.col("lat") + 2).cast("string").alias("纬度"), F.col("lon").cast("string").alias("lon"),
        F.when(F.col("event_id") % 5 != 0, "12.5").otherwise("0.1").alias("航速 节"), F.when(F.col("event_id") % 9 != 0, F.col("source")).otherwise(" ").alias("数据源"),
        F.when(F.col("event_id") % 22 == 0, "live").alias("data_source"), F.when(F.col("event_id") % 4 == 2, "tug").alias("category"),
        F.when(F.col("event_id") % 4 == 0, "油轮/液货船").when(F.col("event_id") % 4 == 1, "货船").otherwise("潜艇").alias("船型"))
    good, _bad = ps.normalise_reports(r, TS("2024-01-25 00:00:00"))
    return good.select("mmsi", "observed", "moving", "source", "category")


@query("s14_track_points", ctes("reports") + f"""
select mmsi, observed, {q6('lat + 2')} as lat, lon from reports where observed::date = date '2024-01-07' and event_id % 6 <> 0""")
def _(t):
    # A track document holds one vessel's points of one block of 1000 event numbers, so it stays small.
    r = c.reports(t).withColumn("h", F.floor(F.col("event_id") / 1000))
    d = r.groupBy("mmsi", "h").agg(F.array_sort(F.collect_list(F.struct("observed", "lon", (F.col("lat") + F.when(F.col("event_id") % 6 == 0, 60).otherwise(2)).alias("lat"), "event_id"))).alias("p"))
    # A track of one point is written as a point.
    first = F.get("p", F.lit(0))
    point = F.concat(F.lit('{"type":"Point","coordinates":'), F.to_json(F.array(first["lon"], first["lat"])), F.lit("}"))
    line = F.concat(F.lit('{"type":"LineString","coordinates":'), F.to_json(F.transform("p", lambda x: F.array(x["lon"], x["lat"]))), F.lit("}"))
    props = F.to_json(F.struct("mmsi", F.transform("p", lambda x: F.date_format(x["observed"], "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("times")))
    j = F.concat(F.lit('{"type":"Feature","geometry":'), F.when(F.size("p") == 1, point).otherwise(line), F.lit(',"properties":'), props, F.lit("}"))
    out = ps.explode_tracks(d.select(j.alias("j"), "mmsi"), "j", F.lit("2024-01-07").cast("date"), F.col("mmsi"))
    return out.select("mmsi", "observed", r6("lat").alias("lat"), "lon")


def delivery(t):
    e = dl.bundle_events(c.reports(t).select(F.concat(F.lit("area"), (F.col("user_id") % 4).cast("string")).alias("area"), "mmsi", F.col("observed").alias("entered")))
    return e, e.groupBy("area", "day").agg(F.count(F.lit(1)).alias("declared"))


_DEL = ctes("reports") + ", e as (select distinct 'area' || (user_id % 4) as area, mmsi, observed as entered, (observed + interval 8 hour)::date as day from reports)"


@query("s15_bundle_check", _DEL + """
, k as (select area, day, count(*) + case when day = date '2024-01-10' then 1 else 0 end as declared, count(*) as counted from e group by 1, 2) select * from k where declared <> counted""")
def _(t):
    e, cov = delivery(t)
    return dl.bundle_breaks(e, cov.withColumn("declared", F.col("declared") + F.when(F.col("day") == F.lit("2024-01-10").cast("date"), 1).otherwise(0)))


@query("s16_replace_partitions", _DEL + """
select area, day, count(case when day = date '2024-01-12' and mmsi::bigint % 2 = 0 then null else entered end) as passages from e group by 1, 2""")
def _(t):
    e, cov = delivery(t)
    path = shared_dir(t.spark, "bundles")
    dl.check_bundle(e, cov)
    dl.save_bundle(e, cov, path, "p1")
    fixed = e.where((F.col("day") == F.lit("2024-01-12").cast("date")) & (F.col("mmsi").cast("long") % 2 == 1))
    dl.save_bundle(fixed, fixed.groupBy("area", "day").agg(F.count(F.lit(1)).alias("declared")).unionByName(
        cov.where(F.col("day") == F.lit("2024-01-12").cast("date")).join(fixed.select("area", "day").distinct(), ["area", "day"], "left_anti").withColumn("declared", F.lit(0).cast("long"))), path, "p1")
    return dl.verified_history(dl.read_bundles(t.spark, path)).select("area", "day", "passages")


@query("s17_verified_history", _DEL + """
select area, day, count(*) as passages from e group by 1, 2 having day(day) % 5 <> 0""")
def _(t):
    e, cov = delivery(t)
    cov = cov.withColumn("declared", F.col("declared") + F.when(F.dayofmonth("day") % 5 == 0, 1).otherwise(0))
    stored = cov.join(e, ["area", "day"]).withColumn("provider", F.lit("p1"))
    return dl.verified_history(stored).select("area", "day", "passages")


def published(t):
    obs = c.flag_month(t).select(F.concat(F.lit("sheet"), F.substring("indicator", 1, 1)).alias("sheet"), F.col("indicator").alias("column"), "period", F.col("qty").alias("value"))
    root = shared_dir(t.spark, "report")
    return root, dl.publish(obs, root)


@query("s18_publish_snapshot", ctes("flag_month") + """
select 'sheet' || left(indicator, 1) as sheet, count(*) as observations, sum(qty) as total from flag_month group by 1""")
def _(t):
    root, version = published(t)
    return t.spark.read.parquet(f"{root}/version={version}").groupBy("sheet").agg(F.count(F.lit(1)).alias("observations"), F.sum("value").alias("total"))


@query("s19_pinned_read", ctes("flag_month") + """
select period, max(qty) filter (where indicator = 'AF') as "AF", max(qty) filter (where indicator = 'AO') as "AO" from flag_month where indicator like 'A%' group by 1""")
def _(t):
    root, version = published(t)
    return dl.sheet_wide(dl.read_published(t.spark, root, version, "sheetA"), ["AF", "AO"])


@query("s20_guarded_export", """
select c_custkey::varchar as c_custkey, case when c_custkey % 3 = 0 then '''  =' || c_name when c_custkey % 3 = 1 then '''-' || c_name else c_name end as c_name from customer""")
def _(t):
    k = F.col("c_custkey") % 3
    src = t.customer.select("c_custkey", F.when(k == 0, F.concat(F.lit("  ="), "c_name")).when(k == 1, F.concat(F.lit("-"), "c_name")).otherwise(F.col("c_name")).alias("c_name"))
    path = shared_dir(t.spark, "export")
    dl.export_csv(src, path)
    return t.spark.read.option("header", True).csv(path)


@query("s21_source_runs", """
select 'customers' as source, 'ok' as status, count(*) as rows from customer union all select 'orders', 'ok', count(*) from orders union all select 'broken', 'failed', 0""")
def _(t):
    root = shared_dir(t.spark, "runs")

    def sink(name, df):
        df.write.parquet(f"{root}/{name}")
        return t.spark.read.parquet(f"{root}/{name}").count()

    sources = {"customers": lambda: t.customer, "orders": lambda: t.orders, "broken": lambda: t.orders.select(F.raise_error(F.lit("bad feed")).alias("x"))}
    return dl.run_sources(t.spark, sources, sink).select("source", "status", "rows")


@query("s22_feature_positions", ctes("reports") + f"""
select mmsi, observed, {q6('lat + 2')} as lat, case when event_id % 2 = 0 then source else 'unknown' end as source, {q6('(epoch_us(timestamp ' + "'2024-02-01'" + ') - epoch_us(observed)) / 6e7', 3)} as age_minutes from reports where event_id % 6 <> 0""")
def _(t):
    props = F.create_map(F.lit("kind"), F.when(F.col("event_id") % 6 == 0, "buoy").otherwise("vessel"), F.lit("mmsi"), F.col("mmsi"), F.lit("seen"), F.date_format("observed", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
                         F.lit("source"), F.when(F.col("event_id") % 2 == 0, F.col("source")).otherwise("@ "))
    j = F.to_json(F.struct(F.struct(F.array(F.col("lon"), F.col("lat") + 2).alias("coordinates")).alias("geometry"), props.alias("properties")))
    out = ps.feature_positions(c.reports(t).select(j.alias("j"), TS("2024-02-01").alias("received")), "j", "received")
    return out.select("mmsi", "observed", r6("lat").alias("lat"), "source", r6("age_minutes", 3).alias("age_minutes"))


@query("s23_contract_csv", ctes("supplier_day") + """
select day as date, node::varchar as portid, calls::bigint as portcalls from supplier_day""")
def _(t):
    src = c.supplier_day(t).select(F.col("day").alias("date"), F.col("node").alias("portid"), F.col("calls").cast("long").alias("portcalls"))
    return de.read_contract_csv(t.spark, landed_csv(t, src, "s23"), ["date", "portid", "portcalls"], ["portcalls"], ["portid"])


@query("s24_registry_merge", ctes("flag_day") + """
, d as (select period as day, count(*) as n, sum(qty) as qty from flag_day group by 1)
select day, n, case when day <= date '2000-12-31' then qty else qty + 1 end as qty from d""")
def _(t):
    d = c.flag_day(t).groupBy(F.col("period").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty"))
    reviewed = d.where(F.col("day") <= F.lit("2000-12-31").cast("date"))
    return de.merge_registry(reviewed, d.withColumn("qty", F.col("qty") + 1), "day")


@query("s24_registry_breaks", ctes("orders_day") + """
, d as (select day, count(*) - 3 as n from orders_day group by 1)
select day, 'bad_count' as problem from d where n < 0 union all select g::date, 'missing_day' from generate_series((select min(day) from d)::timestamp, (select max(day) from d)::timestamp, interval 1 day) x(g) where g::date not in (select day from d)""")
def _(t):
    d = c.orders_day(t).groupBy("day").agg((F.count(F.lit(1)) - 3).alias("n"))
    return de.registry_breaks(d, "day", ["n"], F.lit("1995-01-01").cast("date"))


@query("s25_flatten_documents", """
select 'doc' || c_nationkey || '/' || (c_custkey // 200) as path, c_mktsegment as section, count(*) as records from customer group by 1, 2""")
def _(t):
    # One document per nation and block of customers, a section per segment.
    b = t.customer.groupBy("c_nationkey", F.floor(F.col("c_custkey") / 200).alias("b"), "c_mktsegment").agg(F.collect_list(F.struct("c_custkey", "c_name")).alias("r"))
    d = b.groupBy("c_nationkey", "b").agg(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "r"))).alias("m"))
    docs = d.select(F.concat(F.lit("doc"), F.col("c_nationkey").cast("string"), F.lit("/"), F.col("b").cast("string")).alias("path"), F.to_json("m").alias("content"))
    return de.flatten_documents(docs, "path", "content").groupBy("path", "section").agg(F.count(F.lit(1)).alias("records"))
