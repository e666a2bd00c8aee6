"""Scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from periodica.catalog import carriers as c
from periodica.catalog.carriers import ctes
from periodica.catalog.registry import f32, q6, qf, query, r6
from periodica.functions import geo
from periodica.functions import text as tx
from periodica.functions.folding import fold_compatible
from periodica.functions.measures import change_by_rule, difference_rule, min_max_index, zscore
from periodica.plans.alignment import log_by_series
from periodica.plans.factors import train_standardise
from periodica.sources.deliveries import signature


def _name_sql(e: str) -> str:
    return f"trim(regexp_replace(regexp_replace(translate({e}, '（）：　', '(): '), ':([^\\s]|$)', ': \\1', 'g'), '\\s+', ' ', 'g'))"


@query("c01_normalise_names", f"""
select doc_id, md5({_name_sql("replace(text, ', ', '（x）：')")}) as digest, length({_name_sql("replace(text, ', ', '（x）：')")}) as n from documents""")
def _(t):
    n = tx.normalise_name(F.replace("text", F.lit(", "), F.lit("（x）：")))
    return t.documents.select("doc_id", F.md5(n).alias("digest"), F.length(n).cast("long").alias("n"))


_MARKS = ":：,，()（）\\[\\]【】{{}}\\-—·.。".replace("{{", "{").replace("}}", "}")


@query("c02_normalise_text", f"""
with a as (select doc_id, trim(replace(text, 'the', 'ＴＨＥ（')) as s from documents), w as (select doc_id, trim(replace(replace(replace(replace(s, 'Ｔ', 'T'), 'Ｈ', 'H'), 'Ｅ', 'E'), '（', '(')) as s from a),
b as (select doc_id, trim(regexp_replace(regexp_replace(s, ' ?([{_MARKS}]) ?', '\\1', 'g'), '\\s+', ' ', 'g')) as s from w)
select doc_id, md5(case when regexp_matches(s, '[\\x00-\\x7F]') then lower(s) else s end) as digest from b""")
def _(t):
    return t.documents.select("doc_id", F.md5(tx.normalise_text(F.replace("text", F.lit("the"), F.lit("ＴＨＥ（")))).alias("digest"))


@query("c02_compatible_forms", """
select doc_id, md5(replace(replace(text, 'e', 'fi10ガ '), 'a', '(株)kg1⁄2é2IV')) as digest from documents""")
def _(t):
    folded = fold_compatible(F.replace(F.replace("text", F.lit("e"), F.lit("ﬁ⑩ｶﾞ　")), F.lit("a"), F.lit("㈱㎏½e\u0301²Ⅳ")))
    return t.documents.select("doc_id", F.md5(folded).alias("digest"))


@query("c03_match_names", """
select l.lang, l.n, r.n as reversed from (select lower(lang) as lang, count(*) as n from documents group by 1) l join (select lower(upper(lang)) as lang, count(distinct source) as n from documents group by 1) r using (lang)""")
def _(t):
    k = tx.normalise_text
    l = t.documents.groupBy(k("lang").alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    r = t.documents.groupBy(k(F.upper("lang")).alias("lang")).agg(F.countDistinct("source").alias("reversed"))
    return l.join(r, "lang")


@query("c04_source_names", """
select doc_id, case source when 'src1' then '一号源' when 'src2' then '二号源' else source end || '、' || 'lang ' || lang as label from documents""")
def _(t):
    raw = F.concat(F.col("source"), F.lit("；lang "), F.col("lang"), F.lit("（note (inner)）(x) (1(2（3(4(5(6)))）))"))
    return t.documents.select("doc_id", tx.translate_sources(raw, {"src1": "一号源", "src2": "二号源"}).alias("label"))


@query("c05_parse_dates", """
select o_orderkey, case when o_orderkey % 8 = 7 then null else date_trunc('month', o_orderdate)::date end as month from orders""")
def _(t):
    d, k = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % 8
    f = lambda p: F.date_format(d, p)
    text = (
        F.when(k == 0, F.unix_timestamp(d.cast("timestamp") + F.expr("interval 10 years")).cast("string")).when(k == 1, F.concat((F.unix_timestamp(d + F.expr("interval 10 years"))).cast("string"), F.lit("000")))
        .when(k == 2, f("yyyyMMdd")).when(k == 3, f("yyyy-MM-dd'T'HH:mm:ss")).when(k == 4, f("d/M/yyyy")).when(k == 5, f("dd-MM-yyyy")).when(k == 6, f("d.M.yyyy")).otherwise("n/a"))
    m = tx.parse_month(text)
    return t.orders.select("o_orderkey", F.when(k < 2, F.add_months(m, -120)).otherwise(m).alias("month"))


@query("c06_parse_utc", """
select event_id, case when event_id % 4 = 3 then null else date_trunc('second', ts) end as observed from events""")
def _(t):
    ts, k = F.col("ts").cast("timestamp"), F.col("event_id") % 4
    f = lambda shift: F.date_format(ts + F.expr(f"interval {shift} hours"), "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(k == 0, F.concat(f(0), F.lit("Z"))).when(k == 1, F.concat(f(8), F.lit("+08:00"))).when(k == 2, f(0)).otherwise("yesterday")
    return t.events.select("event_id", tx.parse_utc(text).alias("observed"))


@query("c09_leap_day_index", """
select day, dayofyear(make_date(2000, month(day)::int, day(day)::int))::int as leap_day from (select distinct o_orderdate::date as day from orders)""")
def _(t):
    from periodica.functions.calendar import leap_day_of_year

    d = t.orders.select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return d.select("day", leap_day_of_year("day").alias("leap_day"))


@query("c11_change_rule", """
select o_orderkey, """ + qf("case when o_orderstatus = 'F' and o_orderpriority <> '5-LOW' then o_totalprice - (o_custkey - 700) when o_custkey <> 700 then (o_totalprice - (o_custkey - 700)) / abs(o_custkey - 700) end") + " as change from orders")
def _(t):
    diff = difference_rule(F.when(F.col("o_orderstatus") == "F", "%").otherwise("AED"), F.when(F.col("o_orderpriority") == "5-LOW", "开工率").otherwise("flow"))
    ref = (F.col("o_custkey") - 700).cast("double")
    return t.orders.select("o_orderkey", f32(change_by_rule(F.col("o_totalprice"), F.when(ref != 0, ref).otherwise(F.when(diff, 0.0)), diff)).alias("change"))


@query("c12_distance_nm", ctes("positions") + f"""
select event_id, {q6('3440.065 * 2 * asin(sqrt(least(1, pow(sin((radians(24.2) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(24.2)) * pow(sin((radians(54.6) - radians(lon)) / 2), 2))))')} as nm from positions""")
def _(t):
    return c.positions(t).select("event_id", r6(geo.distance_nm(F.col("lat"), F.col("lon"), F.lit(24.2), F.lit(54.6))).alias("nm"))


_CNT = "case when a < 1000 then format('{:,.0f}', a) || ' 件' when a < 1e7 then rtrim(rtrim(format('{:,.2f}', a / 1e4), '0'), '.') || ' 万件' else rtrim(rtrim(format('{:,.2f}', a / 1e7), '0'), '.') || ' 千万件' end"


@query("c13_magnitude_format", f"""
with x as (select o_orderkey, floor(o_totalprice) as a from orders)
select o_orderkey, {_CNT} as as_count, case when a >= 1e4 then rtrim(rtrim(format('{{:,.2f}}', a / 1e4), '0'), '.') || ' 万元' when a >= 100 then rtrim(rtrim(format('{{:,.2f}}', a / 1e2), '0'), '.') || ' 百元' else rtrim(rtrim(format('{{:,.2f}}', a), '0'), '.') || ' 元' end as as_scaled,
  case when a * 1e6 / 1e8 < 1000 then rtrim(rtrim(format('{{:,.2f}}', a * 1e6 / 1e8), '0'), '.') || ' 亿元' else rtrim(rtrim(format('{{:,.2f}}', a * 1e6 / 1e12), '0'), '.') || ' 万亿元' end as as_currency from x""")
def _(t):
    x = t.orders.select("o_orderkey", F.floor("o_totalprice").cast("double").alias("a"))
    a = F.col("a")
    return x.select("o_orderkey", tx.format_count(a, "件").alias("as_count"), tx.format_scaled(a, "元").alias("as_scaled"), tx.format_currency(a, "元", 1e6).alias("as_currency"))


@query("c14_daily_rate", f"""
select l_orderkey, l_linenumber, l_partkey, l_suppkey, {q6("case l_linenumber when 1 then l_quantity / 10 when 2 then (l_quantity + l_quantity + 4) / 2 / 10000 when 3 then null when 4 then null when 5 then l_quantity * 1000 when 6 then null else l_quantity / 10 end")} as amount,
  l_linenumber = 2 as midpoint, {q6("case when l_linenumber in (1) then l_quantity / 10 when l_linenumber = 5 then l_quantity * 1000 end")} as plain from lineitem""")
def _(t):
    q, n = F.col("l_quantity").cast("long").cast("string"), F.col("l_linenumber")
    value = F.when(n == 1, q).when(n == 2, F.concat(q, F.lit(" – "), (F.col("l_quantity") + 4).cast("long").cast("string"))).when(n == 3, F.concat(F.lit(">"), q)).when(
        n == 4, F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit("-"), (F.col("l_quantity") - 1).cast("long").cast("string"))).when(n == 5, F.concat(q, F.lit(",000"))).when(n == 6, q).otherwise(F.concat(F.lit("约"), q))
    unit = F.when(n == 2, "桶/日").when(n == 5, "百万立方米/日").when(n == 6, "吨/年").otherwise("千桶/日")
    none = F.lit(None).cast("string")
    r = tx.daily_rate(value, none, unit)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(r["amount"]).alias("amount"), r["midpoint"].alias("midpoint"), r6(tx.plain_amount(value, none, unit)).alias("plain"))


@query("c15_reporting_period", """
with d as (select distinct o_orderdate::date as day from orders), x as (select day, (year(day) * 372 + month(day) * 31 + day(day)) % 6 as k from d)
select day, case k when 0 then year(day) || '-Q' || quarter(day) when 1 then year(day) || '-H' || case when month(day) <= 6 then 1 else 2 end when 2 then strftime(day, '%Y-%m') when 3 then year(day)::varchar end as code,
  case k when 0 then (date_trunc('quarter', day) + interval 3 month - interval 1 day)::date when 1 then case when month(day) <= 6 then make_date(year(day)::int, 6, 30) else make_date(year(day)::int, 12, 31) end when 2 then last_day(day) when 3 then make_date(year(day)::int, 12, 31) when 4 then day end as "end" from x""")
def _(t):
    d = t.orders.select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    k = (F.year("day") * 372 + F.month("day") * 31 + F.dayofmonth("day")) % 6
    y = F.year("day").cast("string")
    text = (
        F.when(k == 0, F.concat(y, F.lit("年第"), F.translate(F.quarter("day").cast("string"), "1234", "一二三四"), F.lit("季度平均"))).when(k == 1, F.concat(y, F.lit("年"), F.when(F.month("day") <= 6, "上半年").otherwise("下半年"), F.lit("日均产量")))
        .when(k == 2, F.concat(y, F.lit("年"), F.month("day").cast("string"), F.lit("月平均"))).when(k == 3, F.concat(y, F.lit("年平均"))).when(k == 4, F.date_format("day", "yyyy-MM-dd")).otherwise("未披露"))
    p = tx.observation_period(text)
    return d.select("day", p["code"].alias("code"), p["end"].alias("end"))


@query("c16_annual_to_daily", """
select o_orderkey, round((o_orderkey + 1)::decimal(18,0) * 1000 / case when year(o_orderdate) % 4 = 0 then 366 else 365 end, 1)::double as thousand_a_day from orders""")
def _(t):
    from periodica.functions.rates import daily_thousands

    return t.orders.select("o_orderkey", daily_thousands((F.col("o_orderkey") + 1) * 1000000, F.year("o_orderdate")).cast("double").alias("thousand_a_day"))


@query("c17_log_choice", ctes("customer_month") + f"""
, x as (select indicator, period, case when substr(indicator, 2)::bigint % 3 = 0 and month(period) = 2 then 0 when substr(indicator, 2)::bigint % 3 = 1 and month(period) = 3 then -5 else value end as v from customer_month),
m as (select indicator, min(v) filter (where v >= 0) as lo from x group by 1)
select indicator, period, {q6('case when v < 0 then null when lo > 0 then ln(nullif(v, 0)) else ln(1 + v) end')} as logged from x join m using (indicator)""")
def _(t):
    n = F.substring("indicator", 2, 12).cast("long") % 3
    v = F.when((n == 0) & (F.month("period") == 2), 0.0).when((n == 1) & (F.month("period") == 3), -5.0).otherwise(F.col("value"))
    x = c.customer_month(t).withColumn("value", v)
    return log_by_series(x, ["indicator"], "value", "l").select("indicator", "period", r6("l").alias("logged"))


@query("c18_standardise", ctes("customer_month") + f"""
, s as (select indicator, avg(value) as m, stddev_samp(value) as sd, min(value) as lo, max(value) as hi from customer_month group by 1)
select indicator, period, {q6('case when coalesce(sd, 0) = 0 then value else (value - m) / sd end', 5)} as z, {q6('case when hi = lo then 0 else 100 * (value - lo) / (hi - lo) end', 5)} as scaled from customer_month join s using (indicator)""")
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("indicator")
    v = F.col("value")
    return c.customer_month(t).select("indicator", "period", r6(zscore(v, F.avg(v).over(w), F.stddev_samp(v).over(w)), 5).alias("z"),
                                      r6(min_max_index(v, F.min(v).over(w), F.max(v).over(w)), 5).alias("scaled"))


_LINE = ("l_discount", "l_extendedprice", "l_linenumber", "l_linestatus", "l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_shipdate", "l_suppkey", "l_tax")
_MONEY = ("l_discount", "l_extendedprice", "l_quantity", "l_tax")


@query("c19_content_signature", "with h as (select ('0x' || md5(concat_ws('|', " + ", ".join(f"coalesce('=' || {x}::{'decimal(18,4)' if x in _MONEY else 'date' if x == 'l_shipdate' else 'varchar'}::varchar, '')" for x in _LINE) + """))[1:15])::bigint as h from lineitem)
select count(*) as rows, sum(h)::decimal(38,0) as hash_sum, bit_xor(h) as hash_xor from h""")
def _(t):
    kind = lambda x: F.col(x).cast("decimal(18,4)" if x in _MONEY else "date" if x == "l_shipdate" else "string")
    return signature(t.lineitem.select(*[kind(x).alias(x) for x in _LINE]))


@query("c20_train_standardise", ctes("customer_month") + f"""
, s as (select indicator, avg(value) filter (where period < date '2000-01-01') as m, stddev_samp(value) filter (where period < date '2000-01-01') as sd from customer_month group by 1)
select indicator, period, {q6('coalesce((value - m) / case when sd > 0 then sd else 1 end, 0)', 5)} as standardised from customer_month join s using (indicator)""")
def _(t):
    out = train_standardise(c.customer_month(t), "indicator", "value", F.col("period") < F.lit("2000-01-01").cast("date"))
    return out.select("indicator", "period", r6("standardised", 5).alias("standardised"))


@query("c21_standard_date", """
select o_orderkey, case when o_orderkey % 3 = 2 then null else strftime(o_orderdate, '%Y-%m-%d') end as day from orders""")
def _(t):
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise("no date")
    return t.orders.select("o_orderkey", tx.standard_date(text).alias("day"))
