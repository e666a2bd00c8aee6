"""Stream queries, run to completion over the event table."""

from __future__ import annotations

from datetime import timedelta

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from periodica.catalog import carriers as c
from periodica.catalog.carriers import ctes
from periodica.catalog.registry import q6, query, r6
from periodica.functions import geo
from periodica.session import shared_dir
from periodica.streaming import entries as en
from periodica.streaming import pipelines as pl
from periodica.streaming.versions import DayTable, replace_keys

AREAS = {
    "north": (geo.inset_box(24.15037, 24.9, 53.0, 56.0, 0.01), geo.inset_box(24.15037, 24.9, 53.0, 56.0, -0.01)),
    "south": (geo.inset_box(23.0, 24.2504, 53.0, 54.6, 0.02), geo.inset_box(23.0, 24.2504, 53.0, 54.6, -0.02)),
}
_SIDES = """
, first_src as (select mmsi, observed, min_by((lat, lon, source), (source, event_id)) as f from positions group by 1, 2),
pts as (select p.mmsi, p.observed, min(struct_extract(f, 1)) as lat, min(struct_extract(f, 2)) as lon, min(struct_extract(f, 3)) as source,
  max(3440.065 * 2 * asin(sqrt(least(1, pow(sin(radians(struct_extract(f, 1) - lat) / 2), 2) + cos(radians(lat)) * cos(radians(struct_extract(f, 1))) * pow(sin(radians(struct_extract(f, 2) - lon) / 2), 2))))) as apart
  from positions p join first_src using (mmsi, observed) group by 1, 2),
seg as (select *, lag(observed) over w as pt, lag(lat) over w as pla, lag(lon) over w as plo from pts where apart <= 0.1 window w as (partition by mmsi order by observed)),
stp as (select *, coalesce(epoch_us(observed) - epoch_us(pt) <= 1800000000 and 3440.065 * 2 * asin(sqrt(least(1, pow(sin(radians(lat - pla) / 2), 2) + cos(radians(pla)) * cos(radians(lat)) * pow(sin(radians(lon - plo) / 2), 2)))) / ((epoch_us(observed) - epoch_us(pt)) / 3.6e9) <= 60, false) as valid from seg),
sd as (select mmsi, observed, source, pt, valid, 'north' as area, case when lat > 24.16037 and lat < 24.89 and lon > 53.01 and lon < 55.99 then true when not (lat > 24.14037 and lat < 24.91 and lon > 52.99 and lon < 56.01) then false end as ins from stp
  union all select mmsi, observed, source, pt, valid, 'south', case when lat > 23.02 and lat < 24.2304 and lon > 53.02 and lon < 54.58 then true when not (lat > 22.98 and lat < 24.2704 and lon > 52.98 and lon < 54.62) then false end from stp)"""
_ENTRIES = _SIDES + """
, a1 as (select *, lag(ins) over w as pins, last_value(case when not valid and ins is null then 'u' when ins is not null then 'k' end ignore nulls) over (partition by mmsi, area order by observed rows between unbounded preceding and 1 preceding) as lm from sd window w as (partition by mmsi, area order by observed)),
a2 as (select *, case when not valid and ins is null then 'unknown' when not valid or (ins = pins) or (ins is not null and lm = 'u') then case when ins then 'in' when not ins then 'out' end end as settled from a1),
a3 as (select *, last_value(settled ignore nulls) over (partition by mmsi, area order by observed rows between unbounded preceding and 1 preceding) as state from a2),
a4 as (select *, lag(observed) over w as po, lag(pt) over w as pb, lag(settled) over w as ps, lag(state) over w as pst from a3 window w as (partition by mmsi, area order by observed)),
ent as (select mmsi, area, po as entered, pb as before, observed as confirmed, source from a4 where valid and ins and pins and ps is null and pst = 'out')"""


@query("r01_idempotent_append", ctes("reports") + """
select count(*) as reports, count(distinct mmsi) as vessels from (select distinct mmsi, observed, source from reports)""")
def _(t):
    twice = c.reports(t, c.event_stream(t)).select("mmsi", "observed", "source", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    out = pl.run_to_parquet(pl.deduplicated(twice).drop("copy"), "r01")
    return out.agg(F.count(F.lit(1)).alias("reports"), F.countDistinct("mmsi").alias("vessels"))


@query("r02_late_flags", ctes("reports") + """
select mmsi, observed, source, case when event_id % 3 = 1 then 'AE' when event_id % 2 = 0 then 'CN' end as flag from reports""")
def _(t):
    r = c.reports(t).select("mmsi", "observed", "source", "event_id")
    stored = r.withColumn("flag", F.when(F.col("event_id") % 2 == 0, "CN")).withColumn("flag_country", F.col("flag"))
    late = r.select("mmsi", "observed", "source", F.when(F.col("event_id") % 3 == 1, "AE").alias("flag"), F.lit("AE").alias("flag_country"), F.col("observed").alias("received"))
    return pl.enrich_flags(stored, late).select("mmsi", "observed", "source", "flag")


class LostOnce(DayTable):
    """Stops between the rows of its second batch and their list, as when a driver is lost; the next try goes through."""

    lost = False

    def _write_list(self, days, batch):
        if batch == 1 and not self.lost:
            self.lost = True
            raise RuntimeError("driver lost")
        super()._write_list(days, batch)


@query("r02_late_flags_stream", ctes("reports") + """
select mmsi, observed, source, case when event_id % 3 = 1 then 'AE' when event_id % 2 = 0 then 'CN' end as flag from reports""")
def _(t):
    r = c.reports(t).select("mmsi", "observed", "source", "event_id", F.to_date("observed").alias("day"))
    keys = ["mmsi", "observed", "source"]
    flag = F.when(F.col("event_id") % 2 == 0, "CN")
    reports = r.select(*keys, flag.alias("flag"), flag.alias("flag_country"), F.col("observed").alias("received"), "day")
    flags = r.where("event_id % 3 = 1").select(*keys, F.lit("AE").alias("flag"), F.lit("AE").alias("flag_country"), (F.col("observed") + F.expr("interval 1 hour")).alias("received"), "day")
    table = LostOnce(t.spark, shared_dir(t.spark, "r02"), reports.schema)
    landed, run = shared_dir(t.spark, "r02-landed"), shared_dir(t.spark, "r02-run")
    reports.write.parquet(landed)
    stream = t.spark.readStream.schema(reports.schema).parquet(landed)

    def deliver():
        pl.run_each_batch(stream, run, lambda batch, number: table.merge(batch, number, pl.deliver_flags))

    deliver()
    flags.write.mode("append").parquet(landed)
    try:
        deliver()
    except StreamingQueryException:
        deliver()
    return table.read().select(*keys, "flag")


def vessel_stream(t):
    r = c.reports(t, c.event_stream(t))
    static = F.col("category").isin("signup", "purchase")
    return r.select("mmsi", "observed", F.col("observed").alias("received"), F.when(static, "static").otherwise("position").alias("kind"), "lat", "lon", "sog", F.when(F.col("category") == "signup", F.concat(F.lit("ship "), (F.col("event_id") % 1000).cast("string"))).alias("name"),
                    F.lit(None).cast("string").alias("call_sign"), F.when(F.col("category") == "purchase", F.col("source")).alias("destination"), F.lit(None).cast("string").alias("category"))


@query("r03_latest_state", ctes("reports") + f"""
select mmsi, max(observed) as observed, {q6('max_by(lat, observed)')} as lat, max_by(lon, observed) as lon from reports where category not in ('signup', 'purchase') group by 1""")
def _(t):
    pl.use_rocksdb(t.spark)
    return pl.run_to_parquet(pl.latest_vessels(vessel_stream(t)), "r03").groupBy("mmsi").agg(F.max("observed").alias("observed"), r6(F.max_by("lat", "observed")).alias("lat"), F.max_by("lon", "observed").alias("lon"))


@query("r04_static_enrichment", ctes("reports") + """
, p as (select mmsi from reports where category not in ('signup', 'purchase') group by 1)
select p.mmsi, max_by('ship ' || (event_id % 1000), observed) filter (where category = 'signup') as name, max_by(source, observed) filter (where category = 'purchase') as destination from p join reports using (mmsi) group by 1""")
def _(t):
    pl.use_rocksdb(t.spark)
    out = pl.run_to_parquet(pl.latest_vessels(vessel_stream(t)), "r04")
    last = out.groupBy("mmsi").agg(F.max_by("static", "observed").alias("s"))
    return last.select("mmsi", F.get_json_object("s", "$.name").alias("name"), F.get_json_object("s", "$.destination").alias("destination"))


@query("r05_area_entries", ctes("positions") + _ENTRIES + " select * from ent")
def _(t):
    return en.detect_entries(en.drop_conflicts(c.positions(t)), AREAS, "hour")


def disordered(t):
    """Entries and late reports of a stream to which every fortieth report comes only after all others."""
    pl.use_rocksdb(t.spark)
    cols = ["mmsi", "observed", "lat", "lon", "source"]
    first = c.positions(t, events=c.event_stream(t)).where("event_id % 40 <> 3").select(*cols)
    held_up = c.positions(t).where("event_id % 40 = 3").select(*cols)
    return pl.run_closed(first, lambda s: pl.entries_and_late(s, AREAS), "observed", timedelta(minutes=30), "r05", later=[held_up])


@query("r05_area_entries_stream", ctes("positions") + _ENTRIES + " select * from ent")
def _(t):
    found = disordered(t)
    return en.replay(pl.entry_rows(found), c.positions(t), pl.late_rows(found), AREAS, "hour")


@query("r05_late_reports", ctes("positions") + """
, mark as (select max(observed) - interval 30 minute as m from positions where event_id % 40 <> 3)
select mmsi, count(*) as late, min(observed) as earliest, max(observed) as latest from positions, mark where event_id % 40 = 3 and observed < m group by 1""")
def _(t):
    late = pl.late_rows(disordered(t))
    return late.groupBy("mmsi").agg(F.count(F.lit(1)).alias("late"), F.min("observed").alias("earliest"), F.max("observed").alias("latest"))


@query("r05_area_entries_stream_closed", ctes("positions") + _ENTRIES + " select * from ent")
def _(t):
    pl.use_rocksdb(t.spark)
    p = c.positions(t, events=c.event_stream(t)).select("mmsi", "observed", "lat", "lon", "source")
    return pl.run_closed(p, lambda s: pl.entries(s, AREAS), "observed", timedelta(minutes=30), "r05c")


@query("r06_late_replay", ctes("positions") + _ENTRIES + " select * from ent")
def _(t):
    p = c.positions(t)
    late = p.where("event_id % 40 = 3")
    stored = en.detect_entries(en.drop_conflicts(p.where("event_id % 40 <> 3")), AREAS, "hour")
    return en.replay(stored, p, late, AREAS, "hour")


@query("r07_conflict_drop", """
with q as (select user_id::varchar as mmsi, date_trunc('minute', ts) as observed, 24 + (event_id % 2) * 0.001::double * (user_id % 5) as lat, event_id from events),
f as (select mmsi, observed, min_by(lat, event_id) as fl from q group by 1, 2)
select mmsi, observed, min(fl) as lat from q join f using (mmsi, observed) group by 1, 2 having max(3440.065 * radians(abs(lat - fl))) <= 0.1""")
def _(t):
    q = t.events.select(F.col("user_id").cast("string").alias("mmsi"), F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("observed"), (24 + (F.col("event_id") % 2) * 0.001 * (F.col("user_id") % 5)).alias("lat"), F.lit(54.0).alias("lon"),
                        F.lpad(F.col("event_id").cast("string"), 15, "0").alias("source"))
    return en.drop_conflicts(q).select("mmsi", "observed", "lat")


@query("r08_daily_counts", """
select ts::date as day, event_type as area, count(*) as events from events group by 1, 2""")
def _(t):
    s = c.event_stream(t).withColumn("ts", F.col("ts").cast("timestamp"))
    table = DayTable(t.spark, shared_dir(t.spark, "r08"), "area string, events long")
    newest = replace_keys(["day", "area"])
    pl.run_each_batch(pl.daily_counts(s, "ts", F.col("event_type")), shared_dir(t.spark, "r08-run"), lambda b, i: table.merge(b, i, newest), mode="update")
    return table.read().select("day", "area", "events")


@query("r08_daily_counts_closed", """
select ts::date as day, event_type as area, count(*) as events from events group by 1, 2""")
def _(t):
    s = c.event_stream(t).withColumn("ts", F.col("ts").cast("timestamp"))
    return pl.run_closed(s, lambda x: pl.daily_counts(x, "ts", F.col("event_type")), "ts", timedelta(days=1, hours=1), "r08c")


@query("r09_snapshot_fallback", ctes("reports") + f"""
, m as (select max(observed) as top from reports), w as (select *, row_number() over (partition by mmsi order by observed desc, event_id desc) as rn from reports, m where observed >= top - interval 120 minute)
select mmsi, observed, {q6('lat')} as lat from w where rn = 1""")
def _(t):
    r = c.reports(t).withColumn("received", F.col("event_id"))
    out = pl.recent_snapshot(r, F.lit("2024-03-01").cast("timestamp"), 120, fallback=True)
    return out.select("mmsi", "observed", r6("lat").alias("lat"))


@query("r10_ingest_counters", ctes("reports") + """
, x as (select event_id, case when category = 'error' then 'unsupported' when user_id % 13 = 0 then 'bad id' end as reason from reports)
select count(*) as raw, count(reason) as rejected, arg_max(reason, event_id) filter (where reason is not null) as last_reason from x""")
def _(t):
    x = c.reports(t).withColumn("reason", F.when(F.col("category") == "error", "unsupported").when(F.col("user_id") % 13 == 0, "bad id"))
    return pl.ingest_counters(x, "reason")


@query("r10_stream_counters", ctes("reports") + """
, x as (select event_id, case when category = 'error' then 'unsupported' when user_id % 13 = 0 then 'bad id' end as reason from reports)
select count(*) as raw, count(reason) as rejected, arg_max(reason, event_id) filter (where reason is not null) as last_reason from x""")
def _(t):
    s = c.reports(t, c.event_stream(t))
    tagged = s.select("event_id", F.when(F.col("category") == "error", "unsupported").when(F.col("user_id") % 13 == 0, "bad id").alias("reason"))
    return pl.total_counters(pl.counted_run(tagged, "reason", "r10"))
