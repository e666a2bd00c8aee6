"""Vessel messages, archived reports, tracks and GeoJSON features to position rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from periodica.functions.geo import region_of, valid_coordinate
from periodica.functions.text import parse_utc
from periodica.operators.filters import ship_class
from periodica.operators.quality import quarantine, require

# fixed values: message types
POSITION_TYPES = ("PositionReport", "StandardClassBPositionReport", "ExtendedClassBPositionReport", "LongRangeAisBroadcastMessage")
STATIC_TYPES = ("ShipStaticData", "StaticDataReport")
# fixed values: region boxes as (name, south, north, west, east), first match wins
REGION_BOXES = [
    ("霍尔木兹海峡", 25.7, 27.4, 55.9, 57.5), ("阿曼湾", 22.0, 26.6, 56.0, 61.8), ("波斯湾", 23.5, 30.9, 47.0, 56.8),
    ("苏伊士运河", 29.4, 31.6, 31.7, 33.5), ("曼德海峡", 11.0, 15.4, 42.0, 45.7), ("红海北段", 21.0, 30.0, 32.0, 40.0),
    ("红海南段", 12.0, 21.0, 36.0, 44.0), ("红海北部两湾", 28.1396, 30.5, 32.0, 35.8), ("亚丁湾", 10.3781, 15.2197, 42.5134, 51.2867),
]
# fixed values: collection boxes around the counted waters
COLLECTION_BOXES = [
    ("波斯湾", 23.6590, 31.4859, 47.4024, 57.6400), ("阿曼湾", 22.1749, 26.2435, 55.9680, 62.0825), ("亚丁湾", 10.0780, 15.5197, 42.2134, 51.5867),
    ("红海北段", 20.3, 28.4396, 33.3393, 43.8056), ("红海南段", 12.1562, 20.3, 33.3393, 43.8056), ("红海北部两湾", 28.1396, 30.5, 32.0, 35.8),
    ("苏伊士运河", 29.4, 31.6, 31.7, 33.5), ("曼德海峡", 11.0, 15.4, 42.0, 45.7),
]
# fixed values: vessel classes and their labels
CLASS_LABELS = {
    "tanker": "油轮/液货船", "cargo": "货船", "passenger": "客船", "fishing": "渔船", "tug": "拖轮/作业船", "pleasure": "帆船/游艇", "other": "其他船舶", "unknown": "船型待识别",
}
ID_LOW, ID_HIGH = 100000000, 999999999


def clean_text(c: Column) -> Column:
    t = F.trim(F.regexp_replace(c.cast("string"), "@", ""))
    return F.when(t != "", t)


def usable(value: Column, below: float) -> Column:
    """Sentinel readings (at or above ``below``, negative) are missing."""
    v = value.try_cast("double")
    return F.when((v >= 0) & (v < below), v)


def valid_id(mmsi: Column) -> Column:
    return F.coalesce(mmsi.between(ID_LOW, ID_HIGH), F.lit(False))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a one-element generator, so that later filters and
    projections read them instead of repeating the parse."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


# fixed values: the fields that are read of a message's metadata, of its payload and of the payload's two parts
META_FIELDS = ("MMSI", "Latitude", "Longitude", "ShipName", "time_utc", "TimeUTC", "timestamp")
PAYLOAD_FIELDS = (
    "UserID", "Latitude", "Longitude", "TrueHeading", "Cog", "Sog", "NavigationalStatus", "Type", "ShipType", "Name", "ShipName", "CallSign", "ImoNumber", "IMO",
    "DestinationName", "Destination", "MaximumStaticDraught", "Draught",
)
PART_FIELDS = ("Valid", "Name", "ShipType", "CallSign")


def _strings(fields: tuple[str, ...], more: str = "") -> str:
    return "struct<" + ", ".join(f"{f}: string" for f in fields) + more + ">"


def open_messages(df: DataFrame, content: str) -> DataFrame:
    """Message type, metadata, payload and report parts beside the original columns; a text is parsed once, for these fields only."""
    part = _strings(PART_FIELDS)
    payload = _strings(PAYLOAD_FIELDS, f", ReportA: {part}, ReportB: {part}")
    kinds = (*POSITION_TYPES, *STATIC_TYPES)
    body = once(df, _doc=F.from_json(content, f"MessageType string, MetaData {_strings(META_FIELDS)}, Message struct<" + ", ".join(f"{k}: {payload}" for k in kinds) + ">"))
    kind = F.col("_doc.MessageType")
    opened = once(body, _kind=kind, _meta=F.col("_doc.MetaData"), _payload=F.coalesce(*[F.when(kind == k, F.col(f"_doc.Message.{k}")) for k in kinds]))
    usable_part = lambda name: F.when(F.coalesce(F.col(f"_payload.{name}.Valid"), F.lit("true")) != "false", F.col(f"_payload.{name}"))
    return once(opened, _a=usable_part("ReportA"), _b=usable_part("ReportB")).drop("_doc")


def message_rules() -> list[tuple[Column, str]]:
    """Reasons to reject a message, first match first."""
    m = lambda k: F.col(f"_meta.{k}")
    p = lambda k: F.col(f"_payload.{k}")
    mmsi = F.coalesce(m("MMSI"), p("UserID")).try_cast("long")
    lat, lon = F.coalesce(m("Latitude"), p("Latitude")).try_cast("double"), F.coalesce(m("Longitude"), p("Longitude")).try_cast("double")
    is_position = F.col("_kind").isin(*POSITION_TYPES)
    return [
        (~F.coalesce(F.col("_kind").isin(*POSITION_TYPES, *STATIC_TYPES), F.lit(False)), "unsupported_type"),
        (~valid_id(mmsi), "invalid_id"),
        (is_position & ~valid_coordinate(lat, lon), "invalid_position"),
    ]


def normalise_messages(df: DataFrame, content: str, received: str) -> tuple[DataFrame, DataFrame]:
    """Good messages as one typed row each, and the rejected ones with reasons.

    Works the same on a batch and on a stream: column expressions only.
    """
    opened = open_messages(df, content)
    good, bad = quarantine(opened, message_rules())
    m = lambda *ks: F.coalesce(*[F.col(f"_meta.{k}") for k in ks])
    p = lambda *ks: F.coalesce(*[F.col(f"_payload.{k}") for k in ks])
    position = F.col("_kind").isin(*POSITION_TYPES)
    a, b = (lambda k: F.col(f"_a.{k}")), (lambda k: F.col(f"_b.{k}"))
    lat, lon = F.coalesce(m("Latitude"), p("Latitude")).try_cast("double"), F.coalesce(m("Longitude"), p("Longitude")).try_cast("double")
    heading, cog = usable(p("TrueHeading"), 360.0), usable(p("Cog"), 360.0)
    code = F.when(position, p("Type", "ShipType")).otherwise(F.coalesce(p("Type", "ShipType"), b("ShipType"))).try_cast("int")
    only = lambda c: F.when(position, c)
    static = lambda c: F.when(~position, c)
    out = good.select(
        F.coalesce(m("MMSI"), p("UserID")).try_cast("long").cast("string").alias("mmsi"), parse_utc(m("time_utc", "TimeUTC", "timestamp")).alias("observed"),
        F.col(received).alias("received"), F.col("_kind").alias("message_type"), F.when(position, "position").otherwise("static").alias("kind"),
        F.when(position, clean_text(m("ShipName"))).otherwise(clean_text(F.coalesce(p("Name", "ShipName"), a("Name"), m("ShipName")))).alias("name"),
        only(lat).alias("lat"), only(lon).alias("lon"), only(region_of(lat, lon, REGION_BOXES)).alias("region"), only(usable(p("Sog"), 102.3)).alias("sog"),
        only(cog).alias("cog"), only(heading).alias("heading"), only(F.coalesce(heading, cog)).alias("course"), only(p("NavigationalStatus").try_cast("int")).alias("status_code"),
        code.alias("ship_type"), F.when(code.isNotNull(), ship_class(code)).alias("category"), static(clean_text(F.coalesce(p("CallSign"), b("CallSign")))).alias("call_sign"),
        static(p("ImoNumber", "IMO").try_cast("long")).alias("imo"), static(clean_text(p("DestinationName", "Destination"))).alias("destination"),
        static(p("MaximumStaticDraught", "Draught").try_cast("double")).alias("draught"))
    return out, bad.drop("_kind", "_meta", "_payload", "_a", "_b")


# fixed values: aliases of the archived report columns, first present wins
REPORT_ALIASES = {
    "mmsi": ("mmsi", "MMSI"), "observed": ("observed_at", "AIS报告时间 UTC"), "received": ("received_at", "采集器接收时间 UTC"), "lat": ("lat", "纬度"), "lon": ("lon", "经度"),
    "sog": ("sog", "航速 节"), "course": ("course", "航向 °"), "source": ("source", "data_source", "数据源"), "name": ("name", "船名"), "category": ("category",), "label": ("船型",), "live": ("data_source",), "destination": ("destination", "目的地"),
}


def known_class(category: Column, label: Column) -> Column:
    """Vessel class from its name, or else from its label; any other is unknown."""
    names = F.create_map(*[F.lit(x) for kv in CLASS_LABELS.items() for x in kv[::-1]])
    found = F.coalesce(F.nullif(category, F.lit("")), F.try_element_at(names, label))
    return F.when(found.isin(*CLASS_LABELS), found).otherwise("unknown")


def normalise_reports(df: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Archived reports with aliased columns, and the rejected ones with reasons.

    A historic import names no data source; where it has no report time the time
    of receipt stands in. Live rows must have their own.
    """
    have = set(df.columns)
    pick = lambda n: F.coalesce(*[F.col(f"`{c}`").cast("string") for c in REPORT_ALIASES[n] if c in have], F.lit(None).cast("string"))
    r = df.select(*[pick(n).alias(n) for n in REPORT_ALIASES])
    r = r.select(F.col("mmsi").try_cast("long").alias("mmsi"), F.coalesce(parse_utc("observed"), F.when(F.coalesce(F.col("live"), F.lit("")) == "", parse_utc("received"))).alias("observed"), parse_utc("received").alias("received"), F.col("lat").try_cast("double").alias("lat"),
                 F.col("lon").try_cast("double").alias("lon"), usable(F.col("sog"), 102.3).alias("sog"), usable(F.col("course"), 360.0).alias("course"), F.when(F.trim("source") != "", F.col("source")).alias("source"),
                 "name", known_class(F.col("category"), F.col("label")).alias("category"), "destination")
    inside = region_of(F.col("lat"), F.col("lon"), COLLECTION_BOXES).isNotNull()
    good, bad = quarantine(r, [
        (~valid_id(F.col("mmsi")), "invalid_id"), (F.col("observed").isNull() | (F.col("observed") > now + F.expr("interval 5 minutes")), "bad_time"),
        (~(valid_coordinate(F.col("lat"), F.col("lon")) & inside), "outside_area"), (F.col("source").isNull(), "missing_source")])
    return good.withColumn("mmsi", F.col("mmsi").cast("string")).withColumn("region", region_of(F.col("lat"), F.col("lon"), REGION_BOXES)).withColumn(
        "moving", F.coalesce(F.col("sog"), F.lit(0.0)) >= 0.5), bad


def explode_tracks(df: DataFrame, content: str, day: Column, expected: Column | None = None) -> DataFrame:
    """Aligned coordinate and time arrays to one row per point of the requested day.

    Lines and single points are read. Points outside the collection area are left
    out; a track of another vessel than ``expected`` fails the job.
    """
    doc = df.select(*([expected.cast("string").alias("expected")] if expected is not None else []), F.from_json(content, "type string, geometry struct<type string, coordinates string>, properties struct<mmsi string, times array<string>, sog array<double>, cog array<double>, heading array<double>>").alias("f"))
    if expected is not None:
        require(doc.where(~F.col("f.properties.mmsi").eqNullSafe(F.col("expected"))), "track of another vessel")
    text, shape = F.col("f.geometry.coordinates"), F.col("f.geometry.type")
    places = F.when(shape == "LineString", F.from_json(text, "array<array<double>>")).when(shape == "Point", F.array(F.from_json(text, "array<double>")))
    doc = doc.withColumn("places", places)
    ok = (F.col("f.type") == "Feature") & (F.size("places") == F.size("f.properties.times"))
    series = lambda name: F.coalesce(F.col(f"f.properties.{name}"), F.array().cast("array<double>"))
    z = F.arrays_zip(F.col("places").alias("c"), F.col("f.properties.times").alias("t"), series("sog").alias("s"), series("cog").alias("g"), series("heading").alias("h"))
    rows = doc.where(ok).select(F.col("f.properties.mmsi").alias("mmsi"), F.posexplode(z).alias("point_no", "p"))
    observed = parse_utc(F.col("p.t"))
    lat, lon = F.try_element_at("p.c", F.lit(2)), F.try_element_at("p.c", F.lit(1))
    return rows.select(
        "mmsi", "point_no", observed.alias("observed"), lat.alias("lat"), lon.alias("lon"), usable(F.col("p.s"), 102.3).alias("sog"),
        F.coalesce(usable(F.col("p.h"), 360.0), F.col("p.g")).alias("course")).where((F.to_date("observed") == day) & valid_coordinate(F.col("lat"), F.col("lon")) & region_of(F.col("lat"), F.col("lon"), COLLECTION_BOXES).isNotNull())


def feature_positions(df: DataFrame, content: str, received: str) -> DataFrame:
    """Vessel features of a GeoJSON snapshot inside the collection area."""
    f = F.from_json(content, "id string, geometry struct<coordinates array<double>>, properties map<string,string>")
    d = df.select(F.col(received).alias("received"), f.alias("f"))
    g = lambda *ks: F.coalesce(*[F.try_element_at(F.col("f.properties"), F.lit(k)) for k in ks])
    lon, lat = F.try_element_at("f.geometry.coordinates", F.lit(1)), F.try_element_at("f.geometry.coordinates", F.lit(2))
    mmsi = F.coalesce(g("mmsi"), F.col("f.id")).try_cast("long")
    heading, cog, sog = usable(g("heading"), 360.0), usable(g("cog"), 360.0), usable(g("sog"), 102.3)
    observed = parse_utc(g("seen"))
    ok = (F.coalesce(g("kind"), F.lit("vessel")) == "vessel") & valid_coordinate(lat, lon) & valid_id(mmsi) & region_of(lat, lon, COLLECTION_BOXES).isNotNull()
    code = g("type").try_cast("int")
    return d.where(F.coalesce(ok, F.lit(False))).select(
        mmsi.cast("string").alias("mmsi"), observed.alias("observed"), "received", lat.alias("lat"), lon.alias("lon"), region_of(lat, lon, REGION_BOXES).alias("region"), sog.alias("sog"),
        F.coalesce(heading, cog).alias("course"), ship_class(code).alias("category"), F.coalesce(clean_text(g("source")), F.lit("unknown")).alias("source"),
        F.when(observed.isNotNull(), F.greatest(F.lit(0.0), (F.unix_micros("received") - F.unix_micros(observed)) / 6e7)).alias("age_minutes"))


def newest_snapshots(df: DataFrame, group: str, stamp: str) -> DataFrame:
    """All rows of the newest snapshot of each request group."""
    top = df.groupBy(group).agg(F.max(stamp).alias(stamp))
    return df.join(top, [group, stamp], "left_semi")
