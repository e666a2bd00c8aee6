"""Event deliveries, published snapshots, exports and source runs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from periodica.functions.text import guard_formula
from periodica.operators.quality import QualityError, duplicate_keys, require


def bundle_events(events: DataFrame, offset: str = "Asia/Shanghai") -> DataFrame:
    """Distinct delivered events with their business day."""
    return events.select("area", "mmsi", "entered").dropDuplicates(["area", "mmsi", "entered"]).withColumn("day", F.to_date(F.from_utc_timestamp("entered", offset)))


def bundle_breaks(events: DataFrame, coverage: DataFrame) -> DataFrame:
    """Cells whose counted events differ from the declared number, or that are not declared."""
    counted = events.groupBy("area", "day").agg(F.count(F.lit(1)).alias("counted"))
    j = coverage.select("area", "day", "declared").join(counted, ["area", "day"], "full")
    return j.where(~F.col("declared").eqNullSafe(F.coalesce("counted", F.lit(0))))


def check_bundle(events: DataFrame, coverage: DataFrame) -> None:
    """A delivery is taken whole or not at all."""
    require(duplicate_keys(coverage, ["area", "day"]), "coverage repeats a cell")
    require(bundle_breaks(events, coverage), "event count differs from coverage")


def save_bundle(events: DataFrame, coverage: DataFrame, path: str, provider: str) -> None:
    """Each delivered (area, day) replaces its earlier delivery; others stay.

    Cells delivered with no events are written as a marker row, so an empty
    cell also replaces what was there. The rebalance hint lets a very large
    cell be written by several tasks.
    """
    rows = coverage.select("area", "day", "declared").join(events.select("area", "day", "mmsi", "entered"), ["area", "day"], "left")
    out = rows.withColumn("provider", F.lit(provider))
    out.hint("rebalance", "area", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("provider", "area", "day").parquet(path)


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def verified_history(stored: DataFrame) -> DataFrame:
    """Cells whose stored events match the declared count."""
    return stored.groupBy("provider", "area", "day", "declared").agg(F.count("entered").alias("passages")).where(F.col("passages") == F.col("declared"))


def content_version(df: DataFrame) -> str:
    """Order-free signature of schema and rows; one aggregated row reaches the driver."""
    row = signature(df).first()
    names = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in sorted(df.schema.fields, key=lambda f: f.name))
    return hashlib.sha256(f"{names}|{row['rows']}|{row['hash_sum']}|{row['hash_xor']}".encode()).hexdigest()[:32]


def signature(df: DataFrame) -> DataFrame:
    """The parts of the signature as a one-row frame: sixty bits of each row's md5, summed and combined.

    Columns are taken in the order of their names, as text; a null is an empty text behind a mark.
    """
    text = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("")) for c in sorted(df.columns)]
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *text)), 1, 15), 16, 10).cast("long")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h.cast("decimal(38,0)")).alias("hash_sum"), F.bit_xor(h).alias("hash_xor"))


def publish(observations: DataFrame, root: str) -> str:
    """Write (sheet, column, period, value) under its content version, then move the release pointer.

    Releases are appended and readers take the newest, so there is one at any
    time and a failed write is never seen.
    """
    bad = F.col("period").isNull() | (F.abs("value") == float("inf")) | F.isnan("value")
    require(observations.where(F.coalesce(bad, F.lit(False))), "null period or non-finite value")
    require(duplicate_keys(observations, ["sheet", "column", "period"]), "repeated observation")
    spark = observations.sparkSession
    version = content_version(observations)
    observations.where("value is not null").write.mode("overwrite").partitionBy("sheet").parquet(f"{root}/version={version}")
    release = spark.createDataFrame([(version, datetime.now(timezone.utc))], "version string, published_at timestamp")
    release.coalesce(1).write.mode("append").parquet(f"{root}/release")
    return version


def released_version(spark: SparkSession, root: str) -> str:
    return spark.read.parquet(f"{root}/release").agg(F.max_by("version", "published_at").alias("version")).first()["version"]


def read_published(spark: SparkSession, root: str, version: str, sheet: str) -> DataFrame:
    """One sheet at a pinned version; an error if the release has moved on."""
    if released_version(spark, root) != version:
        raise QualityError("the release has changed, reopen it")
    return spark.read.parquet(f"{root}/version={version}").where(F.col("sheet") == sheet)


def sheet_wide(observations: DataFrame, columns: list[str]) -> DataFrame:
    return observations.groupBy("period").pivot("column", columns).agg(F.first("value"))


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with guarded text columns."""
    guard_frame(df).write.mode("overwrite").option("header", True).csv(path)


def guard_frame(df: DataFrame) -> DataFrame:
    return df.select(*[guard_formula(f"`{f.name}`" if "." in f.name else f.name).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def run_sources(spark: SparkSession, sources: dict[str, Callable[[], DataFrame]], sink: Callable[[str, DataFrame], int]) -> DataFrame:
    """Run every source on its own; a failure becomes a status row, not a stop."""
    rows = []
    for name, build in sources.items():
        started = datetime.now(timezone.utc)
        try:
            n = sink(name, build())
            rows.append((name, "ok", n, "", started, datetime.now(timezone.utc)))
        except Exception as exc:  # noqa: BLE001 - sources are isolated from each other
            rows.append((name, "failed", 0, f"{type(exc).__name__}: {exc}", started, datetime.now(timezone.utc)))
    return spark.createDataFrame(rows, "source string, status string, rows long, note string, started_at timestamp, finished_at timestamp")
