"""Nested JSON series, node facts and GeoJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from periodica.operators.quality import require


def parallel_series(df: DataFrame, content: str, dates: str, series: dict[str, str], date_format: str) -> DataFrame:
    """Parallel date and value arrays to long rows; unequal lengths fail."""
    fields = [f"{dates} array<string>", *[f"{k} array<double>" for k in series]]
    doc = df.select(F.from_json(content, ", ".join(fields)).alias("d"))
    uneven = [F.size(f"d.{k}") != F.size(f"d.{dates}") for k in series]
    require(doc.where(F.greatest(*[u.cast("int") for u in uneven], F.lit(0)) == 1), "date and value arrays differ in length")

    def one(key: str, name: str) -> Column:
        zipped = F.arrays_zip(F.col(f"d.{dates}").alias("t"), F.col(f"d.{key}").alias("v"))
        return F.transform(zipped, lambda x: F.struct(x["t"].alias("t"), F.lit(name).alias("indicator"), x["v"].alias("value")))

    packed = F.concat(*[one(k, name) for k, name in series.items()])
    rows = doc.select(F.inline(packed)).where("value is not null")
    return rows.select(F.try_to_date("t", date_format).alias("period"), "indicator", "value")


def record_series(df: DataFrame, content: str, path: str, record: str, period: Column, value: Column, guard: Column | None = None) -> DataFrame:
    """Array of records below ``path`` to (period, value); ``guard`` must hold for every record."""
    doc = df.select(F.from_json(F.get_json_object(content, path), f"array<struct<{record}>>").alias("a")).select(F.explode("a").alias("r")).select("r.*")
    if guard is not None:
        require(doc.where(~F.coalesce(guard, F.lit(False))), "records belong to another series")
    return doc.select(period.alias("period"), value.alias("value"))


def incomplete_pages(df: DataFrame, content: str, total: str, path: str) -> DataFrame:
    """Documents whose declared total differs from the records they hold."""
    n = F.size(F.from_json(F.get_json_object(content, path), "array<string>"))
    t = F.get_json_object(content, total).try_cast("int")
    return df.withColumn("declared", t).withColumn("held", n).where(~F.coalesce(t == n, F.lit(False)))


def fact_columns(df: DataFrame, payload: str, numbers: dict[str, str], texts: dict[str, str] | None = None) -> DataFrame:
    """Typed columns out of a JSON payload; a failed cast is NULL."""
    g = lambda p: F.get_json_object(payload, p)
    return df.select("*", *[g(p).try_cast("double").alias(n) for n, p in numbers.items()], *[g(p).alias(n) for n, p in (texts or {}).items()])
