"""Row-addressed delimited text, type inference and typed contracts."""

from __future__ import annotations

import csv
import io
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from periodica.operators.quality import QualityError, require
from periodica.sources.records import records

ENCODINGS = ("UTF-8", "GBK", "GB2312")  # tried in this order
DATE_PATTERN = r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2})?)?$"


def _decoded(spark: SparkSession, encoding: str) -> Column:
    """The text source keeps raw bytes; other charsets are decoded by a built-in."""
    if encoding == "UTF-8":
        return F.col("value")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    spark.conf.set("spark.sql.legacy.codingErrorAction", "true")
    return F.decode(F.col("value").cast("binary"), encoding)


def read_lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """(file, start, length, id, value): lines with the split they were read in; ids ascend within it."""
    meta = F.col("_metadata")
    return spark.read.option("lineSep", "\n").text(path).select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("start"), meta["file_block_length"].alias("length"),
        F.monotonically_increasing_id().alias("id"), _decoded(spark, encoding).alias("value"))


def detect_encoding(spark: SparkSession, path: str) -> str:
    """First encoding that decodes the whole text."""
    lines = spark.read.option("lineSep", "\n").text(path)
    for encoding in ENCODINGS:
        bad = ~F.is_valid_utf8("value") if encoding == "UTF-8" else _decoded(spark, encoding).contains("\ufffd")
        if not lines.where(bad).limit(1).count():
            return encoding
    raise QualityError(f"{path}: text is none of {ENCODINGS}")


def unique_names(names: list[str]) -> list[str]:
    """Repeated names get ``__2``, ``__3`` and so on, skipping names in use."""
    seen: dict[str, int] = {}
    out: list[str] = []
    for base in names:
        n = seen.get(base, 0) + 1
        name = base if n == 1 else f"{base}__{n}"
        while name in out:
            n += 1
            name = f"{base}__{n}"
        seen[base] = n
        out.append(name)
    return out


def header_names(cells: list[str]) -> list[str]:
    cells = list(cells)
    while cells and not (cells[-1] or "").strip():
        cells.pop()
    if not cells:
        raise QualityError("header row is empty")
    if any(not (c or "").strip() for c in cells):
        raise QualityError("header row has an empty cell")
    return unique_names([c.strip() for c in cells])


def read_rows(spark: SparkSession, path: str, header_row: int = 0, data_row: int = 1, delimiter: str = ",") -> DataFrame:
    """Text columns of a delimited file or folder, addressed by row.

    Every file has the header on row ``header_row`` and data from ``data_row``,
    counted from 0. Quoted cells may hold line breaks. Blank trailing headers are
    cut, extra filled cells are an error, wholly blank rows are dropped.
    """
    if header_row < 0 or data_row <= header_row:
        raise QualityError("data must start after the header row")
    found = records(read_lines(spark, path, detect_encoding(spark, path)), delimiter, numbered=data_row)
    found = found.withColumn("value", F.regexp_replace("value", "\\r$", ""))
    heads = found.where(F.col("row_no") == header_row).select("value").distinct().limit(2).collect()
    if len(heads) != 1:
        raise QualityError("header row missing or different between files")
    names = header_names(next(csv.reader(io.StringIO(heads[0]["value"].lstrip("﻿")), delimiter=delimiter)))
    fields = [f"_c{i}" for i in range(len(names))]
    ddl = ", ".join(f"{f} string" for f in [*fields, "_over", "_bad"])
    data = found.where(F.col("row_no").isNull() | (F.col("row_no") >= data_row))
    options = {"sep": delimiter, "escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = data.select(F.from_csv("value", ddl, options).alias("r")).select("r.*")
    require(parsed.where(F.trim(F.coalesce("_over", F.lit(""))) != ""), "a row is wider than the header")
    filled = reduce(lambda a, b: a | b, [F.trim(F.coalesce(f, F.lit(""))) != "" for f in fields])
    return parsed.where(filled).select(*[F.when(F.trim(f) != "", F.col(f)).alias(n) for f, n in zip(fields, names)])


def as_time(text: Column) -> Column:
    return F.when(text.rlike(DATE_PATTERN), F.regexp_replace(text, "[/.]", "-").try_cast("timestamp"))


def infer_types(df: DataFrame, time_column: str | None = None) -> DataFrame:
    """Wholly numeric text becomes double, the time column a timestamp; empty columns go.

    One aggregate decides for all columns. A given time column that does not
    parse is an error; without one the first column is used when it parses.
    """
    q = lambda c: F.col(f"`{c}`")
    counts = df.agg(*[x for i, c in enumerate(df.columns) for x in (
        F.count(q(c)).alias(f"n{i}"), F.count(q(c).try_cast("double")).alias(f"f{i}"), F.count(as_time(q(c))).alias(f"d{i}"))]).first()
    out = []
    for i, c in enumerate(df.columns):
        n, numbers, times = counts[f"n{i}"], counts[f"f{i}"], counts[f"d{i}"]
        if n == 0:
            continue
        wanted = c == time_column or (time_column is None and i == 0 and n == times)
        if c == time_column and n != times:
            raise QualityError(f"time column {c!r} has unreadable values")
        out.append(as_time(q(c)).alias(c) if wanted and n == times else q(c).try_cast("double").alias(c) if n == numbers else q(c).alias(c))
    if not out:
        raise QualityError("no data below the header")
    return df.select(*out)


def numeric_variables(df: DataFrame) -> list[str]:
    """Names of number columns; booleans and dates are not numbers."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def suggest_time_column(df: DataFrame) -> str | None:
    return next((f.name for f in df.schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))), None)


def identify_time_column(df: DataFrame, exclude: list[str] | None = None) -> str | None:
    """Date-typed column, else the first text column whose values are all dates."""
    typed = suggest_time_column(df)
    if typed and typed not in (exclude or []):
        return typed
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in (exclude or [])]
    if not text:
        return None
    q = lambda c: F.col(f"`{c}`")
    row = df.agg(*[x for i, c in enumerate(text) for x in (F.count(q(c)).alias(f"n{i}"), F.count(as_time(q(c))).alias(f"d{i}"))]).first()
    return next((c for i, c in enumerate(text) if row[f"n{i}"] and row[f"n{i}"] == row[f"d{i}"]), None)


def read_contract_csv(spark: SparkSession, path: str, required: list[str], numbers: list[str], strings: list[str], day: str = "date") -> DataFrame:
    """Daily CSV that must hold its required columns; a bad cell fails the read."""
    raw = spark.read.option("header", True).csv(path)
    missing = [c for c in required if c not in raw.columns]
    if missing:
        raise QualityError(f"{path}: missing columns {missing}")
    out = raw.select(F.substring(F.trim(day), 1, 10).try_cast("date").alias(day), *[F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in strings],
                     *[F.trim(F.col(c)).try_cast("long").alias(c) for c in numbers])
    broken = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in [day, *numbers]])
    require(out.where(broken), f"{path}: unreadable date or number")
    return out


def read_shards(spark: SparkSession, paths: list[str] | str, columns: list[str], delimiter: str = ",") -> tuple[DataFrame, DataFrame]:
    """Good rows of (gzipped) CSV shards and a one-row frame with read, bad and filled counts."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, "_bad"]])
    raw = spark.read.schema(schema).option("header", True).option("sep", delimiter).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").csv(paths)
    filled = reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit("")) != "" for c in columns])
    counts = raw.agg(F.count(F.lit(1)).alias("rows_read"), F.count_if(F.col("_bad").isNotNull()).alias("bad_rows"), F.count_if(filled).alias("filled_rows"))
    return raw.where(F.col("_bad").isNull() & filled).drop("_bad"), counts


ENVELOPE_KEYS = ("data", "records", "results", "items", "rows")  # tried in this order


def read_envelopes(spark: SparkSession, paths: list[str] | str, record: T.StructType) -> DataFrame:
    """Records of JSON lines: plain objects, or envelopes holding a record list."""
    env = T.StructType([T.StructField(k, T.ArrayType(record)) for k in ENVELOPE_KEYS])
    lines = spark.read.text(paths).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", env).alias("e"), F.from_json("value", record).alias("r"))
    listed = F.coalesce(*[F.col(f"e.{k}") for k in ENVELOPE_KEYS], F.array(F.col("r")))
    return parsed.select(F.explode(listed).alias("r")).select("r.*")


def typed_transactions(df: DataFrame) -> DataFrame:
    """Sale columns with failed casts as NULL and the decimal tail of project numbers cut."""
    e = lambda c: F.when(F.col(c) != "", F.col(c))
    return df.select(
        e("actual_worth").try_cast("decimal(24,2)").alias("actual_worth"), e("instance_date").try_cast("date").alias("instance_date"),
        e("load_timestamp").try_cast("timestamp").alias("load_timestamp"), F.regexp_replace(e("project_number"), r"\.0+$", "").alias("project_number"),
        *[e(c).alias(c) for c in ("property_type_en", "property_usage_en", "reg_type_en", "trans_group_en", "transaction_id")])


def date_quality(df: DataFrame, text: str) -> DataFrame:
    """Row, early and unreadable date counts of merged shards, in one pass."""
    d = F.substring(F.col(text), 1, 10).try_cast("date")
    floor = F.lit("1900-01-01").cast("date")
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(d < floor).alias("before_1900"), F.count_if(d.isNull()).alias("unparseable"),
        F.min(d).alias("first_date"), F.max(d).alias("last_date"), F.min(F.when(d >= floor, d)).alias("first_since_1900"))


def sdmx_slice(df: DataFrame, fixed: dict[str, str], code: str, labels: dict[str, str], unit: tuple[str, str], period: Column, keys: list[str], positive: bool = False) -> tuple[DataFrame, DataFrame]:
    """Observations of one dimension slice, and the rows that break its rules.

    ``fixed`` are the codes every kept row has; ``unit`` is (column, expected).
    """
    hit = reduce(lambda a, b: a & b, [F.col(k) == v for k, v in fixed.items()])
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    rows = df.where(hit & F.col(code).isin(*labels)).select(
        period.alias("period"), F.try_element_at(table, F.col(code)).alias("indicator"), F.col("OBS_VALUE").try_cast("double").alias("value"), F.col(unit[0]).alias("_unit"),
        *[F.col(k) for k in keys if k not in ("period", "indicator")])
    v = F.col("value")
    bad_value = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) | ((v <= 0) if positive else F.lit(False))
    dup = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("period", "indicator", F.lit("duplicate").alias("problem"))
    wrong = rows.select("period", "indicator", F.when(F.col("period").isNull(), "bad_period").when(F.col("_unit") != unit[1], "bad_unit").when(bad_value, "bad_value").alias("problem")).where("problem is not null")
    return rows.drop("_unit"), dup.unionByName(wrong)


def merge_registry(reviewed: DataFrame, generated: DataFrame, day: str) -> DataFrame:
    """Reviewed days win; generated ones only extend them after their last day."""
    last = reviewed.agg(F.max(day).alias("d")).scalar()
    return reviewed.unionByName(generated.where(F.coalesce(F.col(day) > last, F.lit(True))))


def registry_breaks(df: DataFrame, day: str, counts: list[str], start: Column) -> DataFrame:
    """Days that are missing, before the start, or hold a negative count."""
    from periodica.operators.quality import missing_periods

    bad = reduce(lambda a, b: a | b, [F.coalesce(F.col(c) < 0, F.lit(True)) for c in counts])
    wrong = df.where(bad).select(day, F.lit("bad_count").alias("problem"))
    gaps = missing_periods(df.withColumn("_k", F.lit(1)), ["_k"], day, "day").select(day, F.lit("missing_day").alias("problem"))
    early = df.agg(F.min(day).alias(day)).where(F.col(day) != start).select(day, F.lit("wrong_start").alias("problem"))
    return wrong.unionByName(gaps).unionByName(early)


def flatten_documents(df: DataFrame, path: str, content: str) -> DataFrame:
    """Nested JSON documents to one row per record: (path, section, row_no, payload)."""
    sections = F.from_json(F.col(content), "map<string,string>")
    one = df.select(F.col(path).alias("path"), F.explode(sections).alias("section", "_body"))
    items = F.coalesce(F.from_json("_body", "array<string>"), F.array("_body"))
    return one.select("path", "section", F.posexplode(items).alias("row_no", "payload"))
