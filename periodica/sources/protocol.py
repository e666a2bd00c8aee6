"""Indicator sheets: metadata rows over a wide data block, to long observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from periodica.functions.text import normalise_name
from periodica.operators.quality import require

# fixed values: frequency labels
FREQUENCY_LABELS = {
    "日": "daily", "日度": "daily", "周": "weekly", "周度": "weekly", "旬": "ten_day", "旬度": "ten_day", "月": "monthly", "月度": "monthly",
    "季": "quarterly", "季度": "quarterly", "年": "yearly", "年度": "yearly",
}


def to_long(wide: DataFrame, period: str, columns: list[str]) -> DataFrame:
    """One row per (period text, column, value text)."""
    return wide.select(F.col(period).alias("period_text"), *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        "period_text", columns, "column", "value_text")


def parse_sheet(long: DataFrame, metadata: DataFrame, dictionary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registered observations and everything that breaks the protocol.

    ``metadata`` (column, name, frequency, unit, source, updated) describes the
    columns; ``dictionary`` (name, ...) registers indicators. Zero is missing.
    """
    d = dictionary.withColumn("indicator", normalise_name("name")).drop("name")
    m = metadata.withColumn("indicator", normalise_name("name")).drop("name").join(d, "indicator")
    table = F.create_map(*[F.lit(x) for kv in FREQUENCY_LABELS.items() for x in kv])
    m = m.withColumn("label", F.trim("frequency")).withColumn("frequency", F.try_element_at(table, F.trim("frequency")))
    text = F.trim("value_text")
    rows = long.join(m, "column").withColumn("period", F.trim("period_text").try_cast("date")).withColumn("value", text.try_cast("double"))
    problems = (
        m.groupBy("indicator").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("indicator", F.lit("repeated_indicator").alias("problem"))
        .unionByName(m.where("frequency is null").select("indicator", F.lit("unknown_frequency").alias("problem")))
        .unionByName(m.where(F.coalesce(F.trim("source"), F.lit("")) == "").select("indicator", F.lit("missing_source").alias("problem")))
        .unionByName(rows.where("period is null").select("indicator", F.lit("invalid_date").alias("problem")).distinct())
        .unionByName(rows.where(F.col("value").isNull() & (text != "")).select("indicator", F.lit("not_numeric").alias("problem")).distinct())
        .unionByName(rows.groupBy("indicator", "period").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("column").alias("k")).where("n > k").select("indicator", F.lit("duplicate_date").alias("problem")).distinct())
        .unionByName(d.join(m.select("indicator"), "indicator", "left_anti").select("indicator", F.lit("not_in_sheets").alias("problem")))
    )
    keep = ["indicator", "frequency", "unit", "source", "updated", *[c for c in d.columns if c != "indicator"]]
    good = rows.select(*keep, "period", F.when(F.col("value") != 0, F.col("value")).alias("value"))
    return good, problems


def read_targets(long: DataFrame, metadata: DataFrame, targets: DataFrame, frequencies: list[str], zero_is_missing: bool = True) -> tuple[DataFrame, DataFrame]:
    """Values of the target series and the targets that could not be matched.

    ``targets`` (display, name, unit). Among repeated columns the one with an
    allowed frequency, the expected unit and a source is taken; a lone column
    must meet the same conditions.
    """
    t = targets.withColumn("indicator", normalise_name("name")).select("display", "indicator", F.col("unit").alias("expected"))
    m = metadata.withColumn("indicator", normalise_name("name")).drop("name").join(t, "indicator")
    fits = F.col("frequency").isin(*frequencies) & (F.col("unit") == F.col("expected")) & (F.coalesce(F.trim("source"), F.lit("")) != "")
    per = m.withColumn("_f", F.coalesce(fits, F.lit(False))).groupBy("display", "indicator").agg(
        F.count_if(F.col("_f")).alias("fitting"), F.count(F.lit(1)).alias("columns"), F.max(F.when(F.col("_f"), F.col("column"))).alias("column"))
    problem = F.when(F.col("columns").isNull(), "missing").when(F.col("fitting") > 1, "repeated").when(F.col("fitting") == 0, F.when(F.col("columns") == 1, "does_not_fit").otherwise("no_unique_fit"))
    state = t.select("display").join(per, "display", "left").withColumn("problem", problem)
    v = F.trim("value_text").try_cast("double")
    rows = long.join(state.where("problem is null").select("display", "column"), "column").select(
        "display", F.trim("period_text").try_cast("date").alias("period"), (F.when(v != 0, v) if zero_is_missing else v).alias("value"))
    return rows.where("value is not null"), state.where("problem is not null").select("display", "problem")


def require_valid(problems: DataFrame) -> None:
    require(problems, "sheet breaks the protocol")
