"""A keyed table that a stream merges into, safe against batches that are repeated.

Rows lie in day folders. A batch reads the days it touches as they stood before
it, writes them anew under its own number, and last a small list of which number
holds each day. A batch that fails leaves no list, so readers never see its files
and its repetition starts from the same state. A batch that already has its list
is done. Work follows the days of the batch, not the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class DayTable:
    """``schema`` holds the rows without their day; ``day`` is the name of the day column they are kept by."""

    def __init__(self, spark: SparkSession, root: str, schema: str | T.StructType, day: str = "day"):
        self.spark, self.root, self.day = spark, root.rstrip("/"), day
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if day not in self.schema.names:
            self.schema = T.StructType([*self.schema.fields, T.StructField(day, T.DateType())])
        self._write_list({}, -1)

    def _write_list(self, days: dict, batch: int) -> None:
        rows = self.spark.createDataFrame(list(days.items()), "day date, version long")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/lists/batch={batch}")

    def _lists(self) -> DataFrame:
        return self.spark.read.schema("day date, version long, batch long").parquet(f"{self.root}/lists")

    def batches(self) -> list[int]:
        """Numbers of the batches that are done; batches without rows included."""
        paths = self.spark.read.format("binaryFile").load(f"{self.root}/lists").select(F.regexp_extract("path", r"batch=(-?\d+)/", 1).cast("long").alias("b"))
        return sorted(r["b"] for r in paths.distinct().collect() if r["b"] >= 0)

    def _versions(self, before: int | None = None) -> dict:
        """Day to version, one entry a calendar day."""
        done = [b for b in self.batches() if before is None or b < before]
        return {r["day"]: r["version"] for r in self._lists().where(F.col("batch") == max(done)).collect()} if done else {}

    def _rows(self, versions: dict, spark: SparkSession) -> DataFrame:
        data = f"{self.root}/data"
        paths = [f"{data}/batch={v}/{self.day}={d.isoformat()}" for d, v in sorted(versions.items())]
        if not paths:
            return spark.createDataFrame([], self.schema)
        return spark.read.option("basePath", data).schema(self.schema).parquet(*paths).select(*self.schema.names)

    def read(self) -> DataFrame:
        return self._rows(self._versions(), self.spark)

    def merge(self, incoming: DataFrame, batch: int, merged: Merge) -> None:
        """Replace the days of ``incoming`` by ``merged(stored, incoming)``; rows of other days would be an error of ``merged``."""
        if batch in self.batches():
            return
        versions = self._versions(before=batch)
        touched = [r[0] for r in incoming.select(self.day).distinct().collect()]
        if any(d is None for d in touched):
            raise ValueError("a row has no day")
        stored = self._rows({d: v for d, v in versions.items() if d in touched}, incoming.sparkSession)
        if touched:
            out = merged(stored, incoming).select(*self.schema.names)
            out.hint("rebalance", self.day).write.mode("overwrite").partitionBy(self.day).parquet(f"{self.root}/data/batch={batch}")
        self._write_list(versions | {d: batch for d in touched}, batch)


def replace_keys(keys: list[str]) -> Merge:
    """Incoming rows take the place of stored rows of the same key."""
    return lambda stored, incoming: stored.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming.select(*stored.columns))
