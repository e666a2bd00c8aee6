"""Registry of runnable queries: a Spark plan and, where SQL can say it, the SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from periodica.session import prepare_session

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


class Tables:
    """Lazy parquet tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, build, sql)
        return build

    return register


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    prepare_session(spark)
    return REGISTRY[name].build(Tables(spark, folder))


def r6(value: Column | str, digits: int = 6) -> Column:
    """Rounded double, the form in which both engines are compared."""
    c = F.col(value) if isinstance(value, str) else value
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def q6(expr: str, digits: int = 6) -> str:
    return f"(round(({expr})::double, {digits}) + 0.0)"


def f32(value: Column | str) -> Column:
    """Seven significant digits; means of cents often sit on a decimal rounding tie."""
    c = F.col(value) if isinstance(value, str) else value
    return c.cast("float").cast("double")


def qf(expr: str) -> str:
    return f"(({expr})::float)::double"
