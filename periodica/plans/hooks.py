"""Extension points: a callback per series and step generators."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def apply_per_series(series: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run a user's function on each series (ordered by time) in Arrow batches.

    ``series`` has one row per (series, ts), so a group is one calendar long;
    reduce raw events to periods before calling it.
    """

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        out = fn(pdf.sort_values("ts")[["ts", "value"]].reset_index(drop=True))
        out.insert(0, "series", key[0])
        return out

    kind = series.schema["series"].dataType.simpleString()
    return series.groupBy("series").applyInPandas(one, f"series {kind}, {schema}")


def steps_ahead(n: int) -> Column:
    """One row per step 1..n."""
    return F.explode(F.sequence(F.lit(1), F.lit(n)))


def lags_around(n: int) -> Column:
    """One row per lag -n..n."""
    return F.explode(F.sequence(F.lit(-n), F.lit(n)))
