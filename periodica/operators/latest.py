"""Newest-row operators that combine map-side instead of sorting a key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from periodica.operators import chunked


def _split_ties(df: DataFrame, keys: list[str], order: list[tuple[str, bool]]) -> tuple[list[str], str | None]:
    lead = [name for name, asc in order if not asc]
    tail = [name for name, asc in order if asc]
    if tail and order[-1][0] != tail[-1] or len(tail) > 1:
        raise ValueError("ascending columns are allowed as the last tie-break only")
    return lead, tail[0] if tail else None


def latest_by(df: DataFrame, keys: list[str], order: list[tuple[str, bool]], keep: list[str]) -> DataFrame:
    """One row per key under a total order, as a partial aggregate.

    ``order`` lists (column, ascending); descending columns come first and put
    NULL last, one ascending column may end the list.
    """
    lead, tail = _split_ties(df, keys, order)
    cols = list(dict.fromkeys([name for name, _ in order] + keep))
    packed = F.struct(*cols)
    if tail is None:
        return df.groupBy(*keys).agg(F.max_by(packed, F.struct(*lead)).alias("_r")).select(*keys, "_r.*")
    # Candidates that share the leading columns are reduced first, by the ascending one.
    best = df.groupBy(*keys, *lead).agg(F.min_by(packed, F.col(tail)).alias("_r"))
    return best.groupBy(*keys).agg(F.max_by("_r", F.struct(*lead)).alias("_r")).select(*keys, "_r.*")


def newest(df: DataFrame, keys: list[str], stamp: str, keep: list[str]) -> DataFrame:
    return latest_by(df, keys, [(stamp, False)], keep)


def one_per_instant(df: DataFrame) -> DataFrame:
    """One position per (vessel, instant): the latest received, then the first source."""
    return latest_by(df, ["mmsi", "observed"], [("event_id", False), ("source", True)], ["lat", "lon"])


def tracks(df: DataFrame, cutoff: DataFrame) -> DataFrame:
    """Numbered points of each vessel up to its own last-seen time.

    Points stay rows: a vessel with very many reports is numbered chunk by
    chunk and never gathered into one array.
    """
    points = one_per_instant(df).join(cutoff, "mmsi").where(F.col("observed") <= F.col("last_seen"))
    points = points.withColumn("_day", F.date_trunc("hour", "observed"))
    return chunked.row_number(points, ["mmsi"], "_day", ["observed"], "point_no").drop("_day", "last_seen")


def merge_snapshots(frames: list[DataFrame], key: str, observed: str, received: str, keep: list[str]) -> DataFrame:
    """Newest row per id over several snapshots.

    A row without an observation time is compared by its receive time.
    """
    union = reduce(lambda a, b: a.unionByName(b), frames)
    stamp: Column = F.coalesce(F.col(observed), F.col(received))
    return union.groupBy(key).agg(
        F.max_by(F.struct(observed, received, *keep), F.struct(stamp, F.col(received))).alias("_r")
    ).select(key, "_r.*")
