"""Warping distances of many pairs of series, of any length.

A pair is aligned on common times or on the common range of both, standardised,
and warped with squared costs, within a band if one is given. The cost matrix of a
short pair is filled in one task, along anti-diagonals. That of a long pair is cut
into tiles: a tile needs the borders of the tiles above and to the left only, so
all tiles of one anti-diagonal, of all long pairs, are filled in parallel, and the
borders are carried to the next. No task holds more than a tile and its borders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from periodica.operators.joins import align_pairs
from periodica.session import cut_lineage

PAIR = ["target", "candidate"]
MIN_SAMPLES = 10  # fixed value
#: Points of a side up to which a pair is one task, and points of a tile's side.
LONGEST, TILE = 4096, 2048


def fill(a: np.ndarray, b: np.ndarray, above: np.ndarray, left: np.ndarray, first: tuple[int, int], radius: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Last row and last column of a tile, each behind the cell before it.

    ``above`` and ``left`` are the row above and the column to the left, from their
    common corner; ``first`` is the place of the tile's first cell in the matrix.
    """
    n, m = len(a), len(b)
    below, right = np.full(m + 1, np.inf), np.full(n + 1, np.inf)
    below[0], right[0] = left[n], above[m]
    prev2, prev1 = np.full(n + 1, np.inf), np.full(n + 1, np.inf)
    prev2[0] = above[0]
    prev1[0], prev1[1] = above[1], left[1]
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        j = d - i
        cur = np.full(n + 1, np.inf)
        cost = (a[i - 1] - b[j - 1]) ** 2
        if radius is not None:
            cost = np.where(np.abs(i + first[0] - j - first[1]) <= radius, cost, np.inf)
        cur[i] = cost + np.minimum(np.minimum(prev1[i - 1], prev1[i]), prev2[i - 1])
        if d <= m:
            cur[0] = above[d]
        if d <= n:
            cur[d] = left[d]
        if i[-1] == n:
            below[j[-1]] = cur[n]
        if j[0] == m:
            right[i[0]] = cur[i[0]]
        prev2, prev1 = prev1, cur
    return below, right


def warp_distance(a: np.ndarray, b: np.ndarray, radius: int | None) -> float:
    """Distance of two sequences; infinite where the band lets no way through."""
    edge = lambda k: np.concatenate([[0.0], np.full(k, np.inf)])
    return float(np.sqrt(fill(a, b, edge(len(b)), edge(len(a)), (0, 0), radius)[0][len(b)]))


def _points(series: DataFrame, pairs: DataFrame, strict: bool, standardise: bool) -> DataFrame:
    """(pair, side, i, value) of the aligned points, i from 0."""
    if strict:
        both = F.array(F.struct(F.lit("target").alias("side"), F.col("x").alias("value")), F.struct(F.lit("candidate").alias("side"), F.col("y").alias("value")))
        rows = align_pairs(series, pairs, strict=True).select(*PAIR, "ts", F.inline(both))
    else:
        rows = align_pairs(series, pairs, strict=False).select(*PAIR, "ts", "side", "value")
    rows = rows.withColumn("value", F.col("value").cast("double"))
    own = Window.partitionBy(*PAIR, "side")
    if standardise:
        sd = F.stddev_samp("value").over(own)
        rows = rows.withColumn("value", F.when(sd > 0, (F.col("value") - F.avg("value").over(own)) / sd).otherwise(F.col("value")))
    return rows.select(*PAIR, "side", (F.row_number().over(own.orderBy("ts")) - 1).alias("i"), "value")


def _sequences(points: DataFrame, group: list[str]) -> DataFrame:
    """One array of values for each ``group``, in order."""
    return points.groupBy(*group).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "value"))), lambda p: p["value"]).alias("values"))


def _short(points: DataFrame, radius: int | None, kinds: str) -> DataFrame:
    seq = _sequences(points, [*PAIR, "side"])
    side = lambda s: seq.where(F.col("side") == s).select(*PAIR, F.col("values").alias(s[0]))
    both = side("target").join(side("candidate"), PAIR)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            distance = [warp_distance(np.asarray(a, float), np.asarray(b, float), radius) for a, b in zip(pdf["t"], pdf["c"])]
            yield pd.DataFrame({"target": pdf["target"], "candidate": pdf["candidate"], "distance": distance})

    return both.select(*PAIR, "t", "c").mapInPandas(run, f"{kinds}, distance double")


def _long(points: DataFrame, sizes: DataFrame, radius: int | None, kinds: str, tile: int) -> DataFrame:
    """Distances by rounds over the anti-diagonals of tiles; each round is a written table of borders."""
    spark = points.sparkSession
    blocks = cut_lineage(_sequences(points.withColumn("block", F.floor(F.col("i") / tile).cast("int")), [*PAIR, "side", "block"]), "warp-blocks")
    side = lambda s, at, name: blocks.where(F.col("side") == s).select(*PAIR, F.col("block").alias(at), F.col("values").alias(name))
    last = sizes.select(*PAIR, F.floor((F.col("points") - 1) / tile).cast("int").alias("lp"), F.floor((F.col("other_points") - 1) / tile).cast("int").alias("lq"))
    tiles = side("target", "p", "a").join(side("candidate", "q", "b"), PAIR).join(last, PAIR)
    if radius is not None:  # a tile that the band does not touch has no finite cell
        tiles = tiles.where(F.abs(F.col("p") - F.col("q")) * tile - (tile - 1) <= radius)
    rounds = last.agg(F.max(F.col("lp") + F.col("lq"))).first()[0]
    schema = f"{kinds}, p int, q int, above array<double>, left array<double>, distance double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                a, b = np.asarray(r.a, float), np.asarray(r.b, float)
                corner = 0.0 if r.p == 0 and r.q == 0 else np.inf
                edge = lambda given, k: np.concatenate([[corner], np.full(k, np.inf)]) if given is None else np.asarray(given, float)
                below, right = fill(a, b, edge(r.above, len(b)), edge(r.left, len(a)), (r.p * tile, r.q * tile), radius)
                if r.p == r.lp and r.q == r.lq:
                    out.append((r.target, r.candidate, r.p, r.q, None, None, float(np.sqrt(below[-1]))))
                if r.p < r.lp:
                    out.append((r.target, r.candidate, r.p + 1, r.q, below.tolist(), None, None))
                if r.q < r.lq:
                    out.append((r.target, r.candidate, r.p, r.q + 1, None, right.tolist(), None))
            yield pd.DataFrame(out, columns=["target", "candidate", "p", "q", "above", "left", "distance"])

    found, borders = [], spark.createDataFrame([], schema)
    for d in range(rounds + 1):
        known = borders.where("distance is null").groupBy(*PAIR, "p", "q").agg(F.max("above").alias("above"), F.max("left").alias("left"))
        now = tiles.where(F.col("p") + F.col("q") == d).join(known, [*PAIR, "p", "q"], "left")
        borders = cut_lineage(now.select(*PAIR, "p", "q", "lp", "lq", "a", "b", "above", "left").mapInPandas(run, schema), "warp-borders")
        found.append(borders.where("distance is not null").select(*PAIR, "distance"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def dtw_distances(
    series: DataFrame, pairs: DataFrame, radius: int | None = None, standardise: bool = True, minimum: int = MIN_SAMPLES, strict: bool = True,
    longest: int = LONGEST, tile: int = TILE,
) -> DataFrame:
    """(pair, points, other_points, distance, reason): every pair has a distance or the reason why not.

    ``strict`` keeps the times that both series have, else each keeps its own
    times in their common range. ``radius`` bounds how far the two places of a step
    may lie apart; a pair whose lengths differ by more has none.
    """
    if radius is not None and radius < 1:
        raise ValueError("radius must be positive")
    kind = series.schema["series"].dataType.simpleString()
    kinds = f"target {kind}, candidate {kind}"
    points = cut_lineage(_points(series, pairs, strict, standardise), "warp-points")
    count = lambda s: F.count_if(F.col("side") == s)
    sizes = pairs.select(*PAIR).distinct().join(points.groupBy(*PAIR).agg(count("target").alias("points"), count("candidate").alias("other_points")), PAIR, "left")
    sizes = sizes.fillna(0, ["points", "other_points"])
    few = (F.col("points") < minimum) | (F.col("other_points") < minimum)
    reason = F.when(few, "insufficient_data")
    if radius is not None:
        reason = reason.when(F.abs(F.col("points") - F.col("other_points")) > radius, "band_too_narrow")
    sizes = cut_lineage(sizes.withColumn("reason", reason), "warp-sizes")
    good = sizes.where("reason is null").withColumn("long", F.greatest("points", "other_points") > longest)
    chosen = points.join(good.select(*PAIR, "long"), PAIR)
    distances = _short(chosen.where("not long"), radius, kinds)
    if not good.where("long").isEmpty():
        distances = distances.unionByName(_long(chosen.where("long"), good.where("long"), radius, kinds, tile))
    return sizes.join(distances, PAIR, "left").select(*PAIR, "points", "other_points", "distance", "reason")
