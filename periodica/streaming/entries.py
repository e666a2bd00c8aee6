"""Area-entry detection on batches of any size, and its replay for late points.

The rule, per vessel and area: a report is inside, outside or in the deadband
between two rings. A step longer than 30 minutes or faster than 60 knots
restarts the memory at the new side. Otherwise two consecutive reports on the
other side move the vessel there, and a move from outside to inside is an
entry at the first of the two.

Only a restart, a repeated side, or the first known side after an unknown
restart settle the state, so it is read off the last such row. All lookups run
over (vessel, time chunk), which keeps a very active vessel out of one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from periodica.functions.geo import distance_nm, side_of
from periodica.operators import chunked
from periodica.session import cut_lineage

MAX_GAP_SECONDS = 1800  # fixed value
MAX_SPEED_KNOTS = 60.0  # fixed value
CONFLICT_NM = 0.1  # fixed value


def drop_conflicts(reports: DataFrame) -> DataFrame:
    """One point per (vessel, instant); instants whose reports lie apart are dropped whole."""
    key = ["mmsi", "observed"]
    known = reports.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    first = known.groupBy(*key).agg(F.min_by(F.struct("lat", "lon", "source"), F.col("source")).alias("_f"))
    far = distance_nm(F.col("_f.lat"), F.col("_f.lon"), F.col("lat"), F.col("lon")) > CONFLICT_NM
    apart = known.join(first, key).groupBy(*key).agg(F.max(far.cast("int")).alias("_apart"), F.first("_f").alias("_f"))
    return apart.where("_apart = 0").select(*key, "_f.*")


def with_segments(points: DataFrame, chunk: str = "day") -> DataFrame:
    """Previous instant of the vessel and whether the step from it is believable."""
    p = points.withColumn("chunk", F.date_trunc(chunk, "observed"))
    p = chunked.previous_row(p, ["mmsi"], "chunk", ["observed"], ["observed", "lat", "lon"], "prev")
    hours = (F.unix_micros("observed") - F.unix_micros("prev.observed")) / 3.6e9
    knots = distance_nm(F.col("prev.lat"), F.col("prev.lon"), F.col("lat"), F.col("lon")) / F.when(hours > 0, hours)
    valid = (hours * 3600 <= MAX_GAP_SECONDS) & (knots <= MAX_SPEED_KNOTS)
    return p.withColumn("valid", F.coalesce(valid, F.lit(False))).withColumn("before", F.col("prev.observed")).drop("prev")


def area_sides(areas: dict[str, tuple[list, list]]) -> Column:
    """Array of (area, inside) for a point; areas are named (inner, outer) rings."""
    lat, lon = F.col("lat"), F.col("lon")
    return F.array(*[F.struct(F.lit(name).alias("area"), side_of(lat, lon, inner, outer).alias("inside")) for name, (inner, outer) in areas.items()])


def detect_entries(points: DataFrame, areas: dict[str, tuple[list, list]], chunk: str = "day") -> DataFrame:
    """Confirmed entries (mmsi, area, entered, before, confirmed, source)."""
    keys, order = ["mmsi", "area"], ["observed"]
    steps = cut_lineage(with_segments(points, chunk), "segments")
    rows = steps.select("mmsi", "observed", "source", "chunk", "valid", "before", F.inline(area_sides(areas)))
    side = F.when(F.col("inside"), "in").when(~F.col("inside"), "out")
    unknown_restart = ~F.col("valid") & F.col("inside").isNull()
    mark = F.when(unknown_restart, "unknown").when(F.col("inside").isNotNull(), "known")
    rows = chunked.scan(rows, keys, "chunk", order, {"p": (chunked.LAST, F.struct("inside")), "last_mark": (chunked.LAST, mark)})
    repeated = F.col("valid") & (F.col("inside") == F.col("p.inside"))
    first_known = F.col("valid") & F.col("inside").isNotNull() & (F.col("last_mark") == "unknown")
    settled = F.when(unknown_restart, "unknown").when(~F.col("valid") | F.coalesce(repeated, F.lit(False)) | F.coalesce(first_known, F.lit(False)), side)
    rows = cut_lineage(rows.withColumn("settled", settled).drop("p", "last_mark"), "settled")
    # The state before the previous row is the last one settled before it.
    own = F.struct("observed", "before", "inside", "settled")
    rows = chunked.scan(rows, keys, "chunk", order, {"p": (chunked.LAST, own), "state": (chunked.LAST, F.col("settled"))})
    hit = F.col("valid") & F.col("inside") & F.col("p.inside") & F.col("p.settled").isNull() & (F.col("state") == "out")
    return rows.where(F.coalesce(hit, F.lit(False))).select(
        "mmsi", "area", F.col("p.observed").alias("entered"), F.col("p.before").alias("before"), F.col("observed").alias("confirmed"), "source")


def replay_bounds(points: DataFrame, late: DataFrame, chunk: str = "day") -> DataFrame:
    """Per vessel with late points: the last restart before the earliest of them.

    A restart forgets everything, so rebuilding from it is exact.
    """
    earliest = late.groupBy("mmsi").agg(F.min("observed").alias("earliest"))
    mine = points.join(earliest.select("mmsi"), "mmsi", "left_semi")
    restarts = with_segments(mine, chunk).where(~F.col("valid")).select("mmsi", "observed")
    return restarts.join(earliest, "mmsi").where(F.col("observed") < F.col("earliest")).groupBy("mmsi").agg(F.max("observed").alias("lower"))


def replay(stored: DataFrame, reports: DataFrame, late: DataFrame, areas: dict[str, tuple[list, list]], chunk: str = "day") -> DataFrame:
    """Events after late points arrived: kept up to the bound, rebuilt after it.

    ``reports`` already holds the late ones. A vessel without a restart before
    its late points is rebuilt whole.
    """
    points = drop_conflicts(reports)
    affected = late.select("mmsi").distinct()
    bound = affected.join(replay_bounds(points, late, chunk), "mmsi", "left")
    redo = points.join(bound, "mmsi").where(F.col("lower").isNull() | (F.col("observed") >= F.col("lower"))).drop("lower")
    kept = stored.join(bound.withColumn("_hit", F.lit(True)), "mmsi", "left").where(
        F.col("_hit").isNull() | F.coalesce(F.col("confirmed") <= F.col("lower"), F.lit(False))).select(*stored.columns)
    return kept.unionByName(detect_entries(redo, areas, chunk))
