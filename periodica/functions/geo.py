"""Distances, boxes and rings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

EARTH_RADIUS_NM = 3440.065  # fixed value


def distance_nm(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in nautical miles."""
    a1, o1, a2, o2 = (F.radians(c) for c in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    return EARTH_RADIUS_NM * 2 * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def valid_coordinate(lat: Column, lon: Column) -> Column:
    return F.coalesce(F.abs(lat).between(0, 90) & F.abs(lon).between(0, 180), F.lit(False))


def region_of(lat: Column, lon: Column, boxes: list[tuple[str, float, float, float, float]]) -> Column:
    """First box (name, south, north, west, east) that holds the point."""
    chain = None
    for name, south, north, west, east in boxes:
        test = lat.between(south, north) & lon.between(west, east)
        chain = F.when(test, name) if chain is None else chain.when(test, name)
    return chain


def in_ring(lat: Column, lon: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd test against a closed ring of (lon, lat) corners.

    The ring is a definition, so its edges unroll into one expression that
    stays inside generated code.
    """
    edges = zip(ring, ring[1:] + ring[:1])
    crossings = []
    for (x1, y1), (x2, y2) in edges:
        if y1 == y2:
            continue
        spans = (F.lit(float(y1)) > lat) != (F.lit(float(y2)) > lat)
        at = F.lit(float(x2 - x1)) * (lat - F.lit(float(y1))) / F.lit(float(y2 - y1)) + F.lit(float(x1))
        crossings.append(F.when(spans & (lon < at), 1).otherwise(0))
    return (reduce(lambda a, b: a + b, crossings) % 2) == 1


def side_of(lat: Column, lon: Column, inner: list[tuple[float, float]], outer: list[tuple[float, float]]) -> Column:
    """TRUE inside the inner ring, FALSE outside the outer one, else NULL."""
    return F.when(in_ring(lat, lon, inner), True).when(~in_ring(lat, lon, outer), False)


def inset_box(south: float, north: float, west: float, east: float, margin: float) -> list[tuple[float, float]]:
    """Ring of a box moved inwards (negative: outwards) by ``margin`` degrees."""
    s, n, w, e = south + margin, north - margin, west + margin, east - margin
    return [(w, s), (e, s), (e, n), (w, n)]
