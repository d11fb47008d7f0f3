"""Great-circle distances and nearest-anchor lookups as Column expressions.

Anchor sets are fixed and tiny, so "nearest station" is an array expression
evaluated per row inside whole-stage codegen: no join, no shuffle, and the work
is linear in the number of points.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rentlens.sources.dims import ANCHORS, METRO_STATIONS, ORR_ANCHORS

EARTH_RADIUS_KM = 6371.0


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """M1: haversine distance in km (R = 6371)."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    phi1, phi2 = F.radians(lat1), F.radians(lat2)
    dphi = F.radians(lat2 - lat1)
    dlam = F.radians(lon2 - lon1)
    h = F.pow(F.sin(dphi / 2), 2) + F.cos(phi1) * F.cos(phi2) * F.pow(F.sin(dlam / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(h))


def anchor_distances(lat, lon, digits: int = 3) -> dict[str, Column]:
    """M2: distances to the named anchors, half-even rounded like Python round()."""
    return {f"dist_{name}_km": F.bround(haversine_km(lat, lon, a[0], a[1]), digits)
            for name, a in ANCHORS.items()}


def nearest_orr_km(lat, lon) -> Column:
    """Distance to the closest ring-road anchor."""
    return F.least(*[haversine_km(lat, lon, a, b) for a, b in ORR_ANCHORS])


def nearest_station(lat, lon) -> Column:
    """struct(name, km) of the closest metro station; strict '<' so the
    first station in list order wins a tie."""
    stations = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("name"),
                                  F.lit(a).alias("lat"), F.lit(b).alias("lon"))
                         for i, (n, a, b) in enumerate(METRO_STATIONS)])
    dists = F.transform(stations, lambda s: F.struct(
        haversine_km(lat, lon, s["lat"], s["lon"]).alias("km"), s["ord"].alias("ord"),
        s["name"].alias("name")))
    # array_min over struct(km, ord, name) orders by km, then list position.
    best = F.array_min(dists)
    return F.struct(best["name"].alias("name"), best["km"].alias("km"))
