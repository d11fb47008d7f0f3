"""Geo operators over point tables: anchor distances (M1/M2), nearest metro
station (J6), nearest ring-road anchor (J7) and the search frontier (S8).

Anchor sets are fixed and tiny, so every lookup is a per-row array
expression -- no join, no shuffle, no pair generation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rentlens.functions import geo
from rentlens.sources import dims


def with_anchor_distances(points: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    d = geo.anchor_distances(F.col(lat), F.col(lon))
    return points.select("*", *[c.alias(n) for n, c in d.items()])


def with_nearest_station(points: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    ns = geo.nearest_station(F.col(lat), F.col(lon))
    return points.select("*", ns["name"].alias("nearest_metro_station"),
                         F.bround(ns["km"], 3).alias("dist_nearest_metro_km"))


def with_nearest_ring(points: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return points.select("*", F.bround(geo.nearest_orr_km(F.col(lat), F.col(lon)), 3).alias("dist_orr_km"))


def search_frontier(localities: DataFrame, coords: DataFrame, radius_km: float = 2.0) -> DataFrame:
    """One search URL per locality: coordinates (default centre when
    unknown) as base64 of a compact JSON array, percent-encoded name, radius."""
    c = coords.select(F.col("display_name").alias("locality_query"), F.col("lat").alias("_lat"),
                      F.col("lon").alias("_lon"))
    j = localities.join(c, "locality_query", "left")
    lat = F.coalesce(F.col("_lat"), F.lit(dims.DEFAULT_CENTRE[0]))
    lon = F.coalesce(F.col("_lon"), F.lit(dims.DEFAULT_CENTRE[1]))
    payload = F.concat(F.lit('[{"lat":'), lat.cast("string"), F.lit(',"lon":'), lon.cast("string"),
                       F.lit(',"showMap":false}]'))
    name = F.replace(F.url_encode(F.col("locality_query")), F.lit("+"), F.lit("%20"))
    url = F.concat(F.lit(dims.SEARCH_URL_BASE), name, F.lit("?searchParam="),
                   F.base64(F.encode(payload, "UTF-8")), F.lit(f"&radius={radius_km!r}&city=bangalore"))
    return j.select("locality_query", lat.alias("lat"), lon.alias("lon"), url.alias("search_url"))
