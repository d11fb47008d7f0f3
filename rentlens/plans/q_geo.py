"""Geo plans over FX-points (customers as coordinates) and card localities."""

from __future__ import annotations

from pyspark.sql import functions as F

from rentlens.operators import geo_ops
from rentlens.plans.common import R6, shape
from rentlens.plans.registry import query, sq
from rentlens.plans.sqlgen import haversine_sql, values_cte
from rentlens.sources import dims
from rentlens.sources.fixtures import fx, fx_cte

# The shared fixture text evaluates in DECIMAL(..., 6) on Spark (n / 3000.0 is
# rounded half-up to 6 places) and in DOUBLE on DuckDB. The oracle states the
# decimal values exactly with integer arithmetic, then converts once to double.
POINTS_CTE = """WITH fx_points AS (SELECT c_custkey AS point_id,
  CAST(12800000 + ((c_custkey % 1000) * 2000 + 3) // 6 AS DOUBLE) / 1000000.0 AS lat,
  CAST(77450000 + c_nationkey * 12500 AS DOUBLE) / 1000000.0 AS lon FROM customer)
"""

ANCHOR_SQL = ", ".join(f"round_even({haversine_sql('lat', 'lon', repr(a), repr(b))}, 3) AS dist_{k}_km"
                       for k, (a, b) in dims.ANCHORS.items())


@query("haversine_anchor", POINTS_CTE + f"""
SELECT point_id, {R6('lat')} AS lat, {R6('lon')} AS lon, {ANCHOR_SQL} FROM fx_points
""")
def haversine_anchor(spark, sf_dir):
    p = geo_ops.with_anchor_distances(fx(spark, sf_dir, "fx_points"))
    return shape(p, ["lat", "lon"])


STATIONS = values_cte("stations", ["station", "slat", "slon", "sord"],
                      [(n, a, b, i) for i, (n, a, b) in enumerate(dims.METRO_STATIONS)])


@query("nearest_station", POINTS_CTE + f""", {STATIONS}
SELECT point_id, arg_min(station, (d, sord)) AS nearest_metro_station, round_even(min(d), 3) AS dist_nearest_metro_km
FROM (SELECT point_id, station, sord, {haversine_sql('lat', 'lon', 'slat', 'slon')} AS d
      FROM fx_points CROSS JOIN stations) x
GROUP BY point_id
""")
def nearest_station(spark, sf_dir):
    return geo_ops.with_nearest_station(fx(spark, sf_dir, "fx_points")).select(
        "point_id", "nearest_metro_station", "dist_nearest_metro_km")


RING_SQL = "least(" + ", ".join(haversine_sql("lat", "lon", repr(a), repr(b)) for a, b in dims.ORR_ANCHORS) + ")"


@query("nearest_ring", POINTS_CTE + f"""
SELECT point_id, round_even({RING_SQL}, 3) AS dist_orr_km FROM fx_points
""")
def nearest_ring(spark, sf_dir):
    return geo_ops.with_nearest_ring(fx(spark, sf_dir, "fx_points")).select("point_id", "dist_orr_km")


COORDS = values_cte("coords", ["locality_query", "clat", "clon"],
                    [(n, a, b) for n, a, b in dims.SCRAPER_LOCALITY_COORDS])
DLAT, DLON = dims.DEFAULT_CENTRE


@query("search_frontier", fx_cte("fx_cards") + f""", {COORDS},
q AS (SELECT DISTINCT locality_query FROM fx_cards),
j AS (SELECT q.locality_query, coalesce(clat, {DLAT!r}) AS lat, coalesce(clon, {DLON!r}) AS lon
      FROM q LEFT JOIN coords c ON c.locality_query = q.locality_query)
SELECT locality_query, lat, lon,
  {sq(dims.SEARCH_URL_BASE)} || replace(url_encode(locality_query), '+', '%20') || '?searchParam=' ||
  to_base64(encode('[{{"lat":' || CAST(lat AS VARCHAR) || ',"lon":' || CAST(lon AS VARCHAR) || ',"showMap":false}}]'))
  || '&radius=2.0&city=bangalore' AS search_url
FROM j
""")
def search_frontier(spark, sf_dir):
    locs = fx(spark, sf_dir, "fx_cards").select("locality_query").distinct()
    return geo_ops.search_frontier(locs, spark.createDataFrame(
        [(n, a, b) for n, a, b in dims.SCRAPER_LOCALITY_COORDS], "display_name string, lat double, lon double"))
