"""SQL text builders for the DuckDB oracle side (independent of Spark)."""

from __future__ import annotations

from rentlens.plans.registry import sq
from rentlens.sources import dims


def values_cte(name: str, cols: list[str], rows: list[tuple]) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return sq(v)
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        return str(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"{name}({', '.join(cols)}) AS (VALUES {body})"


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (f"(2 * 6371.0 * asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * "
            f"cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))")


def localities_ctes() -> str:
    """CTEs seed, stations and localities (the seeded dimension with distances)."""
    seed = values_cte("seed", ["display_name", "lat", "lon", "ord"],
                      [(n, a, b, i) for i, (n, a, b) in enumerate(dims.SEED_LOCALITY_COORDS)])
    st = values_cte("stations", ["station", "slat", "slon", "sord"],
                    [(n, a, b, i) for i, (n, a, b) in enumerate(dims.METRO_STATIONS)])
    orr = " , ".join(haversine_sql("lat", "lon", repr(a), repr(b)) for a, b in dims.ORR_ANCHORS)
    an = {k: haversine_sql("lat", "lon", repr(a), repr(b)) for k, (a, b) in dims.ANCHORS.items()}
    norm = ("replace(trim(regexp_replace(regexp_replace(lower(display_name), '[^a-z0-9\\s]', ' ', 'g'), "
            "'\\s+', ' ', 'g')), ' ', '_')")
    return f"""{seed},
{st},
seedn AS (SELECT {norm} AS locality_norm, * FROM seed
          QUALIFY row_number() OVER (PARTITION BY {norm} ORDER BY ord) = 1),
near AS (SELECT locality_norm, arg_min(station, (d, sord)) AS nearest_metro_station, min(d) AS dmin
         FROM (SELECT locality_norm, station, sord, {haversine_sql('lat', 'lon', 'slat', 'slon')} AS d
               FROM seedn CROSS JOIN stations) x GROUP BY locality_norm),
localities AS (SELECT s.locality_norm, display_name, lat, lon, round_even(dmin, 3) AS dist_nearest_metro_km,
       nearest_metro_station, round_even(least({orr}), 3) AS dist_orr_km,
       round_even({an['manyata']}, 3) AS dist_manyata_km, round_even({an['ecity']}, 3) AS dist_ecity_km,
       round_even({an['whitefield']}, 3) AS dist_whitefield_km,
       round_even({an['orr_bellandur']}, 3) AS dist_orr_bellandur_km
  FROM seedn s JOIN near n ON s.locality_norm = n.locality_norm)"""
