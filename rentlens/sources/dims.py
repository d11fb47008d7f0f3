"""Reference dimension data: gazetteers, coordinates, anchors.

FIXED VALUES -- these must equal the reference data for results to match.
They are listed plainly and in their original order; list order is part of the
semantics (first match wins, first station wins ties, first seed row wins).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

# ---------------------------------------------------------------------------
# FIXED VALUES: coordinates used by the card scraper's search frontier (44).
# ---------------------------------------------------------------------------
SCRAPER_LOCALITY_COORDS: list[tuple[str, float, float]] = [
    ("HSR Layout", 12.9081, 77.6476),
    ("Koramangala", 12.9352, 77.6245),
    ("Indiranagar", 12.9784, 77.6408),
    ("Whitefield", 12.9698, 77.7500),
    ("Bellandur", 12.9250, 77.6820),
    ("Marathahalli", 12.9591, 77.6974),
    ("Electronic City", 12.8452, 77.6602),
    ("Jayanagar", 12.9250, 77.5938),
    ("BTM Layout", 12.9166, 77.6101),
    ("Sarjapur", 12.9010, 77.6874),
    ("Sarjapur Road", 12.9010, 77.6874),
    ("JP Nagar", 12.9081, 77.5831),
    ("Bommanahalli", 12.8973, 77.6212),
    ("Hebbal", 13.0358, 77.5970),
    ("Yelahanka", 13.1006, 77.5963),
    ("Rajajinagar", 12.9915, 77.5522),
    ("Malleshwaram", 13.0035, 77.5647),
    ("Basavanagudi", 12.9422, 77.5738),
    ("Banashankari", 12.9256, 77.5468),
    ("Vijayanagar", 12.9719, 77.5307),
    ("Rajarajeshwari Nagar", 12.9210, 77.5205),
    ("Kalyan Nagar", 13.0219, 77.6437),
    ("Kammanahalli", 13.0126, 77.6395),
    ("Frazer Town", 12.9987, 77.6118),
    ("Cooke Town", 13.0068, 77.6209),
    ("RT Nagar", 13.0246, 77.5940),
    ("Nagavara", 13.0430, 77.6220),
    ("Sanjay Nagar", 13.0362, 77.5787),
    ("Ulsoor", 12.9799, 77.6248),
    ("Domlur", 12.9611, 77.6386),
    ("CV Raman Nagar", 13.0117, 77.6600),
    ("Kaggadasapura", 12.9902, 77.6672),
    ("KR Puram", 13.0064, 77.6957),
    ("Kadugodi", 12.9878, 77.7566),
    ("Hoodi", 12.9910, 77.7134),
    ("Doddanekundi", 12.9781, 77.6982),
    ("Ramamurthy Nagar", 13.0154, 77.6787),
    ("Silk Board", 12.9179, 77.6224),
    ("Bommasandra", 12.8071, 77.6987),
    ("Kanakapura Road", 12.8823, 77.5541),
    ("Wilson Garden", 12.9508, 77.5934),
    ("Yeshwanthpur", 13.0290, 77.5401),
    ("Kengeri", 12.9081, 77.4820),
    ("Nagarabhavi", 12.9564, 77.4995),
]

# FIXED VALUE: search centre used when a locality has no coordinates.
DEFAULT_CENTRE = (12.9715987, 77.594562)

# FIXED VALUE: base of the card-site search URL and its host for relative links.
SEARCH_URL_BASE = "https://www.nobroker.in/property/rent/bangalore/"
CARD_SITE_HOST = "https://www.nobroker.in"

# ---------------------------------------------------------------------------
# FIXED VALUES: seeded localities table (32 rows, first normalized key wins).
# ---------------------------------------------------------------------------
SEED_LOCALITY_COORDS: list[tuple[str, float, float]] = [
    ("HSR Layout", 12.9081, 77.6476),
    ("Koramangala", 12.9352, 77.6245),
    ("Indiranagar", 12.9784, 77.6408),
    ("Whitefield", 12.9698, 77.7500),
    ("Bellandur", 12.9250, 77.6820),
    ("Marathahalli", 12.9591, 77.6974),
    ("Electronic City", 12.8452, 77.6602),
    ("E-City", 12.8452, 77.6602),
    ("Jayanagar", 12.9250, 77.5938),
    ("BTM Layout", 12.9166, 77.6101),
    ("BTM", 12.9166, 77.6101),
    ("Sarjapur", 12.9010, 77.6874),
    ("Sarjapur Road", 12.9010, 77.6874),
    ("JP Nagar", 12.9081, 77.5831),
    ("Bommanahalli", 12.8973, 77.6212),
    ("Hebbal", 13.0358, 77.5970),
    ("Yelahanka", 13.1006, 77.5963),
    ("Rajajinagar", 12.9915, 77.5522),
    ("Malleshwaram", 13.0035, 77.5647),
    ("Basavanagudi", 12.9422, 77.5738),
    ("Banashankari", 12.9256, 77.5468),
    ("Kalyan Nagar", 13.0219, 77.6437),
    ("Frazer Town", 12.9987, 77.6118),
    ("Cooke Town", 13.0068, 77.6209),
    ("Ulsoor", 12.9799, 77.6248),
    ("Domlur", 12.9611, 77.6386),
    ("CV Raman Nagar", 13.0117, 77.6600),
    ("Silk Board", 12.9179, 77.6224),
    ("Yeshwanthpur", 13.0290, 77.5401),
    ("Kengeri", 12.9081, 77.4820),
    ("HSR", 12.9081, 77.6476),
    ("Manyata", 13.0447, 77.6207),
]

# FIXED VALUES: metro stations, in list order (first station wins ties).
METRO_STATIONS: list[tuple[str, float, float]] = [
    ("MG Road", 12.9758, 77.6041),
    ("Trinity", 12.9723, 77.6152),
    ("Halasuru", 12.9776, 77.6222),
    ("Indiranagar", 12.9784, 77.6408),
    ("Byappanahalli", 12.9917, 77.6470),
    ("Cubbon Park", 12.9750, 77.5952),
    ("Vidhana Soudha", 12.9793, 77.5906),
    ("Majestic", 12.9758, 77.5729),
    ("Rajajinagar", 12.9915, 77.5522),
    ("Yeshwanthpur", 13.0290, 77.5401),
    ("Nagasandra", 13.0463, 77.5062),
    ("Yelachenahalli", 12.8829, 77.5771),
    ("Konanakunte Cross", 12.8697, 77.5581),
    ("Silk Institute", 12.8452, 77.5892),
    ("Jayanagar", 12.9250, 77.5938),
    ("Jayadeva", 12.9166, 77.5960),
    ("Banashankari", 12.9256, 77.5468),
    ("JP Nagar", 12.9081, 77.5831),
    ("KR Puram", 13.0064, 77.6957),
    ("Whitefield", 12.9855, 77.7368),
    ("Hoodi", 12.9910, 77.7134),
    ("Kadugodi", 12.9878, 77.7566),
]

# FIXED VALUES: named anchors for distance features.
ANCHORS: dict[str, tuple[float, float]] = {
    "manyata": (13.0447, 77.6207),
    "ecity": (12.8452, 77.6602),
    "whitefield": (12.9855, 77.7368),
    "orr_bellandur": (12.9250, 77.6820),
}

# FIXED VALUES: ring-road access points (distance = min over these).
ORR_ANCHORS: list[tuple[float, float]] = [
    (12.9179, 77.6224),
    (12.9591, 77.6974),
    (13.0064, 77.6957),
    (13.0358, 77.5970),
    (13.0290, 77.5401),
    (12.9081, 77.5831),
]

# FIXED VALUES: alias -> canonical locality name for address-text correction.
LOCALITY_ALIASES: dict[str, str] = {
    "sarjapur road": "Sarjapur",
    "hsr": "HSR Layout",
    "btm": "BTM Layout",
    "electronics city": "Electronic City",
    "e-city": "Electronic City",
    "kr pura": "KR Puram",
    "krishnaraja puram": "KR Puram",
    "yeshwantpur": "Yeshwanthpur",
    "rr nagar": "Rajarajeshwari Nagar",
    "cv raman": "CV Raman Nagar",
    "kalyannagar": "Kalyan Nagar",
    "kammannahalli": "Kammanahalli",
}

# FIXED VALUES: names searched (as case-insensitive substrings, in this order)
# to guess a chat post's locality.
KNOWN_LOCALITIES: list[str] = [
    "HSR Layout", "HSR", "BTM Layout", "BTM", "Sarjapur Road", "Sarjapur",
    "JP Nagar", "Kalyan Nagar", "Kalyannagar", "Rajaji Nagar", "Rajajinagar",
    "Electronic City", "E-City", "Ecity",
    "Koramangala", "Indiranagar", "Whitefield", "Bellandur", "Marathahalli",
    "Jayanagar", "Bommanahalli", "Hebbal", "Yelahanka", "Malleshwaram",
    "Basavanagudi", "Banashankari", "Frazer Town", "Cooke Town", "Ulsoor",
    "Domlur", "CV Raman Nagar", "Silk Board", "Yeshwanthpur", "Kengeri",
    "Kadugodi", "Harlur", "Hoodi", "Yemalur", "Yamalur", "Seegehalli",
    "Nagarabhavi", "Battarahalli", "Krishnarajapuram", "Kadubeesanahalli",
    "Munnelkollal", "Hebbagodi", "Seetharampalya", "Attibele", "Chandapura",
    "Begur Road", "Manyata", "Hosahalli",
]


def correction_names() -> list[str]:
    """Names recognised by the address-text locality correction.

    Scraper gazetteer keys plus title-cased aliases, longest first so that a
    longer name wins over its prefix at the same position. Names of equal
    length cannot match at the same position, so their mutual order is free;
    we sort them alphabetically for a stable pattern.
    """
    names = {n for n, _, _ in SCRAPER_LOCALITY_COORDS} | {a.title() for a in LOCALITY_ALIASES}
    return sorted(names, key=lambda s: (-len(s), s))


def correction_canon() -> dict[str, str]:
    """lower(matched name) -> canonical name: alias first, then gazetteer key."""
    canon = {n.lower(): n for n, _, _ in reversed(SCRAPER_LOCALITY_COORDS)}
    canon.update(LOCALITY_ALIASES)
    return canon


LOCALITY_DIM_SCHEMA = T.StructType([
    T.StructField("locality_norm", T.StringType()),
    T.StructField("display_name", T.StringType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("ord", T.IntegerType()),
])


def seed_localities_raw(spark: SparkSession) -> DataFrame:
    rows = [(None, n, lat, lon, i) for i, (n, lat, lon) in enumerate(SEED_LOCALITY_COORDS)]
    return spark.createDataFrame(rows, LOCALITY_DIM_SCHEMA)


def scraper_coords(spark: SparkSession) -> DataFrame:
    rows = [(None, n, lat, lon, i) for i, (n, lat, lon) in enumerate(SCRAPER_LOCALITY_COORDS)]
    return spark.createDataFrame(rows, LOCALITY_DIM_SCHEMA).drop("locality_norm")
