"""Structured attribute extraction from listing text (regex extractor), the
normaliser for JSON answers returned by a language-model extractor, and the
token-cost arithmetic. All native Column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rentlens.functions import text as tx
from rentlens.functions.text import cf, folded, has, json_string_array, on_folded

# ---------------------------------------------------------------------------
# FIXED VALUES: extractor identity, field patterns and tag vocabulary.
# Pattern order is semantic: the first hit wins.
# ---------------------------------------------------------------------------
REGEX_EXTRACTOR = "regex-v1"
REGEX_EXTRACTOR_VERSION = "1.0"

TENANT_RULES: list[tuple[str, str]] = [
    (r"\b(bachelor(?:s)?\s*(?:only)?\s*[-:\s]*male|male\s*bachelor(?:s)?)\b", "bachelors_male"),
    (r"\b(bachelor(?:s)?\s*(?:only)?\s*[-:\s]*female|female\s*bachelor(?:s)?|working\s+women)\b", "bachelors_female"),
    (r"\b(family|families)\s*(?:only|preferred)?\b", "family"),
    (r"\bbachelor(?:s)?\b", "bachelors"),
    (r"\b(any(?:one)?|all\s+tenants|no\s+restriction)\b", "any"),
    (r"preferred\s+tenants?[:\s]*all\b", "any"),
]
VEG_RULES = [
    r"\b(veg(?:etarian)?\s*only|only\s*veg(?:etarian)?|pure\s*veg)\b",
    r"\bno\s+non[-\s]?veg\b",
    r"\bveg\s+tenants?\s+only\b",
]
NONVEG_OK_RULES = [
    r"\bnon[-\s]?veg(?:etarian)?\s*(?:allowed|ok|okay|accepted)\b",
    r"\bany\s+food\b",
]
OWNER_RULES = [
    r"\b(owner\s+direct|direct\s+owner|no\s+broker|by\s+owner)\b",
    r"\bposted\s+by\s+owner\b",
    r"\bget\s+owner\s+details\b",
]
BROKER_RULES = [
    r"\b(broker(?:age)?|agent\s+fee|agent\s+details)\b",
    r"\bposted\s+by\s+(?:broker|agent)\b",
]
NEGOTIABLE_RULES = [
    r"\bnegotiable\b",
    r"\bprice\s+can\s+be\s+discussed\b",
    r"\brent\s+is\s+negotiable\b",
]
LOCK_IN_RE = r"\b(?:lock[-\s]?in|minimum\s+stay)[:\s]*(\d+)\s*(month|year|yr|mo)s?\b"
AMENITY_RULES: list[tuple[str, str]] = [
    ("lift", r"\blift|elevator\b"),
    ("parking", r"\bparking|car\s*park\b"),
    ("gym", r"\bgym|fitness\s+center\b"),
    ("pool", r"\bswimming\s*pool|pool\b"),
    ("security", r"\b24[/\s]?7\s*security|security\b"),
    ("power_backup", r"\bpower\s*backup|generator|dg\s*backup\b"),
    ("water_supply", r"\b(24[/\s]?7\s+water|water\s+plant|borewell|corp(?:oration)?\s+water)\b"),
    ("clubhouse", r"\bclub[- ]?house\b"),
    ("garden", r"\bgarden|lawn\b"),
    ("kids_play", r"\bkids?\s+play|children['\s]s\s+play|play\s+area\b"),
    ("wifi", r"\bwi[-\s]?fi\b"),
    ("ac", r"\b(?:air[-\s]?condition(?:ing)?|\bac\s+included|split\s+ac)\b"),
    ("washing_machine", r"\bwashing\s+machine\b"),
    ("fridge", r"\bfridge|refrigerator\b"),
    ("geyser", r"\bgeyser|water\s+heater\b"),
    ("cctv", r"\bcctv|surveillance\b"),
]
AMENITY_TAGS = [t for t, _ in AMENITY_RULES]
TENANT_VALUES = ["family", "bachelors", "bachelors_male", "bachelors_female", "any"]

# FIXED VALUES: language-model prices (USD per 1M tokens) and extractor identity.
LLM_EXTRACTOR = "gemini-flash"
LLM_EXTRACTOR_VERSION = "3.5-flash"
INPUT_COST_PER_1M = 0.30
OUTPUT_COST_PER_1M = 2.50

# FIXED VALUE: the extraction prompt; {text} is replaced by the listing text.
PROMPT_TEMPLATE = """You are extracting structured information from a Bengaluru rental listing.

Return a single JSON object with EXACTLY these keys. Use null when the listing does not clearly state a value — do NOT guess.

{
  "tenant_pref":   one of ["family", "bachelors", "bachelors_male", "bachelors_female", "any"] or null,
  "veg_only":      true if the listing says vegetarian tenants only, false if it explicitly allows non-veg, null if unclear,
  "is_owner":      true if posted directly by the owner, false if posted by a broker/agent, null if unclear,
  "negotiable":    true if the rent is stated to be negotiable, null otherwise,
  "lock_in_months": integer number of months if a lock-in period is mentioned, null otherwise,
  "amenities":     array of short lowercase tags from this fixed set only:
                   ["lift","parking","gym","pool","security","power_backup","water_supply","clubhouse","garden","kids_play","wifi","ac","washing_machine","fridge","geyser","cctv"]
                   (empty array if none mentioned)
}

Rules:
- Output ONLY the JSON object, no prose, no markdown fences.
- Do not invent facts. Prefer null over guessing.
- amenities MUST be a subset of the fixed tag set above.

LISTING TEXT:
```
{text}
```
"""

# ---------------------------------------------------------------------------


# Literals (of a folded text) without which a pattern above cannot match, in the order of the patterns;
# a tuple in a tuple: all of them.
TENANT_LITERALS = [("bachelor",), ("bachelor", ("working", "women")), ("famil",), ("bachelor",),
                   ("any", ("all", "tenants"), "restriction"), (("preferred", "tenant"),)]
VEG_LITERALS = [("veg",), ("veg",), ("veg",)]
NONVEG_OK_LITERALS = [(("non", "veg"),), (("any", "food"),)]
OWNER_LITERALS = [("owner", "broker"), (("posted", "owner"),), (("owner", "details"),)]
BROKER_LITERALS = [("broker", "agent"), ("posted",)]
NEGOTIABLE_LITERALS = [("negotiable",), (("price", "discussed"),), ("negotiable",)]
LOCK_IN_LITERALS = ("lock", ("minimum", "stay"))
AMENITY_LITERALS = {
    "lift": ("lift", "elevator"), "parking": ("park",), "gym": ("gym", "fitness"), "pool": ("pool",), "security": ("security",),
    "power_backup": ("backup", "generator"), "water_supply": ("water", "borewell"), "clubhouse": ("club",),
    "garden": ("garden", "lawn"), "kids_play": ("play",), "wifi": (("wi", "fi"),), "ac": (("air", "condition"), ("ac", "included"), "split"),
    "washing_machine": ("washing",), "fridge": ("fridge", "refrigerator"), "geyser": ("geyser", "heater"), "cctv": ("cctv", "surveillance"),
}


def _hit(t: Column, pattern: str, literals: tuple) -> Column:
    return has(t, *literals) & t.rlike(cf(pattern))


def _any(t: Column, patterns: list[str], literals: list[tuple]) -> Column:
    cond = None
    for p, need in zip(patterns, literals, strict=True):
        c = _hit(t, p, need)
        cond = c if cond is None else (cond | c)
    return cond


@on_folded
def tenant_pref(t: Column) -> Column:
    out = F.lit(None).cast("string")
    for (p, label), need in reversed(list(zip(TENANT_RULES, TENANT_LITERALS, strict=True))):
        out = F.when(_hit(t, p, need), F.lit(label)).otherwise(out)
    return out


@on_folded
def veg_only(t: Column) -> Column:
    return F.when(_any(t, VEG_RULES, VEG_LITERALS), F.lit(1)).when(_any(t, NONVEG_OK_RULES, NONVEG_OK_LITERALS), F.lit(0))


@on_folded
def is_owner(t: Column) -> Column:
    o, b = _any(t, OWNER_RULES, OWNER_LITERALS), _any(t, BROKER_RULES, BROKER_LITERALS)
    return F.when(o & ~b, F.lit(1)).when(b & ~o, F.lit(0))


@on_folded
def negotiable(t: Column) -> Column:
    return F.when(_any(t, NEGOTIABLE_RULES, NEGOTIABLE_LITERALS), F.lit(1))


@on_folded
def lock_in_months(t: Column) -> Column:
    p = cf(LOCK_IN_RE)
    hit = F.when(has(t, *LOCK_IN_LITERALS), F.regexp_extract(t, p, 0))  # one scan; the groups are read from the hit
    n = F.nullif(F.regexp_extract(hit, p, 1), F.lit("")).try_cast("int")
    return F.when(F.regexp_extract(hit, p, 2).startswith("y"), n * 12).otherwise(n)


@on_folded
def amenities(t: Column) -> Column:
    """Sorted array of the tags whose pattern matches."""
    tags = F.array(*[F.when(_hit(t, p, AMENITY_LITERALS[tag]), F.lit(tag)) for tag, p in AMENITY_RULES])
    return F.array_sort(F.array_compact(tags))


def with_record(df: DataFrame, text: str) -> DataFrame:
    """The frame with the six extracted fields and the number of amenities; the text is folded once, in a
    projection of its own, and the amenities are looked for once."""
    d = df.withColumn("_folded", folded(F.coalesce(F.col(text), F.lit(""))))
    d = d.withColumn("_tags", amenities.of(F.col("_folded")))
    return d.select(*df.columns, *[c.alias(k) for k, c in _record(F.col("_folded"), F.col("_tags")).items()])


def _record(t: Column, am: Column) -> dict[str, Column]:
    return {
        "tenant_pref": tenant_pref.of(t),
        "veg_only": veg_only.of(t),
        "is_owner": is_owner.of(t),
        "negotiable": negotiable.of(t),
        "lock_in_months": lock_in_months.of(t),
        "amenities_json": json_string_array(am),
        "n_amenities": F.size(am),
    }


# Language-model answer normaliser ------------------------------------

_ANSWER_SCHEMA = T.StructType([
    T.StructField("tenant_pref", T.StringType()),
    T.StructField("veg_only", T.BooleanType()),
    T.StructField("is_owner", T.BooleanType()),
    T.StructField("negotiable", T.BooleanType()),
    T.StructField("amenities", T.StringType()),
])
# Every field as text: any JSON value fits, so _corrupt is set only for
# text that is not a JSON object at all.
_VALIDITY_SCHEMA = T.StructType([T.StructField("tenant_pref", T.StringType()),
                                 T.StructField("_corrupt", T.StringType())])


def json_span(raw: Column) -> Column:
    """Widest {...} span of the answer, else the stripped answer."""
    span = F.regexp_extract(raw, r"\{[\s\S]*\}", 0)
    return F.when(span != "", span).otherwise(tx.strip(raw))


def normalize_llm_answer(raw: Column) -> Column:
    """Struct of normalised fields plus ``ok`` (False = unparseable answer).

    Non-boolean flags become NULL (BooleanType rejects strings). The lock-in
    value converts as Python ``int`` does: numbers are truncated, true is 1, a
    quoted whole number counts, other text does not. Amenities must be a JSON
    array, are intersected with the tag vocabulary, de-duplicated and sorted.
    """
    span = json_span(raw)
    v = F.from_json(span, _VALIDITY_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    obj_ok = span.rlike(r"^\s*\{") & v["_corrupt"].isNull()
    j = F.from_json(span, _ANSWER_SCHEMA)
    tenant = F.when(j["tenant_pref"].isin(*TENANT_VALUES), j["tenant_pref"])
    value = F.try_variant_get(F.try_parse_json(span), "$.lock_in_months", "variant")
    kind = F.schema_of_variant(value)
    as_text = tx.strip(F.try_variant_get(value, "$", "string"))
    lock = (F.when(kind == "STRING", F.when(as_text.rlike(r"^[+-]?[0-9]+$"), as_text.try_cast("int")))
            .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("int"))
            .otherwise(F.try_variant_get(value, "$", "double").try_cast("int")))
    arr = F.when(F.trim(j["amenities"]).startswith("["), F.from_json(j["amenities"], "array<string>"))
    am = F.array_sort(F.array_distinct(F.array_intersect(F.coalesce(arr, F.array().cast("array<string>")),
                                                         F.array(*[F.lit(a) for a in AMENITY_TAGS]))))
    return F.struct(
        obj_ok.alias("ok"),
        tenant.alias("tenant_pref"),
        j["veg_only"].cast("int").alias("veg_only"),
        j["is_owner"].cast("int").alias("is_owner"),
        j["negotiable"].cast("int").alias("negotiable"),
        lock.alias("lock_in_months"),
        json_string_array(am).alias("amenities_json"),
    )


def token_cost(prompt_tokens: Column, output_tokens: Column) -> Column:
    """USD cost of one call; missing usage counts as zero tokens."""
    i = F.coalesce(prompt_tokens, F.lit(0)).cast("double")
    o = F.coalesce(output_tokens, F.lit(0)).cast("double")
    return (i / F.lit(1e6)) * F.lit(INPUT_COST_PER_1M) + (o / F.lit(1e6)) * F.lit(OUTPUT_COST_PER_1M)


def prompt_for(text: Column) -> Column:
    """The prompt with the listing text filled in."""
    head, tail = PROMPT_TEMPLATE.split("{text}")
    return F.concat(F.lit(head), F.coalesce(text, F.lit("")), F.lit(tail))
