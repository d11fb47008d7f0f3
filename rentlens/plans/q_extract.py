"""Text extraction plans: card fields (T7-T17), message parsing and filters
(T10, T12, T23, F1, F2), locality correction (T13), regex extractor (T18, G16),
LLM answer normaliser (S9, T19), token cost (T20, G14), prompt batch (K12, D7),
enrichment update-fill (K8) and its coverage report (G6)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rentlens.functions import extract as ex, text as tx
from rentlens.operators import enrich
from rentlens.plans.common import R6, r6, shape
from rentlens.plans import q_ingest  # noqa: F401  (registers listing_upsert)
from rentlens.plans.registry import ORACLES, query, sq
from rentlens.session import scratch_path
from rentlens.sources import dims, jsonl, store
from rentlens.sources.fixtures import FX_SQL, fx, fx_cte


# --- RE2 forms of the fixed patterns (oracle side) ---------------------------

def re2(p: str, boundary: bool = False, icase: bool = True) -> str:
    return sq(("(?i)" if icase else "") + tx.translate_pattern(p, digit=r"\p{Nd}", boundary=boundary))


FLOOR_RE2 = sq(r"(?:^|[^0-9])([0-9]{1,2})\s*/\s*([0-9]{1,2})(?:[^0-9]|$)")


def nullif_extract(col: str, pat: str, g: int = 1) -> str:
    return f"NULLIF(regexp_extract({col}, {pat}, {g}), '')"


def card_fields_sql(t: str) -> str:
    tc = f"replace({t}, ',', '')"
    inr = (f"CASE WHEN regexp_matches({tc}, {re2(tx.INR_LAKH_RE)}) THEN TRY_CAST({nullif_extract(tc, re2(tx.INR_LAKH_RE))} AS DOUBLE) * 100000 "
           f"WHEN regexp_matches({tc}, {re2(tx.INR_THOUSAND_RE)}) THEN TRY_CAST({nullif_extract(tc, re2(tx.INR_THOUSAND_RE))} AS DOUBLE) * 1000 "
           f"WHEN regexp_matches({tc}, {re2(tx.INR_PLAIN_RE)}) THEN TRY_CAST({nullif_extract(tc, re2(tx.INR_PLAIN_RE))} AS DOUBLE) "
           f"ELSE TRY_CAST({nullif_extract(tc, re2(tx.INR_NEAR_RENT_RE))} AS DOUBLE) END")
    furn = "CASE " + " ".join(
        "WHEN " + " OR ".join(f"contains(lower({t}), {sq(n)})" for n in needles) + f" THEN {sq(label)}"
        for needles, label in tx.FURNISHING_RULES) + " END"
    head = f"left({t}, {tx.FIRST_CHARS_PROPERTY_TYPE})"
    ptype = "CASE " + " ".join(f"WHEN regexp_matches({head}, {re2(p)}) THEN {sq(v)}"
                               for p, v in tx.PROPERTY_TYPE_RULES) + " END"
    dep = f"TRY_CAST(replace({nullif_extract(t, re2(tx.DEPOSIT_RE))}, ',', '') AS DOUBLE)"
    fa = f"TRY_CAST({nullif_extract(t, FLOOR_RE2, 1)} AS INTEGER)"
    fb = f"TRY_CAST({nullif_extract(t, FLOOR_RE2, 2)} AS INTEGER)"
    fok = f"({fa} >= 0 AND {fa} <= {fb} AND {fb} <= 60)"
    lo = f"TRY_CAST({nullif_extract(t, re2(tx.AGE_RE), 1)} AS DOUBLE)"
    hi = f"coalesce(TRY_CAST({nullif_extract(t, re2(tx.AGE_RE), 2)} AS DOUBLE), {lo})"
    mid = f"(({lo}) + ({hi})) / 2"
    return {
        "bhk": f"TRY_CAST({nullif_extract(t, re2(tx.BHK_RE))} AS DOUBLE)",
        "area_sqft": f"TRY_CAST(replace({nullif_extract(t, re2(tx.AREA_RE))}, ',', '') AS DOUBLE)",
        "rent_monthly": inr,
        "furnishing": furn,
        "property_type": ptype,
        "deposit": f"CASE WHEN {dep} BETWEEN 1000 AND 5000000 THEN {dep} END",
        "floor_num": f"CAST(CASE WHEN {fok} THEN {fa} END AS DOUBLE)",
        "total_floors": f"CAST(CASE WHEN {fok} THEN {fb} END AS DOUBLE)",
        "age_years": f"CASE WHEN {mid} BETWEEN 0 AND 100 THEN {mid} END",
    }


CARD_FIELDS = ["bhk", "area_sqft", "rent_monthly", "furnishing", "property_type", "deposit", "floor", "age_years"]


@query("parse_card_fields", fx_cte("fx_cards") + "SELECT listing_id, "
       + ", ".join(f"{v} AS {k}" for k, v in card_fields_sql("raw_text").items()) + " FROM fx_cards")
def parse_card_fields(spark, sf_dir):
    c = fx(spark, sf_dir, "fx_cards").select("listing_id", "raw_text")
    return tx.with_card_fields(c, "raw_text", CARD_FIELDS).select(
        "listing_id", "bhk", "area_sqft", "rent_monthly", "furnishing",
        "property_type", "deposit", "floor_num", "total_floors", "age_years")


# --- chat messages --------------------------------------------------------

def _scaled_sql(n: str, s: str) -> str:
    v = f"TRY_CAST(replace({n}, ',', '') AS DOUBLE)"
    return f"(CASE WHEN lower({s}) = 'k' THEN {v} * 1000 WHEN lower({s}) = 'l' THEN {v} * 100000 ELSE {v} END)"


def message_rent_sql(t: str) -> str:
    p1, p2 = re2(tx.MSG_RENT_RE), re2(tx.MSG_INR_ANY_RE)
    first = (f"CASE WHEN regexp_matches({t}, {p1}) THEN "
             f"{_scaled_sql(f'regexp_extract({t}, {p1}, 1)', f'regexp_extract({t}, {p1}, 2)')} END")
    anys = (f"list_filter(list_transform(list_zip(regexp_extract_all({t}, {p2}, 1), regexp_extract_all({t}, {p2}, 2)), "
            f"lambda z: {_scaled_sql('z[1]', 'z[2]')}), lambda v: v BETWEEN 5000 AND 500000)[1]")
    return f"coalesce(CASE WHEN ({first}) BETWEEN 3000 AND 500000 THEN ({first}) END, {anys})"


def listing_sql(t: str) -> str:
    return (f"(length(coalesce({t}, '')) >= 60 AND NOT regexp_matches(coalesce({t}, ''), {re2(tx.SALE_MARKER_RE, True)}) "
            f"AND regexp_matches(coalesce({t}, ''), {re2(tx.RENT_MARKER_RE, True)}))")


def share_sql(t: str) -> str:
    return f"regexp_matches(coalesce({t}, ''), {re2(tx.ROOM_SHARE_RE, True)})"


def guess_sql(t: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({t}), {sq(n.lower())}) THEN {sq(n)}"
                              for n in dims.KNOWN_LOCALITIES) + " END"


STRIP_TEXT_SQL = f"regexp_replace(text, '^{tx.WS}+|{tx.WS}+$', '', 'g')"
MSG_CTE = fx_cte("fx_messages") + ", msgs AS (SELECT msg_id, group_name, " + STRIP_TEXT_SQL + " AS text FROM fx_messages)\n"


def messages(spark, sf_dir):
    """Chat posts with the text stripped, as the chat reader does."""
    m = fx(spark, sf_dir, "fx_messages")
    return m.select("msg_id", "group_name", tx.strip(F.col("text")).alias("text"))


@query("parse_message_rent", MSG_CTE + f"""
SELECT msg_id, {R6(message_rent_sql('text'))} AS rent_monthly, {card_fields_sql('text')['bhk']} AS bhk,
       {card_fields_sql('text')['area_sqft']} AS area_sqft FROM msgs
""")
def parse_message_rent(spark, sf_dir):
    m = messages(spark, sf_dir)
    t = F.col("text")
    return m.select("msg_id", r6(tx.parse_message_rent(t)).alias("rent_monthly"), tx.parse_bhk(t).alias("bhk"),
                    tx.parse_area(t).alias("area_sqft"))


@query("listing_filter", MSG_CTE + f"SELECT msg_id FROM msgs WHERE {listing_sql('text')}")
def listing_filter(spark, sf_dir):
    return messages(spark, sf_dir).where(tx.looks_like_listing(F.col("text"))).select("msg_id")


@query("room_share", MSG_CTE + f"""
SELECT msg_id, CAST({share_sql('text')} AS INTEGER) AS is_share FROM msgs WHERE {listing_sql('text')}
""")
def room_share(spark, sf_dir):
    m = messages(spark, sf_dir).where(tx.looks_like_listing(F.col("text")))
    return m.select("msg_id", tx.is_room_share(F.col("text")).cast("int").alias("is_share"))


@query("source_tag", MSG_CTE + f"""
SELECT msg_id, CASE WHEN {share_sql('text')} THEN 'telegram_share:' ELSE 'telegram:' END || group_name AS source,
       split_part(CASE WHEN {share_sql('text')} THEN 'telegram_share:' ELSE 'telegram:' END || group_name, ':', 1) AS source_bucket
FROM msgs WHERE {listing_sql('text')}
""")
def source_tag(spark, sf_dir):
    m = messages(spark, sf_dir).where(tx.looks_like_listing(F.col("text")))
    src = tx.source_tag(F.col("group_name"), tx.is_room_share(F.col("text")))
    return m.select("msg_id", src.alias("source"), tx.source_bucket(src).alias("source_bucket"))


@query("guess_locality", MSG_CTE + f"SELECT msg_id, {guess_sql('text')} AS locality FROM msgs")
def guess_locality(spark, sf_dir):
    return messages(spark, sf_dir).select("msg_id", tx.guess_locality(F.col("text")).alias("locality"))


# --- T13 locality correction on cards ---------------------------------------

def canon_case_sql(h: str) -> str:
    return "CASE lower(" + h + ") " + " ".join(f"WHEN {sq(k)} THEN {sq(v)}"
                                               for k, v in dims.correction_canon().items()) + " END"


CORRECT_CTE = f"""hits AS (SELECT listing_id, locality_query AS cur, raw_text,
  list_filter(list_transform(regexp_extract_all(left(raw_text, {tx.FIRST_CHARS_LOCALITY}), {sq('(?i)' + tx.locality_pattern())}, 1),
              lambda h: {canon_case_sql('h')}), lambda h: h IS NOT NULL) AS ch FROM fx_cards),
corr AS (SELECT *, cur IS NOT NULL AND len(list_filter(ch, lambda h: lower(h) = lower(cur))) > 0 AS keep FROM hits),
fixed AS (SELECT listing_id, raw_text,
  CASE WHEN len(ch) = 0 THEN 'outside_coverage' WHEN keep THEN cur ELSE ch[1] END AS locality,
  CASE WHEN len(ch) = 0 THEN coalesce(cur, '') <> 'outside_coverage' WHEN keep THEN false
       ELSE ch[1] <> coalesce(cur, '') END AS changed FROM corr)"""
NORM_LOC_SQL = ("CASE WHEN locality IS NULL OR locality = '' THEN NULL ELSE replace(trim(regexp_replace("
                f"regexp_replace(lower(locality), '[^a-z0-9{tx.WS_CHARS}]', ' ', 'g'), '{tx.WS}+', ' ', 'g')), ' ', '_') END")


@query("correct_locality", fx_cte("fx_cards") + ", " + CORRECT_CTE + f"""
SELECT listing_id, locality, CAST(changed AS INTEGER) AS changed, {NORM_LOC_SQL} AS locality_norm FROM fixed
""")
def correct_locality(spark, sf_dir):
    c = fx(spark, sf_dir, "fx_cards")
    staged = c.select("listing_id", tx.correct_locality(F.col("raw_text"), F.col("locality_query")).alias("r"))
    return staged.select("listing_id", F.col("r.locality").alias("locality"),
                         F.col("r.changed").cast("int").alias("changed"),
                         tx.normalize_locality(F.col("r.locality")).alias("locality_norm"))


# --- T18 regex extractor ------------------------------------------------------

def extract_sql(t: str) -> dict[str, str]:
    def any_(ps):
        return "(" + " OR ".join(f"regexp_matches({t}, {re2(p, True)})" for p in ps) + ")"
    tenant = "CASE " + " ".join(f"WHEN regexp_matches({t}, {re2(p, True)}) THEN {sq(v)}" for p, v in ex.TENANT_RULES) + " END"
    lock_p = re2(ex.LOCK_IN_RE, True)
    n = f"TRY_CAST({nullif_extract(t, lock_p, 1)} AS INTEGER)"
    unit = f"lower(regexp_extract({t}, {lock_p}, 2))"
    tags = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({t}, {re2(p, True)}) THEN {sq(tag)} END"
                                      for tag, p in ex.AMENITY_RULES) + "], lambda x: x IS NOT NULL)"
    am = f"list_sort({tags})"
    return {
        "tenant_pref": tenant,
        "veg_only": f"CAST(CASE WHEN {any_(ex.VEG_RULES)} THEN 1 WHEN {any_(ex.NONVEG_OK_RULES)} THEN 0 END AS DOUBLE)",
        "is_owner": (f"CAST(CASE WHEN {any_(ex.OWNER_RULES)} AND NOT {any_(ex.BROKER_RULES)} THEN 1 "
                     f"WHEN {any_(ex.BROKER_RULES)} AND NOT {any_(ex.OWNER_RULES)} THEN 0 END AS DOUBLE)"),
        "negotiable": f"CAST(CASE WHEN {any_(ex.NEGOTIABLE_RULES)} THEN 1 END AS DOUBLE)",
        "lock_in_months": f"CAST(CASE WHEN starts_with({unit}, 'y') THEN {n} * 12 ELSE {n} END AS DOUBLE)",
        "amenities_json": f"'[' || array_to_string(list_transform({am}, lambda x: '\"' || x || '\"'), ', ') || ']'",
        "n_amenities": f"CAST(len({am}) AS INTEGER)",
    }


EXTRACT_INT_COLS = ["veg_only", "is_owner", "negotiable", "lock_in_months"]


@query("regex_extract_record", MSG_CTE + "SELECT msg_id AS listing_id, "
       + ", ".join(f"{v} AS {k}" for k, v in extract_sql("text").items()) + " FROM msgs")
def regex_extract_record(spark, sf_dir):
    m = messages(spark, sf_dir)
    d = ex.with_record(m.select(F.col("msg_id").alias("listing_id"), "text"), "text").drop("text")
    return shape(d, as_double=EXTRACT_INT_COLS)


# --- T19 / T20 / K12 ----------------------------------------------------------

TENANTS_SQL = ", ".join(sq(v) for v in ex.TENANT_VALUES)
TAGS_SQL = "[" + ", ".join(sq(v) for v in ex.AMENITY_TAGS) + "]"
LLM_CTE = fx_cte("fx_responses") + r""",
sp AS (SELECT *, CASE WHEN regexp_extract(response, '\{[\s\S]*\}', 0) <> '' THEN regexp_extract(response, '\{[\s\S]*\}', 0)
                      ELSE trim(response, chr(10) || chr(9) || ' ') END AS js FROM fx_responses),
ok AS (SELECT * FROM sp WHERE json_valid(js) AND json_type(js) = 'OBJECT')"""


def bool_sql(k: str) -> str:
    return (f"CAST(CASE json_type(js, '$.{k}') WHEN 'BOOLEAN' THEN CASE WHEN CAST(json_extract(js, '$.{k}') AS BOOLEAN) "
            f"THEN 1 ELSE 0 END END AS DOUBLE)")


LLM_SELECT = f"""SELECT listing_id,
  CASE WHEN json_extract_string(js, '$.tenant_pref') IN ({TENANTS_SQL}) AND json_type(js, '$.tenant_pref') = 'VARCHAR'
       THEN json_extract_string(js, '$.tenant_pref') END AS tenant_pref,
  {bool_sql('veg_only')} AS veg_only, {bool_sql('is_owner')} AS is_owner, {bool_sql('negotiable')} AS negotiable,
  CAST(CASE WHEN json_type(js, '$.lock_in_months') = 'BOOLEAN' THEN CAST(CAST(json_extract(js, '$.lock_in_months') AS BOOLEAN) AS INTEGER)
            WHEN json_type(js, '$.lock_in_months') = 'VARCHAR' THEN
              CASE WHEN regexp_matches(json_extract_string(js, '$.lock_in_months'), '^\\s*[+-]?[0-9]+\\s*$')
                   THEN TRY_CAST(trim(json_extract_string(js, '$.lock_in_months')) AS INTEGER) END
            ELSE trunc(TRY_CAST(json_extract_string(js, '$.lock_in_months') AS DOUBLE)) END AS DOUBLE) AS lock_in_months,
  '[' || array_to_string(list_transform(list_sort(list_distinct(list_filter(
      CASE WHEN json_type(js, '$.amenities') = 'ARRAY' THEN CAST(json_extract(js, '$.amenities') AS VARCHAR[]) ELSE [] END,
      lambda a: list_contains({TAGS_SQL}, a)))), lambda x: '"' || x || '"'), ', ') || ']' AS amenities_json
FROM ok"""


@query("llm_response_normalize", LLM_CTE + "\n" + LLM_SELECT)
def llm_response_normalize(spark, sf_dir):
    r = fx(spark, sf_dir, "fx_responses")
    n = ex.normalize_llm_answer(F.col("response"))
    d = r.select("listing_id", n.alias("n")).where(F.col("n.ok")).select(
        "listing_id", "n.tenant_pref", "n.veg_only", "n.is_owner", "n.negotiable", "n.lock_in_months",
        "n.amenities_json")
    return shape(d, as_double=EXTRACT_INT_COLS)


COST_SQL = (f"(CAST(coalesce(prompt_tokens, 0) AS DOUBLE) / 1000000.0) * {ex.INPUT_COST_PER_1M!r} "
            f"+ (CAST(coalesce(output_tokens, 0) AS DOUBLE) / 1000000.0) * {ex.OUTPUT_COST_PER_1M!r}")


@query("token_cost", fx_cte("fx_responses") + f"""
SELECT listing_id, floor(({COST_SQL}) * 1e12 + 0.5) / 1e12 AS cost_usd FROM fx_responses
""")
def token_cost(spark, sf_dir):
    r = fx(spark, sf_dir, "fx_responses")
    c = ex.token_cost(F.col("prompt_tokens"), F.col("output_tokens"))
    return r.select("listing_id", (F.floor(c * F.lit(1e12) + F.lit(0.5)) / F.lit(1e12)).alias("cost_usd"))


@query("llm_batch_cost", fx_cte("fx_responses") + f"""
SELECT count(*) AS n_calls, floor(sum(floor(({COST_SQL}) * 1e12 + 0.5)) + 0.5) / 1e12 AS total_cost_usd FROM fx_responses
""")
def llm_batch_cost(spark, sf_dir):
    """Total cost of a batch; per-call costs are summed as integer pico-dollars
    so the total does not depend on summation order."""
    r = fx(spark, sf_dir, "fx_responses")
    pico = F.floor(ex.token_cost(F.col("prompt_tokens"), F.col("output_tokens")) * F.lit(1e12) + F.lit(0.5))
    return r.agg(F.count(F.lit(1)).alias("n_calls"),
                 (F.floor(F.sum(pico).cast("double") + F.lit(0.5)) / F.lit(1e12)).alias("total_cost_usd"))


PROMPT_HEAD, PROMPT_TAIL = ex.PROMPT_TEMPLATE.split("{text}")


@query("prompt_batch", LLM_CTE.replace("WITH ", fx_cte("fx_messages").replace("WITH ", "WITH ", 1).rstrip() + ",\n", 1)
       + f""",
msgs AS (SELECT msg_id, {STRIP_TEXT_SQL} AS text FROM fx_messages)
SELECT msg_id AS listing_id, {sq(PROMPT_HEAD)} || text || {sq(PROMPT_TAIL)} AS prompt
FROM msgs WHERE {listing_sql('text')} AND msg_id NOT IN (SELECT listing_id FROM ok)
""")
def prompt_batch(spark, sf_dir):
    """D7 + K12: listing-like posts without a parsed LLM answer get a prompt."""
    m = messages(spark, sf_dir).where(tx.looks_like_listing(F.col("text")))
    r = fx(spark, sf_dir, "fx_responses")
    done = r.where(ex.normalize_llm_answer(F.col("response"))["ok"]).select(F.col("listing_id").alias("msg_id"))
    pending = m.join(done, "msg_id", "left_anti")
    return pending.select(F.col("msg_id").alias("listing_id"), ex.prompt_for(F.col("text")).alias("prompt"))


# --- K8 / G6 enrichment -----------------------------------------------------------

ENRICH_SQL = fx_cte("fx_listings", "fx_cards") + ", " + CORRECT_CTE + f""",
parsed AS (SELECT f.listing_id, f.locality, {card_fields_sql('f.raw_text')['property_type']} AS p_type,
    {card_fields_sql('f.raw_text')['deposit']} AS p_dep, {card_fields_sql('f.raw_text')['floor_num']} AS p_fn,
    {card_fields_sql('f.raw_text')['total_floors']} AS p_tf, {card_fields_sql('f.raw_text')['age_years']} AS p_age,
    CAST(f.changed AS INTEGER) AS changed FROM fixed f),
e AS (SELECT l.listing_id, coalesce(l.property_type, p.p_type) AS property_type, coalesce(l.deposit, p.p_dep) AS deposit,
    coalesce(CAST(l.floor_num AS DOUBLE), p.p_fn) AS floor_num, coalesce(CAST(l.total_floors AS DOUBLE), p.p_tf) AS total_floors,
    p.p_age AS age_years, p.locality, p.changed,
    p.p_type IS NOT NULL AS has_pt, p.p_dep IS NOT NULL AS has_dep, p.p_fn IS NOT NULL AS has_fl, p.p_age IS NOT NULL AS has_age,
    CASE WHEN p.listing_id IS NULL THEN l.locality_norm ELSE {NORM_LOC_SQL.replace('locality', 'p.locality')} END AS locality_norm, p.listing_id IS NOT NULL AS hit
  FROM fx_listings l LEFT JOIN parsed p ON l.listing_id = p.listing_id AND l.source = 'nobroker')"""


@query("enrich_fill", ENRICH_SQL + f"""
SELECT listing_id, property_type, deposit, floor_num, total_floors, age_years, locality, locality_norm FROM e
""")
def enrich_fill(spark, sf_dir):
    e = enrich.enrich_listings(fx(spark, sf_dir, "fx_listings"), fx(spark, sf_dir, "fx_cards"))
    return shape(e.select("listing_id", "property_type", "deposit", "floor_num", "total_floors", "age_years",
                          "locality", "locality_norm"), as_double=["floor_num", "total_floors"])


COVERAGE = {"n_property_type": "count_if(has_pt)", "n_deposit": "count_if(has_dep)", "n_floor": "count_if(has_fl)",
            "n_age": "count_if(has_age)", "n_locality_changed": "sum(changed)", "n_outside": "count_if(locality = 'outside_coverage')"}


@query("coverage_stats", ENRICH_SQL + "SELECT count(*) AS n_rows, "
       + ", ".join(f"CAST({v} AS BIGINT) AS {k}" for k, v in COVERAGE.items()) + ", "
       + ", ".join(f"{R6(f'CAST({v} AS DOUBLE) / count(*) * 100')} AS {k.replace('n_', 'pct_', 1)}" for k, v in COVERAGE.items())
       + " FROM e WHERE hit")
def coverage_stats(spark, sf_dir):
    _, cov = enrich.enrich_with_coverage(fx(spark, sf_dir, "fx_listings"), fx(spark, sf_dir, "fx_cards"))
    return shape(cov, [k.replace("n_", "pct_", 1) for k in COVERAGE])


@query("dry_run_sample", fx_cte("fx_cards") + f"""
SELECT listing_id, locality_query, {card_fields_sql('raw_text')['bhk']} AS bhk,
       {card_fields_sql('raw_text')['area_sqft']} AS area_sqft, {card_fields_sql('raw_text')['rent_monthly']} AS rent_monthly,
       left(raw_text, 300) AS preview
FROM fx_cards ORDER BY listing_id LIMIT 3
""")
def dry_run_sample(spark, sf_dir):
    """The first three parsed cards with a 300-character preview."""
    c = fx(spark, sf_dir, "fx_cards")
    t = F.col("raw_text")
    return (c.select("listing_id", "locality_query", tx.parse_bhk(t).alias("bhk"), tx.parse_area(t).alias("area_sqft"),
                     tx.parse_inr(t).alias("rent_monthly"), F.substring(t, 1, 300).alias("preview"))
             .orderBy("listing_id").limit(3))


@query("extraction_rows", f"""WITH st AS ({ORACLES['listing_upsert']}),
cards AS ({FX_SQL['fx_cards']}),
j AS (SELECT st.listing_id, c.listing_id AS raw_id, c.raw_text AS text FROM st JOIN cards c ON c.listing_id = st.latest_raw_id)
SELECT listing_id, raw_id, {sq(ex.REGEX_EXTRACTOR)} AS extractor, {sq(ex.REGEX_EXTRACTOR_VERSION)} AS extractor_version,
       {", ".join(f"{v} AS {k}" for k, v in extract_sql("text").items())}, CAST(0 AS DOUBLE) AS cost_usd FROM j
""")
def extraction_rows(spark, sf_dir):
    """J2 + D7 + T18: every pending listing of the ingested state, its latest raw text, extracted."""
    from rentlens.operators import benchmark as bm
    from rentlens.plans.q_ingest import listing_upsert
    raws = fx(spark, sf_dir, "fx_cards").select(F.col("listing_id").alias("raw_id"), "raw_text")
    none = spark.createDataFrame([], "listing_id string, extractor string, extractor_version string")
    rows = bm.extraction_rows(listing_upsert(spark, sf_dir), raws, none)
    return shape(rows.drop("extracted_at", "latency_ms"), as_double=EXTRACT_INT_COLS)


@query("llm_quarantine", LLM_CTE + """
SELECT sp.listing_id, sp.response, 'no JSON object' AS reason, t.n_read, t.n_kept
FROM sp, (SELECT (SELECT count(*) FROM sp) AS n_read, (SELECT count(*) FROM ok) AS n_kept) t
WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.listing_id = sp.listing_id)
""")
def llm_quarantine(spark, sf_dir):
    """The answers that leave no extraction, with the reason, and what the pass counted."""
    rows = fx(spark, sf_dir, "fx_responses").select("listing_id", "response", ex.normalize_llm_answer(F.col("response")).alias("n"))
    done = jsonl.quarantined(rows, F.when(~F.coalesce(F.col("n.ok"), F.lit(False)), NO_OBJECT), [NO_OBJECT], ["listing_id", "response"])
    return done.quarantine.select("*", *[F.lit(done.counts[c]).cast("bigint").alias(f"n_{c}") for c in ("read", "kept")])


NO_OBJECT = "no JSON object"
EXTRACTION_KEY = ["listing_id", "extractor", "extractor_version"]


@query("extraction_replace", fx_cte("fx_extractions") + """
SELECT listing_id, extractor, extractor_version, tenant_pref,
       CASE WHEN listing_id % 3 = 0 AND extractor = 'regex-v1' THEN cost_usd + 1 ELSE cost_usd END AS cost_usd FROM fx_extractions
""")
def extraction_replace(spark, sf_dir):
    """K6: extractions of one extractor made again for some listings replace theirs in the stored table."""
    path = scratch_path(spark, f"extractions-{uuid.uuid4().hex}")
    rows = fx(spark, sf_dir, "fx_extractions").select(*EXTRACTION_KEY, "tenant_pref", "cost_usd")
    store.replace_in_buckets(rows, path, EXTRACTION_KEY)
    again = rows.where("listing_id % 3 = 0 AND extractor = 'regex-v1'").withColumn("cost_usd", F.col("cost_usd") + 1)
    store.replace_in_buckets(again, path, EXTRACTION_KEY)
    return store.read_buckets(spark, path)
