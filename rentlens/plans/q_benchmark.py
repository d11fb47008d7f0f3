"""Benchmark and labelling plans over documents, labels and their projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from rentlens.functions import extract as ex, text as tx
from rentlens.operators import benchmark as bm
from rentlens.plans.common import R6, shape
from rentlens.plans.registry import query, sq
from rentlens.sources.fixtures import fx, fx_cte
from rentlens.sources.tables import read_table

LLM = "llm"   # extractor name used by the FX-extractions projection

TAG_SET = "list_sort(list_distinct(coalesce(CAST(json({c}) AS VARCHAR[]), []::VARCHAR[])))"
LATEST_SQL = """latest AS (SELECT * FROM fx_extractions
  QUALIFY row_number() OVER (PARTITION BY listing_id, extractor ORDER BY extracted_at DESC, extractor_version DESC) = 1)"""
HITS = {f: f"l.{f} IS NOT DISTINCT FROM x.{f}" for f in bm.FIELDS if f != "amenities"}
HITS["amenities"] = f"{TAG_SET.format(c='l.amenities_json')} = {TAG_SET.format(c='x.amenities_json')}"


@query("extractor_scorecard", fx_cte("fx_labels", "fx_extractions") + f""",
{LATEST_SQL},
lab AS (SELECT 'holdout-v1-full' AS eval_set, * FROM fx_labels
        UNION ALL SELECT 'holdout-v1-human', * FROM fx_labels WHERE label_source = 'human'),
a AS (SELECT eval_set, extractor, arg_max(extractor_version, extracted_at) AS extractor_version, count(*) AS n_examples,
        {", ".join(f"avg(CAST(({ok}) AS DOUBLE)) AS a_{f}" for f, ok in HITS.items())},
        avg(coalesce(cost_usd, 0.0)) * 1000 AS c, quantile_cont(coalesce(latency_ms, 0.0), 0.5) AS p50,
        quantile_cont(coalesce(latency_ms, 0.0), 0.95) AS p95
      FROM lab l JOIN latest x ON x.listing_id = l.listing_id GROUP BY eval_set, extractor)
SELECT eval_set, extractor, extractor_version, n_examples, {", ".join(f"{R6(f'a_{f}')} AS acc_{f}" for f in bm.FIELDS)},
       {R6("(" + " + ".join(f"a_{f}" for f in bm.FIELDS) + ") / 6")} AS macro_accuracy, {R6('c')} AS cost_per_1k_usd,
       {R6('p50')} AS p50_latency_ms, {R6('p95')} AS p95_latency_ms
FROM a
""")
def extractor_scorecard(spark, sf_dir):
    s = bm.scorecard(fx(spark, sf_dir, "fx_labels"), fx(spark, sf_dir, "fx_extractions"))
    cols = ["eval_set", "extractor", "extractor_version", "n_examples"] + [f"acc_{f}" for f in bm.FIELDS] + [
        "macro_accuracy", "cost_per_1k_usd", "p50_latency_ms", "p95_latency_ms"]
    return shape(s.select(*cols), [c for c in cols[4:]])


@query("pending_extractions", fx_cte("fx_extractions") + f"""
SELECT d.doc_id AS listing_id FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM fx_extractions e WHERE e.listing_id = d.doc_id
                  AND e.extractor = {sq(ex.REGEX_EXTRACTOR)} AND e.extractor_version = {sq(ex.REGEX_EXTRACTOR_VERSION)})
""")
def pending_extractions(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("listing_id"))
    return bm.pending(docs, fx(spark, sf_dir, "fx_extractions"), ex.REGEX_EXTRACTOR, ex.REGEX_EXTRACTOR_VERSION)


@query("pending_labels", """
SELECT d.doc_id AS listing_id FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)
""")
def pending_labels(spark, sf_dir):
    """Listings without a label (ordered by id when a limit is asked)."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("listing_id"))
    labelled = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("listing_id"))
    return docs.join(labelled, "listing_id", "left_anti")


def _hint_sql(f: str) -> str:
    of = lambda name: f"max(CASE WHEN extractor = '{name}' THEN {f} END)"
    return f"coalesce({of(LLM)}, {of('regex-v1')}) AS {f}"


HINT_FIELDS = [f for f in bm.FIELDS if f != "amenities"]
PRELABEL_SQL = fx_cte("fx_extractions") + f""",
{LATEST_SQL},
hints AS (SELECT listing_id, {", ".join(map(_hint_sql, HINT_FIELDS))}, CAST(json({_hint_sql("amenities_json").removesuffix(" AS amenities_json")}) AS VARCHAR[]) AS amenities
  FROM latest GROUP BY listing_id)"""
FLAGS = [f for f in HINT_FIELDS if f != "tenant_pref"]
JSON_LIST = "'[' || array_to_string(list_transform({a}, lambda x: '\"' || x || '\"'), ', ') || ']'"


@query("prelabel", PRELABEL_SQL + f"""
SELECT listing_id, tenant_pref, {", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in FLAGS)},
       {JSON_LIST.format(a='amenities')} AS amenities_json FROM hints
""")
def prelabel(spark, sf_dir):
    h = bm.prelabel(fx(spark, sf_dir, "fx_extractions"), preferred=LLM)
    h = h.withColumn("amenities_json", tx.json_string_array(F.col("amenities"))).drop("amenities")
    return shape(h, as_double=FLAGS)


# Typed answers of a labelling session, derived deterministically from labels; every eleventh is all empty.
ANSWERS_SQL = """SELECT doc_id AS listing_id,
  CASE WHEN doc_id % 11 = 0 THEN '' ELSE CASE doc_id % 6 WHEN 0 THEN 'family' WHEN 1 THEN ' any ' WHEN 2 THEN 'none' WHEN 3 THEN 'aliens' ELSE '' END END AS a_tenant_pref,
  CASE WHEN doc_id % 11 = 0 THEN chr(10) ELSE CASE doc_id % 7 WHEN 0 THEN 'yes' WHEN 1 THEN ' N ' WHEN 2 THEN concat(chr(9), 'true') WHEN 3 THEN '' WHEN 4 THEN 'none'
                  WHEN 5 THEN 'maybe' ELSE '0' END END AS a_veg_only,
  CASE WHEN doc_id % 11 = 0 THEN '' ELSE CASE doc_id % 3 WHEN 0 THEN 't' WHEN 1 THEN 'n' ELSE '' END END AS a_is_owner,
  CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE CASE doc_id % 3 WHEN 1 THEN 'False' ELSE '' END END AS a_negotiable,
  CASE WHEN doc_id % 11 = 0 THEN '' ELSE CASE doc_id % 5 WHEN 0 THEN '11' WHEN 1 THEN 'six' WHEN 2 THEN '' WHEN 3 THEN '-' ELSE ' +3 ' END END AS a_lock_in_months,
  CASE WHEN doc_id % 11 = 0 THEN '' ELSE CASE doc_id % 4 WHEN 0 THEN 'Gym, lift,gym' WHEN 1 THEN 'none' WHEN 2 THEN '' ELSE 'jacuzzi, AC, ' END END AS a_amenities
FROM labels"""


def strip_sql(t: str) -> str:
    return f"regexp_replace({t}, '^{tx.WS}+|{tx.WS}+$', '', 'g')"


BOOL_SQL = ("CASE WHEN lower({a}) IN ('none', 'null', '-') THEN NULL WHEN {a} IN ('1', 'y', 'yes', 'true', 't') "
            "THEN 1 WHEN {a} IN ('0', 'n', 'no', 'false', 'f') THEN 0 END")
TAGS_SQL = "[" + ", ".join(sq(t) for t in ex.AMENITY_TAGS) + "]"
TENANTS_SQL = ", ".join(sq(t) for t in ex.TENANT_VALUES)


@query("label_normalize", PRELABEL_SQL + f""", answers AS ({ANSWERS_SQL}),
s AS (SELECT listing_id, {", ".join(f"{strip_sql(f'a_{f}')} AS {f}" for f in bm.FIELDS)} FROM answers),
p AS (SELECT a.listing_id,
  CASE WHEN a.tenant_pref = '' THEN h.tenant_pref WHEN lower(a.tenant_pref) IN ('none', 'null', '-') THEN NULL
       WHEN a.tenant_pref IN ({TENANTS_SQL}) THEN a.tenant_pref ELSE h.tenant_pref END AS tenant_pref,
  {", ".join(f"CASE WHEN a.{f} = '' THEN h.{f} ELSE {BOOL_SQL.format(a=f'a.{f}')} END AS {f}" for f in ("veg_only", "is_owner", "negotiable"))},
  CASE WHEN a.lock_in_months = '' THEN CAST(h.lock_in_months AS INTEGER) WHEN lower(a.lock_in_months) IN ('none', 'null', '-') THEN NULL
       WHEN regexp_matches(a.lock_in_months, '^[+-]?[0-9]+$') THEN TRY_CAST(a.lock_in_months AS INTEGER) END AS lock_in_months,
  CASE WHEN a.amenities = '' THEN coalesce(h.amenities, []::VARCHAR[]) WHEN lower(a.amenities) IN ('none', 'null', '-', 'empty') THEN []::VARCHAR[]
       ELSE list_sort(list_distinct(list_filter(list_transform(string_split(a.amenities, ','), lambda t: lower(trim(t))),
                                                lambda t: t <> '' AND list_contains({TAGS_SQL}, t)))) END AS am,
  CASE WHEN {" OR ".join(f"a.{f} <> ''" for f in bm.FIELDS)} THEN 'human' ELSE 'silver-gemini' END AS label_source
  FROM s a LEFT JOIN hints h ON h.listing_id = a.listing_id)
SELECT listing_id, tenant_pref, {", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in FLAGS)},
       {JSON_LIST.format(a='am')} AS amenities_json, label_source
FROM p
""")
def label_normalize(spark, sf_dir):
    from rentlens.sources.tables import register_views
    register_views(spark, sf_dir, ["labels"])
    answers = spark.sql(ANSWERS_SQL)
    hints = bm.prelabel(fx(spark, sf_dir, "fx_extractions"), preferred=LLM)
    return shape(bm.parse_answers(answers, hints), as_double=FLAGS)


@query("label_corrections", fx_cte("fx_labels") + """
SELECT l.listing_id, CASE WHEN l.listing_id % 7 = 0 THEN NULL ELSE CAST(l.veg_only AS DOUBLE) END AS veg_only,
       CAST(CASE WHEN l.listing_id % 7 = 0 AND l.listing_id % 13 = 0 THEN 1
                 WHEN l.listing_id % 13 = 0 THEN 1 ELSE l.is_owner END AS DOUBLE) AS is_owner,
       CASE WHEN l.listing_id % 13 = 0 OR l.listing_id % 7 = 0 THEN 'human' ELSE l.label_source END AS label_source
FROM fx_labels l WHERE l.listing_id % 29 <> 0
""")
def label_corrections(spark, sf_dir):
    """D6 with corrections derived from the labels: ids divisible by 13 are
    re-labelled as owner posts, those divisible by 7 lose their veg-only flag,
    ids divisible by 29 are dropped as non-rentals."""
    return shape(bm.apply_corrections(*_corrections(spark, sf_dir))
                 .select("listing_id", "veg_only", "is_owner", "label_source"), as_double=["veg_only", "is_owner"])


def _corrections(spark, sf_dir):
    lab = fx(spark, sf_dir, "fx_labels")
    owner, unset = F.col("listing_id") % 13 == 0, F.col("listing_id") % 7 == 0
    fixes = lab.where(owner | unset).select(
        "listing_id", F.lit(1).alias("is_owner"), F.lit(None).cast("int").alias("veg_only"),
        F.array_compact(F.array(F.when(owner, F.lit("is_owner")), F.when(unset, F.lit("veg_only")))).alias("fields"))
    return lab, fixes, lab.where(F.col("listing_id") % 29 == 0).select("listing_id")


@query("correction_counts", fx_cte("fx_labels") + """
SELECT count(*) FILTER (WHERE (listing_id % 13 = 0 OR listing_id % 7 = 0) AND listing_id % 29 <> 0) AS n_changed,
       count(*) FILTER (WHERE listing_id % 29 = 0) AS n_dropped FROM fx_labels
""")
def correction_counts(spark, sf_dir):
    return bm.correction_counts(*_corrections(spark, sf_dir))


PENDING_LIMIT = 100


@query("pending_labels_first", f"""
SELECT d.doc_id AS listing_id, d.text AS raw_text FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)
ORDER BY d.doc_id LIMIT {PENDING_LIMIT}
""")
def pending_labels_first(spark, sf_dir):
    """The first unlabelled listings by id with their text, for one labelling session."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("listing_id"), F.col("text").alias("raw_text"))
    labelled = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("listing_id"))
    return docs.join(labelled, "listing_id", "left_anti").orderBy("listing_id").limit(PENDING_LIMIT)
