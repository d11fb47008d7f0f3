"""Extractor benchmark (G3/G4, A1, J5, J10, F8, K11) and label workflows
(D6 corrections, D7/D8 pending sets, D9 pre-labels, D10 provenance, T24
typed-answer parsing).

Both evaluation slices (human-only and full) are stacked onto the label rows,
so one join of labels to extractions and one grouped aggregation score every
extractor on every slice; latency percentiles use the exact distributed rank
operator.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, functions as F

from rentlens.functions import extract as ex, text as tx
from rentlens.operators import stats
from rentlens.session import materialize
from rentlens.sources import store

FIELDS = ["tenant_pref", "veg_only", "is_owner", "negotiable", "lock_in_months", "amenities"]
EVAL_HUMAN, EVAL_FULL = "holdout-v1-human", "holdout-v1-full"


def _with_fields(df: DataFrame) -> DataFrame:
    for f in FIELDS:
        if f == "amenities":
            if "amenities_json" in df.columns and "amenities" not in df.columns:
                df = df.withColumn("amenities", F.from_json("amenities_json", "array<string>"))
            elif "amenities" not in df.columns:
                df = df.withColumn("amenities", F.lit(None).cast("array<string>"))
        elif f not in df.columns:
            df = df.withColumn(f, F.lit(None).cast("string" if f == "tenant_pref" else "int"))
    return df


def tag_set(c) -> F.Column:
    """A1: NULL = empty set; compare as sorted distinct arrays."""
    return F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))


def latest_labels(labels: DataFrame, order_col: str) -> DataFrame:
    """Duplicate listing ids -> the last line (max ``order_col``) wins."""
    rest = [c for c in labels.columns if c != "listing_id"]
    return (labels.groupBy("listing_id").agg(F.max_by(F.struct(*rest), F.col(order_col)).alias("_l"))
                  .select("listing_id", "_l.*"))


def latest_extractions(extractions: DataFrame, order_col: str = "extracted_at") -> DataFrame:
    """One row per (listing, extractor), the latest by ``order_col``; ties go
    to the largest version."""
    keys = ["listing_id", "extractor"]
    rest = [c for c in extractions.columns if c not in keys]
    order = F.struct(*[F.col(c) for c in (order_col, "extractor_version") if c in rest], F.lit(0))
    return (extractions.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_l")).select(*keys, "_l.*"))


def scorecard(labels: DataFrame, extractions: DataFrame) -> DataFrame:
    """G4 per (eval_set, extractor): n_examples, per-field accuracy (NULL equals
    NULL, values compared by their type), macro accuracy, mean cost x 1000,
    p50/p95 latency (NULL -> 0). Each listing counts its latest extraction by an
    extractor; the version shown is the latest one among those."""
    lab = _with_fields(labels)
    slices = F.array(F.lit(EVAL_FULL), F.when(F.col("label_source") == "human", F.lit(EVAL_HUMAN)))
    lab = lab.select(F.explode(F.array_compact(slices)).alias("eval_set"), "listing_id",
                     *[F.col(f).alias(f"g_{f}") for f in FIELDS])
    x = _with_fields(latest_extractions(extractions))
    stamp = F.col("extracted_at") if "extracted_at" in x.columns else F.lit(None).cast("timestamp")
    x = x.select("listing_id", "extractor", "extractor_version", stamp.alias("extracted_at"),
                 *[F.col(f).alias(f"p_{f}") for f in FIELDS],
                 F.coalesce(F.col("latency_ms"), F.lit(0.0)).alias("latency_ms"),
                 F.coalesce(F.col("cost_usd"), F.lit(0.0)).alias("cost_usd"))
    j = lab.join(x, "listing_id")      # J10: label without a prediction is skipped
    hits = []
    for f in FIELDS:
        if f == "amenities":
            ok = tag_set(F.col("p_amenities")) == tag_set(F.col("g_amenities"))
        else:
            kind = "string" if f == "tenant_pref" else "double"
            ok = F.col(f"p_{f}").cast(kind).eqNullSafe(F.col(f"g_{f}").cast(kind))
        hits.append(F.avg(ok.cast("double")).alias(f"acc_{f}"))
    version = F.max_by("extractor_version", F.struct("extracted_at", "extractor_version"))
    keys = ["eval_set", "extractor"]
    agg = j.groupBy(*keys).agg(version.alias("extractor_version"), F.count(F.lit(1)).alias("n_examples"),
                               *hits, (F.avg("cost_usd") * 1000).alias("cost_per_1k_usd"))
    agg = agg.withColumn("macro_accuracy", sum(F.col(f"acc_{f}") for f in FIELDS) / len(FIELDS))
    lat = stats.group_quantiles(materialize(j.select(*keys, "latency_ms")), keys, "latency_ms", {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95},
                                median_as_mean=False)
    return agg.join(lat, keys, "left")


def pending(listings: DataFrame, extractions: DataFrame, extractor: str, version: str, key: str = "listing_id",
            force: bool = False) -> DataFrame:
    """Listings without an extraction by (extractor, version); ``force`` = all."""
    if force:
        return listings
    done = extractions.where((F.col("extractor") == extractor) & (F.col("extractor_version") == version))
    return listings.join(done.select(F.col("listing_id").alias(key)).distinct(), key, "left_anti")


def prelabel(extractions: DataFrame, preferred: str = ex.LLM_EXTRACTOR, fallback: str = ex.REGEX_EXTRACTOR,
             fields=tuple(FIELDS)) -> DataFrame:
    """Hints of all label fields per listing, from the latest row of each
    extractor: the preferred one's value when non-NULL, else the fallback's.
    Amenities come from the preferred extractor's row even when it has none."""
    x = _with_fields(latest_extractions(extractions).where(F.col("extractor").isin(preferred, fallback)))
    of = lambda name, c: F.max(F.when(F.col("extractor") == name, c))
    aggs = [F.coalesce(of(preferred, F.col(f)), of(fallback, F.col(f))).alias(f) for f in fields if f != "amenities"]
    if "amenities" in fields:
        tags = F.coalesce("amenities", F.array().cast("array<string>"))
        aggs.append(F.coalesce(of(preferred, tags), of(fallback, tags)).alias("amenities"))
    return x.groupBy("listing_id").agg(*aggs)


TENANTS = ex.TENANT_VALUES


def parse_answers(answers: DataFrame, hints: DataFrame) -> DataFrame:
    """T24 + D10: typed answers (``a_<field>``) -> label row. An empty answer keeps
    the hint, for every field; provenance is 'human' when any answer was typed."""
    h = _with_fields(hints).select("listing_id", *[F.col(f).alias(f"h_{f}") for f in FIELDS])
    j = answers.join(h, "listing_id", "left")
    for f in FIELDS:
        if f"a_{f}" not in j.columns:
            j = j.withColumn(f"a_{f}", F.lit(""))
    blank = {f: tx.strip(F.col(f"a_{f}")) == "" for f in FIELDS}
    parsed = {"tenant_pref": tx.parse_choice_answer(F.col("a_tenant_pref"), TENANTS, F.col("h_tenant_pref")),
              "lock_in_months": tx.parse_int_answer(F.col("a_lock_in_months")),
              "amenities": tx.parse_tag_answer(F.col("a_amenities"), ex.AMENITY_TAGS)}
    out = {}
    for f in FIELDS:
        value = parsed[f] if f in parsed else tx.parse_bool_answer(F.col(f"a_{f}"))
        hint = F.col(f"h_{f}")
        if f == "amenities":
            hint = F.coalesce(hint, F.array().cast("array<string>"))
        elif f != "tenant_pref":
            hint = hint.cast("int")
        out[f] = F.when(blank[f], hint).otherwise(value)
    typed = ~blank[FIELDS[0]]
    for f in FIELDS[1:]:
        typed = typed | ~blank[f]
    return j.select("listing_id", *[out[f].alias(f) for f in FIELDS if f != "amenities"],
                    tx.json_string_array(out["amenities"]).alias("amenities_json"),
                    F.when(typed, F.lit("human")).otherwise(F.lit("silver-gemini")).alias("label_source"))


def apply_corrections(labels: DataFrame, fixes: DataFrame, drops: DataFrame) -> DataFrame:
    """Drop listed ids, override the fields that a fix names, and upgrade the
    corrected rows' provenance to 'human'.

    A fix names its fields in ``fields`` (array of column names), so a field can
    be set to NULL; without that column, the fields that are not NULL count.
    """
    kept = labels.join(drops.select("listing_id").distinct(), "listing_id", "left_anti")
    fcols = [c for c in fixes.columns if c not in ("listing_id", "fields")]
    named = F.col("fields") if "fields" in fixes.columns else F.array_compact(
        F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in fcols]))
    f = fixes.select("listing_id", *[F.col(c).alias(f"fix_{c}") for c in fcols], named.alias("_named"))
    out = kept.join(f, "listing_id", "left")
    for c in fcols:
        out = out.withColumn(c, F.when(F.array_contains("_named", c), F.col(f"fix_{c}")).otherwise(F.col(c)))
    out = out.withColumn("label_source", F.when(F.col("_named").isNotNull(), F.lit("human")).otherwise(F.col("label_source")))
    return out.drop("_named", *[f"fix_{c}" for c in fcols])


def correction_counts(labels: DataFrame, fixes: DataFrame, drops: DataFrame) -> DataFrame:
    """Labels that corrections change and drop."""
    ids = labels.select("listing_id")
    gone = drops.select("listing_id").distinct()
    fixed = ids.join(fixes.select("listing_id").distinct(), "listing_id", "left_semi").join(gone, "listing_id", "left_anti")
    dropped = ids.join(gone, "listing_id", "left_semi")
    return (fixed.select(F.lit("changed").alias("what")).unionByName(dropped.select(F.lit("dropped").alias("what")))
            .agg(F.count(F.when(F.col("what") == "changed", 1)).alias("n_changed"),
                 F.count(F.when(F.col("what") == "dropped", 1)).alias("n_dropped")))


def extraction_rows(listings: DataFrame, raws: DataFrame, extractions: DataFrame, extractor: str = ex.REGEX_EXTRACTOR,
                    version: str = ex.REGEX_EXTRACTOR_VERSION, limit: int | None = None, force: bool = False) -> DataFrame:
    """J2 + D7 + T18: the regex extractor's rows for pending listings.

    Listings find their text by ``latest_raw_id``; pending ones are taken in the
    order of listing_id, the first ``limit`` if given (the feature). Rows carry
    raw_id, extractor, version, extracted_at, latency and cost, and replace rows
    with the same (listing, extractor, version) in the table (``run_extraction``). The latency is for the job
    to fill in: a row's own time has no meaning inside a compiled stage.
    """
    todo = pending(listings.select("listing_id", "latest_raw_id"), extractions, extractor, version, force=force)
    r = raws.select(F.col("raw_id").alias("_raw"), F.col("raw_text").alias("_text"))
    j = todo.join(r, todo["latest_raw_id"] == r["_raw"]).select("listing_id", F.col("_raw").alias("raw_id"), "_text")
    if limit is not None:
        j = j.orderBy("listing_id").limit(limit)
    d = ex.with_record(j, "_text")
    fields = [c for c in d.columns if c not in j.columns]
    return d.select("listing_id", "raw_id", F.lit(extractor).alias("extractor"), F.lit(version).alias("extractor_version"), *fields,
                    F.current_timestamp().alias("extracted_at"), F.lit(None).cast("double").alias("latency_ms"),
                    F.lit(0.0).alias("cost_usd"))


EXTRACTION_KEY = ["listing_id", "extractor", "extractor_version"]


def run_extraction(listings: DataFrame, raws: DataFrame, path: str, extractor: str = ex.REGEX_EXTRACTOR,
                   version: str = ex.REGEX_EXTRACTOR_VERSION, limit: int | None = None, force: bool = False) -> int:
    """The extraction job (T18, K6): extracts what is pending against the table at ``path`` (with ``force``: every
    listing again) and replaces those rows there, bucket by bucket. Every row's latency is the batch's wall time over
    its rows. Returns the number of rows written.
    """
    spark = listings.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    id_type = listings.schema["listing_id"].dataType.simpleString()
    done = (store.read_buckets(spark, path).select(*EXTRACTION_KEY) if there else
            spark.createDataFrame([], f"listing_id {id_type}, extractor string, extractor_version string"))
    began = time.monotonic()
    rows = materialize(extraction_rows(listings, raws, done, extractor, version, limit, force))
    n = rows.count()
    if n:
        each = (time.monotonic() - began) * 1000 / n
        store.replace_in_buckets(rows.withColumn("latency_ms", F.lit(each)), path, EXTRACTION_KEY)
    return n
