"""K8 enrichment: parse card text for structured fields and fill them into
listings; G6 coverage counts.

The join of listings to their card text is an equi-join on listing id, and all
parsing is Column expressions, so the whole update is one shuffle (or none
when both sides share a partitioning) and one codegen stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rentlens.functions import text as tx

FILL_COLS = ["property_type", "deposit", "floor_num", "total_floors", "age_years"]


def parse_cards(cards: DataFrame, text_col: str = "raw_text", current_col: str = "locality_query") -> DataFrame:
    staged = tx.with_card_fields(cards.select("listing_id", text_col, current_col), text_col,
                                 ["property_type", "deposit", "floor", "age_years"])
    staged = staged.withColumn("_loc", tx.correct_locality(F.col(text_col), F.col(current_col)))
    # second projection: the struct above is computed once and then read
    return staged.select("listing_id", *[F.col(c).alias(f"p_{c}") for c in FILL_COLS],
                         F.col("_loc.locality").alias("p_locality"), F.col("_loc.changed").alias("p_changed"))


def _enriched(listings: DataFrame, cards: DataFrame, force: bool, source: str):
    parsed = parse_cards(cards).withColumn("p_source", F.lit(source)).withColumnRenamed("listing_id", "p_id")
    base = listings
    for c in FILL_COLS:
        if c not in base.columns:
            base = base.withColumn(c, F.lit(None).cast("string" if c == "property_type" else "double"))
        elif c in ("floor_num", "total_floors"):
            base = base.withColumn(c, F.col(c).cast("double"))
    if "locality" not in base.columns:
        base = base.withColumn("locality", F.lit(None).cast("string"))
    j = base.join(parsed, (base["listing_id"] == parsed["p_id"]) & (base["source"] == parsed["p_source"]), "left")
    hit = F.col("p_id").isNotNull()
    for c in FILL_COLS:
        new = F.col(f"p_{c}")
        j = j.withColumn(c, F.when(hit, new).otherwise(F.col(c)) if force else F.coalesce(F.col(c), new))
    return (j.withColumn("locality", F.when(hit, F.col("p_locality")).otherwise(F.col("locality")))
             .withColumn("locality_norm", F.when(hit, tx.normalize_locality(F.col("p_locality")))
                         .otherwise(F.col("locality_norm"))))


def enrich_listings(listings: DataFrame, cards: DataFrame, force: bool = False,
                    source: str = "nobroker") -> DataFrame:
    """Fill NULL fields of one source's listings from their parsed card text
    (``force`` overwrites); the locality of those is always replaced by the
    corrected one. Every other listing is kept as it is."""
    j = _enriched(listings, cards, force, source)
    return j.drop(*[c for c in j.columns if c.startswith("p_")])


def enrich_with_coverage(listings: DataFrame, cards: DataFrame, force: bool = False,
                         source: str = "nobroker"):
    """(enriched listings, one-row coverage counts and shares in % of what the parsers found)."""
    j = _enriched(listings, cards, force, source)
    cov = j.where("p_id IS NOT NULL").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("p_property_type").alias("n_property_type"),
        F.count("p_deposit").alias("n_deposit"),
        F.count("p_floor_num").alias("n_floor"),
        F.count("p_age_years").alias("n_age"),
        F.sum(F.col("p_changed").cast("long")).alias("n_locality_changed"),
        F.count(F.when(F.col("p_locality") == "outside_coverage", 1)).alias("n_outside"),
    )
    counts = cov.columns[1:]
    cov = cov.select("*", *[(F.coalesce(F.try_divide(F.col(c), F.col("n_rows")), F.lit(0.0)) * 100).alias(c.replace("n_", "pct_", 1))
                            for c in counts])
    return j.drop(*[c for c in j.columns if c.startswith("p_")]), cov
