"""Landed-source scans: chat-group top-N (S2/W5), cards from landed pages
(S1), group selection (S3), referential-integrity report (J9) and key-set
differences (U1-U4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from rentlens.functions import text as tx


def newest_per_group(df: DataFrame, group: str, order, limit: int) -> DataFrame:
    """The newest ``limit`` rows per group. The row_number filter is planned
    with a partial WindowGroupLimit before the shuffle, so at most ``limit``
    rows per group leave each map task however large the group is."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit).drop("_rn")


def chat_listings(messages: DataFrame, group: str, order, limit: int, cutoff_col: str | None = None,
                  cutoff=None) -> DataFrame:
    """Newest ``limit`` per group first, then the recency cutoff, then strip
    and the listing filter (F1)."""
    d = newest_per_group(messages, group, order, limit)
    if cutoff_col is not None and cutoff is not None:
        d = d.where(F.col(cutoff_col) >= F.lit(cutoff))
    d = d.withColumn("text", tx.strip(F.col("text")))
    return d.where(tx.looks_like_listing(F.col("text")))


SCRIPT_STYLE = r"(?is)<(script|style)\b.*?</\1\s*>"
TAG = r"(?s)<[^>]*>"
FIRST_HREF = r"(?i)<a\s[^>]*href=\"([^\"]*)\""
ORIGIN = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)"


def page_text(html) -> F.Column:
    t = F.regexp_replace(F.regexp_replace(html, SCRIPT_STYLE, " "), TAG, " ")
    return F.trim(F.regexp_replace(t, tx.WS + "+", " "))


def cards_from_pages(pages: DataFrame, max_cards: int, min_chars: int = 40) -> DataFrame:
    """Visible text of each landed page as a card; short cards dropped;
    relative links made absolute; first ``max_cards`` per search (host)."""
    host = F.regexp_extract(F.col("url"), ORIGIN, 1)
    href = F.nullif(F.regexp_extract(F.col("html"), FIRST_HREF, 1), F.lit(""))
    d = pages.select("page_id", host.alias("locality_query"), page_text(F.col("html")).alias("raw_text"),
                     F.when(href.startswith("/"), F.concat(host, href)).otherwise(href).alias("source_url"))
    d = newest_per_group(d, "locality_query", [F.col("page_id")], max_cards)
    return d.where(F.char_length("raw_text") >= min_chars)


def select_groups(groups: DataFrame, names: list[str], ids: list[int], name_col: str = "group_name",
                  id_col: str = "group_id") -> DataFrame:
    """S3: groups whose trimmed lower-case title is wanted, or whose id is."""
    wanted = [n.strip().lower() for n in names]
    return groups.where(F.lower(F.trim(F.col(name_col))).isin(wanted) | F.col(id_col).isin(list(ids)))


def fk_violations(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, relation: str) -> DataFrame:
    """Count of child rows whose key has no parent (left anti join). A NULL
    key refers to nothing and is no violation."""
    bad = child.select(F.col(child_key).alias("_k")).where("_k IS NOT NULL").join(
        parent.select(F.col(parent_key).alias("_k")), "_k", "left_anti")
    return bad.agg(F.count(F.lit(1)).alias("n_violations")).select(F.lit(relation).alias("relation"), "n_violations")


def key_set_diff(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Keys missing from ``present`` and keys not ``expected``."""
    e = expected.select(F.col(key).alias("key")).distinct()
    p = present.select(F.col(key).alias("key")).distinct()
    return (e.subtract(p).select(F.lit("missing").alias("kind"), "key")
            .unionByName(p.subtract(e).select(F.lit("unexpected").alias("kind"), "key")))


def catalog_check(spark, expected: dict[str, list[str]], database: str | None = None) -> DataFrame:
    """The session catalog against the expected tables: (table_name, present, missing_columns).

    ``expected`` maps table names to the columns that they must have. A table of the catalog that is not expected is
    no finding. The catalog lists a few rows per database, whatever the tables hold.
    """
    found = {t.name.lower() for t in (spark.catalog.listTables(database) if database else spark.catalog.listTables())}
    rows = []
    for name, columns in expected.items():
        there = name.lower() in found
        have = {c.lower() for c in spark.table(f"{database}.{name}" if database else name).columns} if there else set()
        rows.append((name, there, ",".join(c for c in columns if c.lower() not in have) if there else None))
    return spark.createDataFrame(rows, "table_name string, present boolean, missing_columns string")
