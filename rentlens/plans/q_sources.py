"""Source-scan plans over conversations, pages, documents, orders, lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from rentlens.functions import text as tx
from rentlens.operators import sources_ops as so
from rentlens.plans.q_extract import STRIP_TEXT_SQL, listing_sql
from rentlens.plans.registry import query, sq
from rentlens.sources.tables import read_table, register_views

MSGS_PER_GROUP = 4
CARDS_PER_SEARCH = 30
WANTED_GROUP_NAMES = ["SRC1 ", " Src3"]
WANTED_GROUP_IDS = [7]


@query("message_topn", f"""
SELECT conv_id, turn, {STRIP_TEXT_SQL} AS text FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= {MSGS_PER_GROUP}
  AND {listing_sql(STRIP_TEXT_SQL)}
""")
def message_topn(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return so.chat_listings(conv, "conv_id", [F.col("turn").desc()], MSGS_PER_GROUP)


PAGE_TEXT_SQL = (f"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|"
                 f"(?is)<style\\b.*?</style\\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '{tx.WS}+', ' ', 'g'))")
HOST_SQL = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1)"
HREF_SQL = "NULLIF(regexp_extract(html, '(?i)<a\\s[^>]*href=\"([^\"]*)\"', 1), '')"


@query("cards_from_pages", f"""
SELECT page_id, locality_query, raw_text, source_url FROM (
  SELECT page_id, {HOST_SQL} AS locality_query, {PAGE_TEXT_SQL} AS raw_text,
         CASE WHEN starts_with({HREF_SQL}, '/') THEN {HOST_SQL} || {HREF_SQL} ELSE {HREF_SQL} END AS source_url,
         row_number() OVER (PARTITION BY {HOST_SQL} ORDER BY page_id) AS rn
  FROM pages) t
WHERE rn <= {CARDS_PER_SEARCH} AND length(raw_text) >= 40
""")
def cards_from_pages(spark, sf_dir):
    return so.cards_from_pages(read_table(spark, sf_dir, "pages"), CARDS_PER_SEARCH)


@query("select_groups", f"""
SELECT DISTINCT source AS group_name, CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) AS group_id FROM documents
WHERE lower(trim(source)) IN ({", ".join("'" + n.strip().lower() + "'" for n in WANTED_GROUP_NAMES)})
   OR CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) IN ({", ".join(map(str, WANTED_GROUP_IDS))})
""")
def select_groups(spark, sf_dir):
    groups = read_table(spark, sf_dir, "documents").select(F.col("source").alias("group_name")).distinct()
    groups = groups.withColumn("group_id", F.regexp_extract("group_name", r"(\d+)$", 1).cast("bigint"))
    return so.select_groups(groups, WANTED_GROUP_NAMES, WANTED_GROUP_IDS)


@query("fk_violations", """
SELECT 'lineitem.l_orderkey->orders' AS relation, count(*) AS n_violations FROM lineitem l
  WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)
UNION ALL SELECT 'lineitem.l_partkey->part', count(*) FROM lineitem l
  WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey)
UNION ALL SELECT 'lineitem.l_suppkey->supplier', count(*) FROM lineitem l
  WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = l.l_suppkey)
UNION ALL SELECT 'orders.o_custkey->customer', count(*) FROM orders o
  WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)
""")
def fk_violations(spark, sf_dir):
    t = lambda n: read_table(spark, sf_dir, n)
    parts = [so.fk_violations(t("lineitem"), t("orders"), "l_orderkey", "o_orderkey", "lineitem.l_orderkey->orders"),
             so.fk_violations(t("lineitem"), t("part"), "l_partkey", "p_partkey", "lineitem.l_partkey->part"),
             so.fk_violations(t("lineitem"), t("supplier"), "l_suppkey", "s_suppkey", "lineitem.l_suppkey->supplier"),
             so.fk_violations(t("orders"), t("customer"), "o_custkey", "c_custkey", "orders.o_custkey->customer")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("set_catalog", """
SELECT 'missing' AS kind, key FROM (SELECT o_orderkey AS key FROM orders EXCEPT SELECT l_orderkey FROM lineitem) a
UNION ALL
SELECT 'unexpected', key FROM (SELECT l_orderkey AS key FROM lineitem EXCEPT SELECT o_orderkey FROM orders) b
""")
def set_catalog(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    items = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"))
    return so.key_set_diff(orders, items, "key")


#: Tables that a warehouse must have, with the columns that its queries read. The last is declared and never written.
CATALOG = {"documents": ["doc_id", "text", "source"], "events": ["event_id", "user_id", "ts", "value", "channel"],
           "labels": ["doc_id", "quality", "toxic"], "lineitem": ["l_orderkey", "l_partkey"], "scrape_runs": ["run_id"]}


@query("catalog_check", "WITH want(table_name, column_name) AS (VALUES "
       + ", ".join(f"({sq(t)}, {sq(c)})" for t, cs in CATALOG.items() for c in cs) + """),
have AS (SELECT DISTINCT table_name FROM information_schema.columns),
lost AS (SELECT table_name, string_agg(column_name, ',') AS missing FROM want w
         WHERE NOT EXISTS (SELECT 1 FROM information_schema.columns c WHERE c.table_name = w.table_name AND c.column_name = w.column_name)
         GROUP BY table_name)
SELECT w.table_name, h.table_name IS NOT NULL AS present, CASE WHEN h.table_name IS NOT NULL THEN coalesce(l.missing, '') END AS missing_columns
FROM (SELECT DISTINCT table_name FROM want) w LEFT JOIN have h ON h.table_name = w.table_name LEFT JOIN lost l ON l.table_name = w.table_name
""")
def catalog_check(spark, sf_dir):
    """The registered tables against the expected ones."""
    register_views(spark, sf_dir)
    return so.catalog_check(spark, CATALOG)
