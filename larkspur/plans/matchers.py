"""Matching of whole vocabularies and registries: one automaton for all labels, prefix indexes for names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import automaton, registry
from ..operators.entities import words_of
from .common import table
from .registry import query

UNWANTED = ("that", "para", "nicht", "der der", "les")
WORDS_SQL = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}+#]+'), lambda x: x <> '')"


@query(f"""
WITH b AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
v AS (SELECT 'item ' || item_id AS name, w[i] || ' ' || w[i + 1] AS label, NULL AS lang FROM (SELECT *, unnest(generate_series(1, len(w) - 1)) AS i FROM b)
  UNION SELECT 'item ' || item_id, w[i], ['de', 'en', 'es', 'fr'][item_id % 4 + 1] FROM (SELECT *, unnest(generate_series(1, len(w))) AS i FROM b) WHERE i % 3 = 1),
k AS (SELECT * FROM v WHERE length(label) BETWEEN 4 AND 60 AND label NOT IN {UNWANTED}),
l AS (SELECT label, lang, list(name) AS names FROM k GROUP BY ALL),
d AS (SELECT doc_id, lang, ' ' || array_to_string({WORDS_SQL}, ' ') || ' ' AS t FROM documents)
SELECT doc_id, array_to_string(list_sort(list_distinct(flatten(list(names))))[:25], ',') AS names FROM d JOIN l ON contains(t, ' ' || label || ' ') AND (l.lang IS NULL OR l.lang = d.lang) GROUP BY doc_id
""")
def label_automaton(spark, sf):
    """All runs of two words of the benchmark's items, and every third word in one language, as labels of the items."""
    items = table(spark, sf, "benchmark").select("item_id", F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("name"), words_of(F.col("text")).alias("w"))
    lang = F.get(F.array(*map(F.lit, ("de", "en", "es", "fr"))), (F.col("item_id") % 4).cast("int"))
    pairs = items.select("name", F.explode(automaton.label_pairs(F.col("w"))).alias("label"), F.lit(None).cast("string").alias("lang"), F.lit(True).alias("preferred"))
    single = items.select("name", F.posexplode("w").alias("i", "label"), lang.alias("lang")).select("name", "label", "lang", (F.col("i") % 3 == 0).alias("preferred"))
    found = automaton.label_names(table(spark, sf, "documents"), "doc_id", "text", "lang", pairs.unionByName(single), UNWANTED)
    return found.select("doc_id", F.array_join("names", ",").alias("names"))


@query("""
WITH own AS (SELECT p_partkey, lower(CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || ' ' || brand END) AS core FROM part LEFT JOIN (SELECT item_id, brand FROM items) ON item_id = p_partkey),
reg AS (SELECT item_id, name || ' ' || brand AS name, 1 AS rank FROM items WHERE size % 2 = 0 UNION ALL SELECT item_id, name, 2 FROM items WHERE size > 45 UNION ALL SELECT vendor_id, name, 0 FROM vendors),
k AS (SELECT *, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS key FROM reg),
m AS (SELECT own.p_partkey, k.*, CASE WHEN key = core THEN 0 WHEN starts_with(key, core || ' ') THEN 1 ELSE 2 END AS tier FROM own JOIN k ON length(key) >= 4 AND length(core) >= 4 AND (key = core OR starts_with(key, core || ' ') OR starts_with(core, key || ' ')))
SELECT p_partkey, how, item_id, name FROM (SELECT *, ['same', 'begins', 'within'][tier + 1] AS how, row_number() OVER (PARTITION BY p_partkey ORDER BY tier, CASE WHEN tier = 2 THEN -length(key) ELSE 0 END, rank, length(key), name, item_id) AS rn FROM m) WHERE rn = 1
""")
def registry_prefixes(spark, sf):
    """Names of parts, half of them with a brand, against the items' full and short names and the vendors'."""
    items = table(spark, sf, "items")
    branded = items.select(F.col("item_id").alias("p_partkey"), "brand")
    parts = table(spark, sf, "part").join(branded, "p_partkey", "left")
    own = parts.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" "), "brand")).alias("own"))
    entries = items.where("size % 2 = 0").select("item_id", F.concat("name", F.lit(" "), "brand").alias("name"), F.lit(1).alias("rank"))
    entries = entries.unionByName(items.where("size > 45").select("item_id", "name", F.lit(2).alias("rank")))
    entries = entries.unionByName(table(spark, sf, "vendors").select(F.col("vendor_id").alias("item_id"), "name", F.lit(0).alias("rank")))
    return registry.best_entries(own, "p_partkey", "own", entries, "item_id", "name", "rank")
