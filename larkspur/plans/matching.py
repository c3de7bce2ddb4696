"""Dictionary, label and key matching, entity resolution and record enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import enrich
from ..operators import entities
from .common import table
from .registry import query


@query("""
WITH w AS (SELECT p_partkey, p_name, unnest(string_split(p_name, ' ')) AS word FROM part), d(word, family) AS (VALUES ('red', 'colour'), ('small', 'size'), ('gear', 'metal'), ('widget', 'thing')),
m AS (SELECT w.p_partkey, w.p_name, d.word, d.family, row_number() OVER (PARTITION BY p_partkey ORDER BY length(d.word) DESC, d.word) AS rn FROM w JOIN d ON d.word = w.word)
SELECT p_partkey, family, round(least(length(word) / length(p_name) + 0.3, 0.95), 4) AS confidence FROM m WHERE rn = 1
""")
def dictionary_classifier(spark, sf):
    words = spark.createDataFrame([("red", "colour"), ("small", "size"), ("gear", "metal"), ("widget", "thing")], "word string, family string")
    return entities.classify(table(spark, sf, "part"), "p_partkey", "p_name", words)


@query("""
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}+#]+'), lambda x: x IN ('the', 'was', 'les', 'und')))), ',') AS labels FROM documents
WHERE len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}+#]+'), lambda x: x IN ('the', 'was', 'les', 'und'))) > 0
""")
def label_matcher(spark, sf):
    vocabulary = spark.createDataFrame([("the",), ("was",), ("les",), ("und",), ("of",)], "label string")
    return entities.labels(table(spark, sf, "documents"), "doc_id", "text", vocabulary, "label", ["of"]).select("doc_id", F.array_join("labels", ",").alias("labels"))


@query("""
WITH c AS (SELECT c_nationkey, c_custkey, c_nationkey || ':' || CASE WHEN c_acctbal > 5000 THEN lower(c_mktsegment) ELSE c_mktsegment END AS seg FROM customer)
SELECT c_nationkey, kept, count(*) AS n FROM (SELECT c_nationkey, first_value(seg) OVER (PARTITION BY lower(seg) ORDER BY c_custkey) AS kept, lower(seg) AS l FROM c)
WHERE l IN (SELECT lower(seg) FROM c GROUP BY 1 HAVING count(DISTINCT seg) > 1) GROUP BY 1, 2
""")
def case_variants(spark, sf):
    """Case variants of the segments of each nation."""
    seg = F.when(F.col("c_acctbal") > 5000, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    rows = table(spark, sf, "customer").withColumn("seg", F.concat_ws(":", "c_nationkey", seg))
    return entities.case_variants(rows, "seg", [F.col("c_custkey")]).groupBy("c_nationkey", "kept").agg(F.count("*").alias("n"))


@query("""
WITH c AS (SELECT c_nationkey, c_custkey, CASE WHEN c_acctbal > 5000 THEN lower(c_mktsegment) ELSE c_mktsegment END AS seg FROM customer)
SELECT c_nationkey, kept, count(*) AS n FROM (SELECT c_nationkey, first_value(seg) OVER (PARTITION BY lower(seg) ORDER BY c_custkey) AS kept, lower(seg) AS l FROM c)
WHERE l IN (SELECT lower(seg) FROM c GROUP BY 1 HAVING count(DISTINCT seg) > 1) GROUP BY 1, 2
""")
def case_variants_all(spark, sf):
    """Case variants over all customers."""
    rows = table(spark, sf, "customer").withColumn("seg", F.when(F.col("c_acctbal") > 5000, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")))
    return entities.case_variants(rows, "seg", [F.col("c_custkey")]).groupBy("c_nationkey", "kept").agg(F.count("*").alias("n"))


@query("SELECT host, count(DISTINCT page_id) AS companies FROM (SELECT page_id, regexp_replace(regexp_extract(url, '^https?://([^/?#:]+)', 1), '^www\\.', '') AS host FROM pages) GROUP BY 1 HAVING count(DISTINCT page_id) >= 3")
def shared_domains(spark, sf):
    from ..functions.text import domain

    return entities.shared_domains(table(spark, sf, "pages").select("page_id", domain(F.col("url")).alias("host")), "host", "page_id", 3)


@query("""
SELECT s_suppkey, p_partkey FROM supplier LEFT JOIN (SELECT p_size, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY (p_type = 'PROMO')::INT + (p_brand < 'Brand#2')::INT DESC, p_partkey) AS rn FROM part) WHERE rn = 1) ON p_size = s_nationkey
""")
def record_linkage(spark, sf):
    own = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"))
    ext = table(spark, sf, "part").select(F.col("p_size").alias("k"), "p_partkey", F.when(F.col("p_type") == "PROMO", 1).alias("a"), F.when(F.col("p_brand") < "Brand#2", 1).alias("b"))
    return entities.link_records(own, ext, "k", ["a", "b"], [F.col("p_partkey")]).select("s_suppkey", "p_partkey")


@query("""
WITH h AS (SELECT doc_id, text, first_value(doc_id) OVER (PARTITION BY sha1(text) ORDER BY doc_id) AS head FROM documents) SELECT doc_id, length(text) AS answer FROM h
""")
def twins_cache(spark, sf):
    done = entities.once_per_text(table(spark, sf, "documents").select("doc_id", "text"), "text", lambda d: d.select("text_hash", F.length("text").cast("long").alias("answer")))
    return done.select("doc_id", "answer")


@query("SELECT o_orderkey, CASE WHEN substr(o_orderpriority, 1, 1) = '1' THEN 'top' WHEN o_orderpriority LIKE '2-%' THEN 'second' END AS grade FROM orders")
def official_codes(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", enrich.by_prefix(F.col("o_orderpriority"), {"1": "top", "2-": "second"}).alias("grade"))


@query("""
SELECT event_id, CASE WHEN m THEN CASE WHEN k BETWEEN 13 AND 31 OR k = 1 THEN strftime(make_date(2024, 1, k), '%Y-%m-%d') END ELSE CASE WHEN k BETWEEN 1 AND 12 THEN strftime(make_date(2024, k, 25), '%Y-%m-%d') END END AS day
FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 35 AS k, event_id % 2 = 0 AS m FROM events)
""")
def ambiguous_dates(spark, sf):
    """Days of January and 25ths of months, in both orders, with numbers that are no day or month among them."""
    k, other = (F.get_json_object("props", "$.k").cast("long") % 35).cast("string"), F.col("event_id") % 2 == 0
    text = F.when(other, F.concat(k, F.lit("/01/2024"))).otherwise(F.concat(k, F.lit("-25-2024")))
    return table(spark, sf, "events").select("event_id", F.date_format(enrich.unsure_date(text), "yyyy-MM-dd").alias("day"))


@query("SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS key FROM customer")
def registry_keys(spark, sf):
    """A name keeps its key whatever legal form it is written with."""
    forms = F.array(*map(F.lit, (" GmbH", " S.p.A.", ", Inc.", " Ltd", "", " s.r.l.", " & Co. KG", " B.V.")))
    return table(spark, sf, "customer").select("c_custkey", enrich.registry_key(F.concat("c_name", F.get(forms, (F.col("c_custkey") % 8).cast("int")))).alias("key"))


@query("""
WITH RECURSIVE k AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 <> 0 THEN 'd' || c_custkey % 40 END AS d, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment || c_nationkey END AS n FROM customer),
v AS (SELECT id, 'dom:' || d AS key, min(id) OVER (PARTITION BY d) AS head FROM k WHERE d IS NOT NULL UNION ALL SELECT id, 'nom:' || n, min(id) OVER (PARTITION BY n) FROM k WHERE n IS NOT NULL),
p AS (SELECT id AS node, arg_min(head, key) AS target FROM v WHERE head <> id GROUP BY 1),
c AS (SELECT id AS node, id AS target, 0 AS hop FROM k UNION ALL SELECT c.node, p.target, hop + 1 FROM c JOIN p ON p.node = c.target)
SELECT node AS c_custkey, arg_max(target, hop) AS canonical FROM c GROUP BY 1
""")
def canonical_companies(spark, sf):
    """Customers that share a domain or a name elect the smallest key; chains of both are followed."""
    rows = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.concat(F.lit("d"), (F.col("c_custkey") % 40).cast("string"))).alias("d"), F.when(F.col("c_custkey") % 5 != 0, F.concat("c_mktsegment", "c_nationkey")).alias("n"))
    return entities.canonical_companies(rows, "c_custkey", "d", "n", [F.col("c_custkey")]).select("c_custkey", "canonical")
