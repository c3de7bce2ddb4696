"""Scans, filters, pages and searches over the listing index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, joins, paging, windows
from .common import POSTINGS_SQL, day, postings, table
from .registry import query

NEWEST = [("o_orderdate", True), ("o_orderkey", False)]


@query(f"""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS posted, c_custkey, n_name FROM (
  SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS rn FROM {POSTINGS_SQL}
  WHERE n_name = 'NATION_3' AND o_orderstatus <> 'P' AND (o_orderdate IS NULL OR o_orderdate <= TIMESTAMP '2001-01-01'))
WHERE rn <= 3 ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 100
""")
def search_diversity_cap(spark, sf):
    rows = postings(spark, sf).where(filters.equal_to({"n_name": "NATION_3", "c_mktsegment": None}) & (F.col("o_orderstatus") != "P"))
    rows = rows.where(filters.not_in_future("o_orderdate", F.lit("2001-01-01").cast("timestamp_ntz")))
    capped = windows.top_per_group(rows, ["c_custkey"], paging.order(NEWEST), 3)
    return capped.orderBy(*paging.order(NEWEST)).limit(100).select("o_orderkey", day("o_orderdate", "posted"), "c_custkey", "n_name")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS posted FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 21")
def keyset_page_1(spark, sf):
    return paging.page(table(spark, sf, "orders"), NEWEST, None, 20).select("o_orderkey", day("o_orderdate", "posted"))


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS posted FROM orders
WHERE o_orderdate < TIMESTAMP '1999-06-15' OR o_orderdate IS NULL OR (o_orderdate = TIMESTAMP '1999-06-15' AND o_orderkey > 500)
ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 51
""")
def keyset_page_2(spark, sf):
    cursor = paging.write_cursor(["1999-06-15 00:00:00", 500])
    return paging.page(table(spark, sf, "orders"), NEWEST, cursor, 50).select("o_orderkey", day("o_orderdate", "posted"))


@query("""
SELECT c_custkey, seg FROM (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer)
WHERE seg > 'MACHINERY' OR seg IS NULL OR (seg = 'MACHINERY' AND c_custkey > 100) ORDER BY seg ASC NULLS LAST, c_custkey LIMIT 501
""")
def keyset_nulls_last(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"))
    return paging.page(rows, [("seg", False), ("c_custkey", False)], paging.write_cursor(["MACHINERY", 100]), 900)


@query("""
SELECT c_custkey, CAST(size AS BIGINT) AS size FROM (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE floor(c_acctbal / 1000) END AS size FROM customer)
WHERE size < 5 OR size IS NULL OR (size = 5 AND c_custkey > 40) ORDER BY size DESC NULLS LAST, c_custkey LIMIT 201
""")
def keyset_by_size_desc(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.floor(F.col("c_acctbal") / 1000)).cast("long").alias("size"))
    return paging.page(rows, [("size", True), ("c_custkey", False)], paging.write_cursor([5, 40]), 200)


@query("""
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events
WHERE ts > TIMESTAMP '2024-01-10 00:00:00' ORDER BY ts, event_id LIMIT 101
""")
def changes_since(spark, sf):
    cursor = paging.write_cursor(["2024-01-10 00:00:00", 10**12])
    return paging.page(table(spark, sf, "events"), [("ts", False), ("event_id", False)], cursor, 100).select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("""
SELECT l.l_orderkey, CAST(l.l_linenumber AS BIGINT) AS line, l.l_partkey, l.l_suppkey, l.l_extendedprice FROM lineitem l
JOIN (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 40) t ON l.l_orderkey = t.o_orderkey
""")
def two_phase_topk(spark, sf):
    wide = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    top = paging.top_then_wide(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), wide, [("o_totalprice", True), ("o_orderkey", False)], "o_orderkey", 40)
    return top.select(F.col("o_orderkey").alias("l_orderkey"), F.col("l_linenumber").cast("long").alias("line"), "l_partkey", "l_suppkey", "l_extendedprice")


@query("SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#7' AND p_type = 'ECONOMY'")
def filter_multi(spark, sf):
    return table(spark, sf, "part").where(filters.equal_to({"p_brand": "Brand#7", "p_type": "ECONOMY", "p_size": None})).select("p_partkey", "p_name")


@query("SELECT count(*) AS n, CAST(sum(CASE WHEN remote = 'remote' THEN 1 ELSE 0 END) AS BIGINT) AS n_remote FROM (SELECT CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL WHEN c_mktsegment = 'HOUSEHOLD' THEN 'remote' ELSE 'onsite' END AS remote FROM customer) WHERE remote = 'remote' OR remote = 'onsite'")
def filter_work_mode(spark, sf):
    mode = F.when(F.col("c_mktsegment") == "MACHINERY", None).when(F.col("c_mktsegment") == "HOUSEHOLD", "remote").otherwise("onsite")
    rows = table(spark, sf, "customer").select(mode.alias("remote"))
    return rows.where(filters.work_mode("remote", True) | filters.work_mode("remote", "onsite")).agg(F.count("*").alias("n"), F.count_if(F.col("remote") == "remote").alias("n_remote"))


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name || '_100%') LIKE '%g!_100!%%' ESCAPE '!'")
def filter_ilike_escaped(spark, sf):
    return table(spark, sf, "part").where(filters.contains_ci(F.concat("p_name", F.lit("_100%")), "G_100%")).select("p_partkey", "p_name")


@query("SELECT p_partkey FROM part WHERE list_contains(string_split(lower(p_name), ' '), 'red')")
def filter_list_member_ci(spark, sf):
    return table(spark, sf, "part").where(filters.list_has_ci(F.split("p_name", " "), "RED")).select("p_partkey")


@query("""
SELECT p_partkey, string_agg(w, ',' ORDER BY i) AS found FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part)
WHERE contains(lower(w), 'ed') GROUP BY p_partkey
""")
def filter_list_substring(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", filters.list_matching(F.split("p_name", " "), "ED").alias("m"))
    return rows.where(F.size("m") > 0).select("p_partkey", F.array_join("m", ",").alias("found"))


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal >= 1000 AND s_acctbal <= 5000.5")
def filter_range(spark, sf):
    return table(spark, sf, "supplier").where(filters.between_open("s_acctbal", 1000, 5000.5)).select("s_suppkey", "s_acctbal")


@query("""
SELECT c_custkey FROM (SELECT c_custkey, c_nationkey, c_acctbal, nullif(c_mktsegment, 'FURNITURE') AS seg FROM customer)
WHERE (seg IS NULL OR seg IN ('BUILDING', 'MACHINERY')) AND (c_nationkey IS NULL OR c_nationkey IN (1, 2, 3, 4, 24)) AND (c_acctbal IS NULL OR (c_acctbal >= 100 AND c_acctbal <= 8000))
""")
def funnel_permissive_null(spark, sf):
    rows = table(spark, sf, "customer").withColumn("seg", F.nullif("c_mktsegment", F.lit("FURNITURE")))
    return filters.funnel(rows, {"seg": ["BUILDING"], "c_nationkey": [1, 2, 3, 4, 24], "c_name": []}, {"c_acctbal": (100, 8000)}, {"seg": ["MACHINERY"]}).select("c_custkey")


@query("""
SELECT doc_id FROM documents WHERE list_contains(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), 'the') AND list_contains(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), 'was')
""")
def fulltext_all_tokens(spark, sf):
    return table(spark, sf, "documents").where(filters.all_tokens(F.col("text"), "The  WAS!")).select("doc_id")


@query("""
SELECT conv_id, turn, CASE WHEN length(a) >= 80 THEN a WHEN length(b) >= 80 THEN b WHEN length(c) >= 80 THEN c END AS body
FROM (SELECT conv_id, turn, substr(text, 1, 60) AS a, substr(text, 1, 120) AS b, text || repeat('.', 80) AS c FROM conversations)
""")
def first_long_text(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.substring("text", 1, 60).alias("a"), F.substring("text", 1, 120).alias("b"), F.concat("text", F.repeat(F.lit("."), F.lit(80))).alias("c"))
    return rows.select("conv_id", "turn", filters.first_long([F.col("a"), F.col("b"), F.col("c")]).alias("body"))


@query("SELECT event_id FROM events WHERE json_extract(props, '$.k') IS NOT NULL AND event_type = 'error'")
def json_key_exists(spark, sf):
    rows = table(spark, sf, "events").where("event_type = 'error'")
    return rows.where(filters.json_has("props", "k") & filters.json_has_any("props", ["zz", "k"]) & ~filters.json_has("props", "zz")).select("event_id")


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, CAST(max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_max FROM events GROUP BY event_type")
def json_extract_agg(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(k).alias("k_sum"), F.max(k).alias("k_max"))


@query("SELECT n_nationkey, n_name FROM nation WHERE (CASE WHEN n_regionkey = 1 THEN NULL ELSE n_name END) IS DISTINCT FROM 'NATION_2'")
def null_safe_compare(spark, sf):
    name = F.when(F.col("n_regionkey") != 1, F.col("n_name"))
    return table(spark, sf, "nation").where(~name.eqNullSafe(F.lit("NATION_2"))).select("n_nationkey", "n_name")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-02-01' OR (o_orderdate = TIMESTAMP '1996-02-01' AND o_orderkey < 9000)")
def row_value_compare(spark, sf):
    test = filters.row_before([F.col("o_orderdate"), F.col("o_orderkey")], [F.lit("1996-02-01").cast("timestamp_ntz"), F.lit(9000).cast("long")])
    return table(spark, sf, "orders").where(test).select("o_orderkey")


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(lower(p_name), '\\b(red|small ring|gear)\\b')")
def regex_theta_semi(spark, sf):
    patterns = spark.createDataFrame([("red",), ("small ring",), ("gear",), (None,)], "pattern string")
    return joins.matches_pattern_table(table(spark, sf, "part"), F.lower("p_name"), patterns, "pattern").select("p_partkey", "p_name")
