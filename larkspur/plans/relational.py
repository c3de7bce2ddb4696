"""Joins, aggregates, windows and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import aggregates, joins, selection, windows
from .common import day, money, table, total
from .registry import query


@query("""
SELECT r_name, n_name, c_mktsegment, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, count(*) AS n
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
GROUP BY ALL
""")
def star_left_join(spark, sf):
    li, o, c, n, r = (table(spark, sf, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    joined = li.join(o, li.l_orderkey == o.o_orderkey, "left").join(c, o.o_custkey == c.c_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    return joined.groupBy("r_name", "n_name", "c_mktsegment").agg(total("l_extendedprice", "revenue"), F.count("*").alias("n"))


@query("""
SELECT s_suppkey, count(*) AS parts, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
WHERE p_type = 'PROMO' GROUP BY s_suppkey
""")
def inner_join_composite(spark, sf):
    li = table(spark, sf, "lineitem").withColumnsRenamed({"l_suppkey": "s_suppkey", "l_partkey": "p_partkey"})
    joined = li.join(table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey").join(table(spark, sf, "part").where("p_type = 'PROMO'").select("p_partkey"), "p_partkey")
    return joined.groupBy("s_suppkey").agg(F.count("*").alias("parts"), total("l_quantity", "quantity"))


@query("""
SELECT n.n_nationkey, coalesce((SELECT string_agg(m.n_name, ',' ORDER BY m.n_name) FROM nation m WHERE m.n_regionkey = n.n_regionkey AND m.n_nationkey <> n.n_nationkey), '') AS others FROM nation n
""")
def lateral_job_sources(spark, sf):
    return joins.other_members(table(spark, sf, "nation"), "n_regionkey", "n_nationkey", "n_name").select("n_nationkey", "others")


@query("SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY w")
def explode_count(spark, sf):
    return table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("""
SELECT c_custkey, coalesce(w, '-') AS word FROM customer LEFT JOIN (SELECT c_custkey AS k, unnest(string_split(lower(c_mktsegment), 'i')) AS w FROM customer WHERE c_acctbal > 3000) ON k = c_custkey
""")
def explode_outer_count(spark, sf):
    parts = F.when(F.col("c_acctbal") > 3000, F.split(F.lower("c_mktsegment"), "i")).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "customer").select("c_custkey", F.explode_outer(parts).alias("w")).select("c_custkey", F.coalesce("w", F.lit("-")).alias("word"))


@query("""
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1
""")
def latest_per_key(spark, sf):
    return joins.latest_per_key(table(spark, sf, "events"), "user_id", "ts", "event_id", ["event_id", "event_type"])


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_exists(spark, sf):
    big = table(spark, sf, "orders").where("o_totalprice > 400000")
    return table(spark, sf, "customer").join(big, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_not_exists(spark, sf):
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, sf, "customer").join(urgent, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("""
SELECT 'with null' AS side, count(*) AS n FROM nation WHERE n_regionkey NOT IN (SELECT nullif(r_regionkey, 2) FROM region WHERE r_regionkey > 1)
UNION ALL SELECT 'without', count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey > 1)
""")
def not_in_null_aware(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region").where("r_regionkey > 1")
    parts = [("with null", region.select(F.nullif("r_regionkey", F.lit(2)).alias("k"))), ("without", region.select(F.col("r_regionkey").alias("k")))]
    out = [joins.not_in(nation, "n_regionkey", other, "k").agg(F.lit(side).alias("side"), F.count("*").alias("n")) for side, other in parts]
    return out[0].unionByName(out[1])


@query("""
SELECT doc_id FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1 OR length(text) < 30
""")
def oldest_of_group_anti(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.when(F.length("text") >= 30, F.sha1("text")).alias("duplicate_key"))
    return windows.oldest_of_group(docs, "duplicate_key", ["doc_id"]).select("doc_id")


@query("""
SELECT DISTINCT user_id, event_type FROM (SELECT user_id, event_type, min(ts) AS first_seen FROM events GROUP BY ALL) a
WHERE EXISTS (SELECT 1 FROM (SELECT user_id, min(ts) AS u FROM events GROUP BY user_id) b WHERE b.user_id = a.user_id AND b.u < a.first_seen - INTERVAL 14 HOURS)
""")
def gap_semi(spark, sf):
    firsts = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("first_seen"))
    return joins.after_gap(firsts, "user_id", "first_seen", "14 HOURS").select("user_id", "event_type")


@query("""
SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM (SELECT l_orderkey, min(l_shipdate) AS w, max(l_shipdate) AS f FROM lineitem GROUP BY 1) r
  WHERE r.l_orderkey = o_orderkey AND r.f > o_orderdate + INTERVAL 60 DAYS AND r.w <= o_orderdate + INTERVAL 400 DAYS)
""")
def temporal_coverage_semi(spark, sf):
    runs = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("window_start"), F.max("l_shipdate").alias("finished"))
    orders = table(spark, sf, "orders").withColumn("posted", F.col("o_orderdate") + F.expr("INTERVAL 400 DAYS"))
    return joins.covered_by_run(orders, runs, ["o_orderkey"], "o_orderdate", "posted", "finished", "window_start", "60 DAYS").select("o_orderkey")


@query("SELECT c_custkey FROM customer JOIN (VALUES (1, 'BUILDING'), (2, 'MACHINERY'), (7, 'HOUSEHOLD')) v(k, s) ON c_nationkey = k AND c_mktsegment = s")
def pair_list_join(spark, sf):
    return joins.join_pairs(table(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"], [(1, "BUILDING"), (2, "MACHINERY"), (7, "HOUSEHOLD"), (1, "BUILDING")]).select("c_custkey")


@query("""
WITH s AS (SELECT DISTINCT user_id, CAST(floor(epoch(ts) / 1800) * 1800 AS BIGINT) AS s FROM events WHERE event_type <> 'error'),
b AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events WHERE event_type = 'error')
SELECT user_id, s AS start FROM s WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.user_id = s.user_id AND s.s < b.s + 7200 AND b.s < s.s + 1800)
""")
def busy_overlap_anti(spark, sf):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    events = table(spark, sf, "events").select("user_id", "event_type", F.floor(at).alias("sec"))
    start = (F.floor(F.col("sec") / 1800) * 1800).alias("start")
    slots = events.where("event_type <> 'error'").select("user_id", start).distinct().withColumn("stop", F.col("start") + 1800)
    busy = events.where("event_type = 'error'").select("user_id", F.col("sec").alias("start"), (F.col("sec") + 7200).alias("stop"))
    return joins.free_of_overlap(slots, busy, "user_id", "start", "stop").select("user_id", "start")


@query("""
WITH RECURSIVE p AS (SELECT o_orderkey AS node, max(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS target FROM orders),
c AS (SELECT node, target FROM p WHERE target IS NOT NULL UNION ALL SELECT c.node, p.target FROM c JOIN p ON c.target = p.node WHERE p.target IS NOT NULL)
SELECT node, min(target) AS target FROM c GROUP BY 1
""")
def canonical_chase(spark, sf):
    """Each order to the first of its customer, along pointers to the order before it."""
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return joins.chase(table(spark, sf, "orders").select(F.col("o_orderkey").alias("node"), before.alias("target")), "node", "target")


@query("""
WITH RECURSIVE p AS (SELECT * FROM (SELECT doc_id AS node, lag(doc_id) OVER (PARTITION BY text ORDER BY doc_id) AS target FROM documents WHERE text IS NOT NULL) WHERE target IS NOT NULL),
c AS (SELECT node, target FROM p UNION ALL SELECT c.node, p.target FROM c JOIN p ON c.target = p.node)
SELECT node, target FROM c WHERE target NOT IN (SELECT node FROM p)
""")
def canonical_chase_documents(spark, sf):
    """Each repeated document to the first of its text, along pointers to the copy before it."""
    rows = table(spark, sf, "documents").where(F.col("text").isNotNull()).select(F.col("doc_id").alias("node"), F.sha2("text", 256).alias("key"))
    before = F.lag("node").over(Window.partitionBy("key").orderBy("node"))
    return joins.chase(rows.select("node", before.alias("target")), "node", "target")


@query("""
SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_quantity > 25) AS big, count(*) FILTER (WHERE l_discount = 0) AS full_price, CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) AS tax FROM lineitem GROUP BY 1
""")
def cond_counts(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity") > 25).alias("big"), F.count_if(F.col("l_discount") == 0).alias("full_price"), total("l_tax", "tax"))


@query("""
SELECT event_type, count(*) AS rows, round(100.0 * count(*) FILTER (WHERE value > 10) / count(*), 1) AS paid, round(100.0 * count(*) FILTER (WHERE props LIKE '%1%') / count(*), 1) AS ones FROM events GROUP BY 1
""")
def coverage_rates(spark, sf):
    return aggregates.coverage(table(spark, sf, "events"), {"paid": F.col("value") > 10, "ones": F.col("props").contains("1")}, ["event_type"])


@query("SELECT count(DISTINCT (l_partkey, l_suppkey)) AS pairs, count(DISTINCT l_orderkey) AS orders FROM lineitem")
def distinct_pairs(spark, sf):
    return table(spark, sf, "lineitem").agg(F.count_distinct("l_partkey", "l_suppkey").alias("pairs"), F.count_distinct("l_orderkey").alias("orders"))


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) >= 20")
def dedup_then_count(spark, sf):
    return aggregates.distinct_then_count(table(spark, sf, "lineitem"), "l_suppkey", "l_partkey", "parts").where("parts >= 20")


@query("""
SELECT l_returnflag, l_linestatus, quantile_cont(l_extendedprice, 0.25) AS p25, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.75) AS p75 FROM lineitem GROUP BY ALL
""")
def percentiles_group(spark, sf):
    quartiles = selection.percentiles(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", (0.25, 0.5, 0.75))
    return quartiles.select("l_returnflag", "l_linestatus", *(F.col("p")[i].alias(n) for i, n in enumerate(("p25", "p50", "p75"))))


@query("""
SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn FROM events GROUP BY 1, 2) WHERE rn = 1
""")
def mode_group(spark, sf):
    return aggregates.top_value(table(spark, sf, "events"), ["user_id"], "event_type")


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_orderpriority LIMIT 1")
def most_frequent(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "o_orderpriority").limit(1)


@query("SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def array_agg_sorted(spark, sf):
    joined = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("nations"))


@query("SELECT c_nationkey, string_agg(seg, ' | ' ORDER BY seg) AS segments FROM (SELECT DISTINCT c_nationkey, c_mktsegment AS seg FROM customer) GROUP BY 1")
def string_agg_distinct(spark, sf):
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(F.array_join(F.sort_array(F.collect_set("c_mktsegment")), " | ").alias("segments"))


@query("SELECT r_name, string_agg(n_name || '=' || n_nationkey, ';' ORDER BY n_name) AS pairs FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def object_agg(spark, sf):
    joined = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    entries = F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey")))
    grouped = joined.groupBy("r_name").agg(entries.alias("m"))
    return grouped.select("r_name", F.array_join(F.transform(F.array_sort(F.map_keys("m")), lambda k: F.concat(k, F.lit("="), F.try_element_at("m", k).cast("string"))), ";").alias("pairs"))


@query("""
SELECT c_custkey, n_orders, n_urgent FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_urgent FROM orders GROUP BY 1) ON o_custkey = c_custkey
""")
def lateral_aggregate(spark, sf):
    counts = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_urgent"))
    return table(spark, sf, "customer").join(counts, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "n_orders", "n_urgent")


@query("""
SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 HAVING count(*) > (SELECT avg(n) FROM (SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey)))
""")
def semi_grouped_having(spark, sf):
    counts = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    busy = counts.join(F.broadcast(counts.agg(F.avg("n").alias("mean"))), F.col("n") > F.col("mean"))
    return table(spark, sf, "supplier").join(busy, "s_suppkey", "left_semi").select("s_suppkey")


@query("""
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY sha1(text) ORDER BY n_chars DESC, source, doc_id) AS original FROM documents
""")
def elect_original(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars", F.sha1("text").alias("fingerprint"))
    return windows.elect(docs, ["fingerprint"], [F.col("n_chars").desc(), F.col("source"), F.col("doc_id")], "original", "doc_id").select("doc_id", "original")


@query("""
SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn = 1
""")
def best_record(spark, sf):
    return windows.top_per_group(table(spark, sf, "part"), ["p_brand"], [F.col("p_size").desc(), F.col("p_retailprice").desc(), F.col("p_partkey")], 1).select("p_brand", "p_partkey")


@query("""
SELECT c_custkey, turn, row_number() OVER (PARTITION BY c_nationkey, turn ORDER BY c_mktsegment, c_custkey) AS lap
FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS turn FROM customer)
""")
def round_robin_country(spark, sf):
    return windows.round_robin(table(spark, sf, "customer"), "c_nationkey", "c_mktsegment", [F.col("c_custkey")]).select("c_custkey", "turn", "lap")


@query("""
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY lang ORDER BY (source = 'src3') DESC, n_chars DESC, doc_id) AS head FROM documents
""")
def first_value_head(spark, sf):
    # the head of each group by one aggregate, then a join: no group is sorted in one task
    best = table(spark, sf, "documents").groupBy("lang").agg(F.max_by("doc_id", F.struct(F.col("source") == "src3", "n_chars", -F.col("doc_id"))).alias("head"))
    return table(spark, sf, "documents").select("doc_id", "lang").join(best, "lang").select("doc_id", "head")


@query("""
SELECT c_nationkey, c_mktsegment, n, round(n / sum(n) OVER (PARTITION BY c_nationkey), 6) AS share FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)
""")
def share_window(spark, sf):
    return windows.shares(table(spark, sf, "customer"), ["c_nationkey"], "c_mktsegment").select("c_nationkey", "c_mktsegment", "n", F.round("share", 6).alias("share"))


@query("SELECT c_name AS k, 'customer' AS origin FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_name, 'supplier' FROM supplier WHERE s_acctbal > 9000")
def union_two_keys(spark, sf):
    a = table(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_name").alias("k"), F.lit("customer").alias("origin"))
    return a.unionByName(table(spark, sf, "supplier").where("s_acctbal > 9000").select(F.col("s_name").alias("k"), F.lit("supplier").alias("origin")))


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9500 INTERSECT SELECT s_nationkey FROM supplier")
def intersect_domains(spark, sf):
    return table(spark, sf, "customer").where("c_acctbal > 9500").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf, "supplier").select("s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def except_vanished(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("k")).subtract(table(spark, sf, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def select_distinct(spark, sf):
    return table(spark, sf, "customer").select("c_mktsegment", "c_nationkey").distinct()


@query("""
SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))) AS DOUBLE) AS revenue, count(*) AS n, strftime(max(l_shipdate), '%Y-%m-%d') AS last_ship
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL
""")
def pricing_summary(spark, sf):
    rows = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp_ntz"))
    revenue = F.sum(money("l_extendedprice") * (F.lit(1).cast("decimal(18,2)") - money("l_discount"))).cast("double")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(total("l_quantity", "sum_qty"), total("l_extendedprice", "sum_price"), revenue.alias("revenue"), F.count("*").alias("n"), F.max("l_shipdate").alias("m")).select("l_returnflag", "l_linestatus", "sum_qty", "sum_price", "revenue", "n", day("m", "last_ship"))
