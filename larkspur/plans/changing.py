"""Lifecycle queries: merges, expiry, retention, rollups, memories and their signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates, lifecycle, signals
from .common import day, money, table
from .registry import query


def at(text):
    return F.lit(text).cast("timestamp_ntz")


@query("""
WITH s AS (SELECT o_orderkey, o_orderstatus, o_totalprice, nullif(o_orderpriority, '5-LOW') AS note FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'),
b AS (SELECT o_orderkey, 'N' AS o_orderstatus, CASE WHEN o_custkey % 2 = 0 THEN NULL ELSE o_totalprice + 1 END AS o_totalprice, 'again' AS note FROM orders WHERE o_orderdate >= TIMESTAMP '1999-06-01')
SELECT coalesce(s.o_orderkey, b.o_orderkey) AS o_orderkey, coalesce(b.o_orderstatus, s.o_orderstatus) AS o_orderstatus, CASE WHEN b.o_orderkey IS NOT NULL THEN b.o_totalprice ELSE s.o_totalprice END AS o_totalprice, coalesce(s.note, b.note) AS note, s.o_orderkey IS NULL AS is_new
FROM s FULL JOIN b ON s.o_orderkey = b.o_orderkey
""")
def merge_upsert(spark, sf):
    orders = table(spark, sf, "orders")
    snapshot = orders.where(F.col("o_orderdate") < at("2000-01-01")).select("o_orderkey", "o_orderstatus", "o_totalprice", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("note"))
    price = F.when(F.col("o_custkey") % 2 != 0, F.col("o_totalprice") + 1)
    batch = orders.where(F.col("o_orderdate") >= at("1999-06-01")).select("o_orderkey", F.lit("N").alias("o_orderstatus"), price.alias("o_totalprice"), F.lit("again").alias("note"))
    return lifecycle.merge(snapshot, batch, ["o_orderkey"], {"o_totalprice": "replace", "note": "old"})


@query("SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer WHERE c_acctbal > 9900")
def insert_do_nothing(spark, sf):
    keys = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")).distinct()
    return lifecycle.append_new(keys, table(spark, sf, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("k")), ["k"])


@query("SELECT c_custkey, CASE WHEN n > 12 THEN 'busy' ELSE c_mktsegment END AS c_mktsegment FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def update_from_join(spark, sf):
    busy = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n")).where("n > 12").select("c_custkey", F.lit("busy").alias("c_mktsegment"))
    return lifecycle.update_from(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), busy, ["c_custkey"], ["c_mktsegment"])


@query("""
WITH l AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderdate, CASE WHEN o_orderstatus = 'F' THEN TIMESTAMP '2001-12-01' END AS expired FROM orders),
r AS (SELECT o_custkey, max(o_orderdate) AS ok_at, count(*) >= 5 AS complete FROM orders GROUP BY 1),
c AS (SELECT l.*, l.expired IS NULL AND coalesce(r.complete AND r.ok_at > l.o_orderdate + INTERVAL 1 YEAR, false) AS cand FROM l LEFT JOIN r ON r.o_custkey = l.o_custkey),
f AS (SELECT o_orderpriority FROM c WHERE expired IS NULL GROUP BY 1 HAVING count(*) FILTER (WHERE cand) >= 1400 AND count(*) FILTER (WHERE cand) > 0.7 * count(*))
SELECT o_orderkey, strftime(CASE WHEN cand AND o_orderpriority NOT IN (SELECT o_orderpriority FROM f) THEN TIMESTAMP '2002-01-01' ELSE expired END, '%Y-%m-%d') AS expired FROM c
""")
def expire_presence(spark, sf):
    orders = table(spark, sf, "orders")
    rows = orders.select("o_orderkey", "o_custkey", "o_orderpriority", (F.col("o_orderdate") + F.expr("INTERVAL 1 YEAR")).alias("seen"), F.when(F.col("o_orderstatus") == "F", at("2001-12-01")).alias("expired"))
    reads = orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("ok_at"), (F.count("*") >= 5).alias("complete"))
    return lifecycle.expire_absent(rows, "o_custkey", "o_orderpriority", "seen", "expired", reads, at("2002-01-01"), 1400, 0.7).select("o_orderkey", day("expired", "expired"))


@query("""
SELECT CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) THEN 'tombstone' ELSE 'deleted' END AS fate, count(*) AS n, count(CASE WHEN NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) THEN o_orderpriority END) AS texts
FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1
""")
def purge_tombstone(spark, sf):
    dead = table(spark, sf, "orders").where(F.col("o_orderdate") < at("1997-01-01"))
    refs = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    tombs, gone = lifecycle.retention(dead, refs, "o_orderkey", ["o_orderpriority"])
    both = tombs.withColumn("fate", F.lit("tombstone")).unionByName(gone.withColumn("fate", F.lit("deleted")))
    return both.groupBy("fate").agg(F.count("*").alias("n"), F.count("o_orderpriority").alias("texts"))


@query("SELECT o_orderstatus, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS price FROM orders GROUP BY 1, 2")
def month_rollup(spark, sf):
    orders = table(spark, sf, "orders")
    batches = [orders.where(F.col("o_orderdate") < at("1998-03-10")), orders.where(F.col("o_orderdate") >= at("1998-03-10"))]
    parts = [lifecycle.month_rollup(b, ["o_orderstatus"], "o_orderdate", {"price": money("o_totalprice")}) for b in batches]
    return aggregates.merge_partials(parts, ["o_orderstatus", "month"], ["n", "price"]).withColumn("price", F.col("price").cast("double"))


@query("SELECT p_partkey FROM part WHERE (p_brand, p_size) NOT IN (SELECT p_brand, p_size FROM part WHERE p_type = 'PROMO')")
def vanished_upstream(spark, sf):
    part = table(spark, sf, "part")
    return lifecycle.vanished(part, part.where("p_type = 'PROMO'"), ["p_brand", "p_size"]).select("p_partkey")


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' AND regexp_matches(c_mktsegment, 'BUILD|FURN') AND NOT regexp_matches(c_mktsegment, 'FURN') THEN NULL ELSE o_orderpriority END AS label FROM orders JOIN customer ON o_custkey = c_custkey")
def distrusted_label(spark, sf):
    joined = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select("o_orderkey", lifecycle.distrusted(F.col("o_orderpriority"), "5-LOW", F.col("c_mktsegment"), "BUILD|FURN", "FURN").alias("label"))


MEMORY_SQL = "(SELECT user_id, event_type, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS mentions, count(*) FILTER (WHERE value > 20) AS mentions_title FROM events GROUP BY 1, 2)"


def skills(spark, sf):
    return signals.memory(table(spark, sf, "events"), ["user_id", "event_type"], "ts", F.col("value") > 20)


@query(f"SELECT user_id, event_type, strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen, mentions, mentions_title FROM {MEMORY_SQL}")
def skill_memory(spark, sf):
    """Memory of two readings (the first half of the time, then everything) merged."""
    events = table(spark, sf, "events")
    early = signals.memory(events.where(F.col("ts") < at("2024-01-16")), ["user_id", "event_type"], "ts", F.col("value") > 20)
    merged = signals.merge_memory(early, skills(spark, sf), ["user_id", "event_type"])
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return merged.select("user_id", "event_type", stamp("first_seen"), stamp("last_seen"), "mentions", "mentions_title")


@query(f"""
SELECT user_id, event_type, CASE WHEN (mentions_title >= 1 AND mentions >= 2) OR mentions >= 3 THEN 'high' WHEN mentions >= 2 OR mentions_title >= 1 THEN 'medium' ELSE 'low' END AS confidence FROM {MEMORY_SQL} m
WHERE first_seen >= TIMESTAMP '2024-01-02' AND EXISTS (SELECT 1 FROM events e WHERE e.user_id = m.user_id AND e.ts < m.first_seen - INTERVAL 12 HOURS)
""")
def skill_adopted_signal(spark, sf):
    return signals.adopted(skills(spark, sf), "user_id", at("2024-01-02"), "12 HOURS").select("user_id", "event_type", "confidence")


@query("""
SELECT o_custkey, l_suppkey FROM (SELECT o_custkey, l_suppkey, min(o_orderdate) AS f FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) a
WHERE f >= TIMESTAMP '2001-01-01' AND EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderdate < a.f - INTERVAL 14 DAYS AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = b.o_orderkey))
""")
def geo_expansion_signal(spark, sf):
    joined = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    pairs = signals.memory(joined, ["o_custkey", "l_suppkey"], "o_orderdate")
    return signals.adopted(pairs, "o_custkey", at("2001-01-01"), "14 DAYS").select("o_custkey", "l_suppkey")
