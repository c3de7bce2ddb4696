"""Business aggregates: benchmarks, dominant values, medians, spines, freshness, funnels, alerts, recall."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates, joins, windows
from .common import money, postings, table
from .registry import query

CELLS_SQL = "(SELECT n_name AS country, c_mktsegment AS family, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS seniority, o_totalprice AS pay FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name < 'NATION_15')"


def cells(spark, sf):
    return postings(spark, sf).where("n_name < 'NATION_15'").select(F.col("n_name").alias("country"), F.col("c_mktsegment").alias("family"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("seniority"), F.col("o_totalprice").alias("pay"))


BENCHMARK_SQL = f"""
SELECT country, family, seniority, CAST(trunc(p25) AS BIGINT) AS p25, CAST(trunc(p50) AS BIGINT) AS p50, CAST(trunc(p75) AS BIGINT) AS p75, n FROM (
  SELECT *, row_number() OVER (PARTITION BY country, family, seniority ORDER BY pooled DESC) AS rn FROM (
    SELECT country, family, '' AS seniority, quantile_cont(pay, 0.25) AS p25, quantile_cont(pay, 0.5) AS p50, quantile_cont(pay, 0.75) AS p75, count(*) AS n, 1 AS pooled FROM {CELLS_SQL} GROUP BY country, family HAVING count(*) >= 60
    UNION ALL
    SELECT country, family, coalesce(seniority, ''), quantile_cont(pay, 0.25), quantile_cont(pay, 0.5), quantile_cont(pay, 0.75), count(*), 0 FROM {CELLS_SQL} GROUP BY country, family, seniority HAVING count(*) >= 12))
WHERE rn = 1
"""


@query(BENCHMARK_SQL)
def benchmark_cube_two_level(spark, sf):
    return aggregates.benchmark(cells(spark, sf), ["country", "family"], "seniority", "pay", 60, 12)


@query(f"""
WITH b AS ({BENCHMARK_SQL}) SELECT c.country, c.family, count(*) AS rows, CAST(sum(coalesce(s.p50, g.p50)) AS BIGINT) AS estimate, count(coalesce(s.p50, g.p50)) AS estimated
FROM {CELLS_SQL} c LEFT JOIN b s ON s.country = c.country AND s.family = c.family AND s.seniority = coalesce(c.seniority, '') LEFT JOIN b g ON g.country = c.country AND g.family = c.family AND g.seniority = '' GROUP BY 1, 2
""")
def benchmark_lookup_fallback(spark, sf):
    rows = cells(spark, sf)
    bench = aggregates.benchmark(rows, ["country", "family"], "seniority", "pay", 60, 12)
    return aggregates.with_estimate(rows, bench, ["country", "family"], "seniority", ["p50"]).groupBy("country", "family").agg(F.count("*").alias("rows"), F.sum("p50").alias("estimate"), F.count("p50").alias("estimated"))


@query("SELECT l_returnflag, CAST(sum(CASE l_linestatus WHEN 'O' THEN l_quantity * 2080 ELSE l_quantity * 12 END) AS BIGINT) AS yearly FROM lineitem GROUP BY 1")
def unit_normalised_sum(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("period", F.when(F.col("l_linestatus") == "O", "hour").otherwise("month"))
    return rows.groupBy("l_returnflag").agg(F.sum(aggregates.yearly(F.col("l_quantity"), F.col("period"))).cast("long").alias("yearly"))


@query("""
SELECT o_custkey, o_orderpriority, n, total FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS rn FROM (
  SELECT o_custkey, o_orderpriority, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY o_custkey) AS BIGINT) AS total FROM orders GROUP BY 1, 2) WHERE n >= 3 AND n >= 0.45 * total) WHERE rn = 1
""")
def dominant_category(spark, sf):
    return windows.dominant(table(spark, sf, "orders"), ["o_custkey"], "o_orderpriority", 0.45, 3).select("o_custkey", "o_orderpriority", "n", "total")


@query("SELECT l_suppkey, CAST(trunc(quantile_cont(m, 0.5)) AS BIGINT) AS median, count(*) AS votes FROM (SELECT l_suppkey, l_orderkey, max(l_quantity) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def median_of_max(spark, sf):
    return aggregates.median_of_maxima(table(spark, sf, "lineitem"), "l_suppkey", "l_orderkey", "l_quantity")


@query("""
SELECT l_returnflag, CAST(min(bucket) + 5.0 AS DOUBLE) AS median, max(total) AS total FROM (
  SELECT l_returnflag, bucket, CAST(sum(n) OVER (PARTITION BY l_returnflag ORDER BY bucket) AS BIGINT) AS run, CAST(sum(n) OVER (PARTITION BY l_returnflag) AS BIGINT) AS total
  FROM (SELECT l_returnflag, CAST(floor(l_quantity / 10) * 10 AS BIGINT) AS bucket, count(*) AS n FROM lineitem GROUP BY 1, 2)) WHERE total >= 100 AND run * 2 >= total GROUP BY 1
""")
def histogram_median(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy("l_returnflag", (F.floor(F.col("l_quantity") / 10) * 10).alias("bucket")).agg(F.count("*").alias("n"))
    return aggregates.histogram_median(counts, ["l_returnflag"], "bucket", "n", 10).select("l_returnflag", "median", "total")


@query("""
SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY n DESC, o_orderpriority) AS top, CAST(max(orders) AS BIGINT) AS orders, CAST(max(recent) AS BIGINT) AS recent FROM (
  SELECT o_custkey, o_orderpriority, n, orders, recent, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS rn FROM (
    SELECT o_custkey, o_orderpriority, count(*) AS n, sum(count(*)) OVER (PARTITION BY o_custkey) AS orders, sum(count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '2001-01-01')) OVER (PARTITION BY o_custkey) AS recent FROM orders GROUP BY 1, 2))
WHERE rn <= 3 GROUP BY 1
""")
def spine_topk_arrays(spark, sf):
    orders = table(spark, sf, "orders")
    facts = orders.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz")).alias("recent"))
    return aggregates.top_values(orders, ["o_custkey"], "o_orderpriority", 3).join(facts, "o_custkey")


@query("""
SELECT s_nationkey, w AS technology, count(*) AS jobs, count(*) FILTER (WHERE l_linestatus = 'O') AS active, strftime(min(l_shipdate), '%Y-%m-%d') AS first_at, strftime(max(l_shipdate), '%Y-%m-%d') AS last_at
FROM (SELECT s_nationkey, unnest(string_split(p_name, ' ')) AS w, l_linestatus, l_shipdate FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey) GROUP BY 1, 2
""")
def technology_memory(spark, sf):
    li = table(spark, sf, "lineitem")
    joined = li.join(table(spark, sf, "part"), li.l_partkey == F.col("p_partkey")).join(table(spark, sf, "supplier"), li.l_suppkey == F.col("s_suppkey"))
    rows = joined.select("s_nationkey", F.explode(F.split("p_name", " ")).alias("technology"), "l_linestatus", "l_shipdate")
    dates = lambda f, name: F.date_format(f("l_shipdate"), "yyyy-MM-dd").alias(name)
    return rows.groupBy("s_nationkey", "technology").agg(F.count("*").alias("jobs"), F.count_if(F.col("l_linestatus") == "O").alias("active"), dates(F.min, "first_at"), dates(F.max, "last_at"))


@query("""
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2
""")
def daily_counts_by_source(spark, sf):
    return table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"), F.sum(money("value")).cast("double").alias("total"))


@query("""
WITH e AS (SELECT epoch(TIMESTAMP '2024-01-31' - ts) / 3600.0 AS age FROM events WHERE event_type <> 'view' UNION ALL SELECT NULL FROM events WHERE event_type = 'view')
SELECT count(*) FILTER (WHERE age <= 24) AS day, count(*) FILTER (WHERE age > 24 AND age <= 168) AS week, count(*) FILTER (WHERE age > 168 AND age <= 360) AS half_month, count(*) FILTER (WHERE age > 360) AS older, count(*) FILTER (WHERE age IS NULL) AS unknown FROM e
""")
def freshness_buckets(spark, sf):
    now = F.lit("2024-01-31").cast("timestamp")
    age = F.when(F.col("event_type") != "view", (F.unix_micros(now) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3.6e9)
    return table(spark, sf, "events").withColumn("age", age).agg(*aggregates.age_buckets(F.col("age"), {"day": 24, "week": 168, "half_month": 360}))


@query("""
SELECT 1 AS step, 'all' AS stage, count(*) AS n FROM customer UNION ALL SELECT 2, 'with orders', count(DISTINCT o_custkey) FROM orders
UNION ALL SELECT 3, 'urgent', count(DISTINCT o_custkey) FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 4, 'large', count(DISTINCT o_custkey) FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000
""")
def funnel_stages(spark, sf):
    urgent = F.col("o_orderpriority") == "1-URGENT"
    per = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max(urgent).alias("u"), F.max(urgent & (F.col("o_totalprice") > 400000)).alias("l"))
    counts = per.agg(F.count("*").alias("a"), F.count_if("u").alias("b"), F.count_if("l").alias("c"))
    stages = counts.select(F.explode(F.array(*(F.struct(F.lit(i).alias("step"), F.lit(s).alias("stage"), F.col(c).alias("n")) for i, s, c in ((2, "with orders", "a"), (3, "urgent", "b"), (4, "large", "c"))))).alias("s")).select("s.*")
    return table(spark, sf, "customer").agg(F.lit(1).alias("step"), F.lit("all").alias("stage"), F.count("*").alias("n")).unionByName(stages)


@query("""
SELECT user_id, n, errors FROM (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1) WHERE errors > 0.25 * n AND n >= 20
""")
def anomaly_ratio(spark, sf):
    counts = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return counts.where((F.col("errors") > 0.25 * F.col("n")) & (F.col("n") >= 20))


@query("""
SELECT o_orderpriority, rows, candidates, (candidates >= 500 AND candidates > 0.3 * rows) AS refused FROM (
  SELECT o_orderpriority, count(*) AS rows, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '2000-09-01') AS candidates FROM orders GROUP BY 1)
""")
def breaker_refused(spark, sf):
    return aggregates.breaker(table(spark, sf, "orders"), "o_orderpriority", (F.col("o_orderstatus") == "F") & (F.col("o_orderdate") < F.lit("2000-09-01").cast("timestamp_ntz")))


@query("""
WITH s AS (SELECT label, vec_id, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS a, CAST(embedding[1] AS DOUBLE) AS b FROM embeddings),
r AS (SELECT label, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY a DESC, vec_id) AS rn FROM s) WHERE rn <= 20),
o AS (SELECT label, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY b DESC, vec_id) AS rn FROM s) WHERE rn <= 30)
SELECT r.label, count(*) AS n, count(o.vec_id) AS found, round(count(o.vec_id) / count(*), 4) AS recall FROM r LEFT JOIN o ON o.label = r.label AND o.vec_id = r.vec_id GROUP BY 1
""")
def recall_at_k(spark, sf):
    rows = table(spark, sf, "embeddings")
    whole = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return aggregates.recall_at(rows.select("label", "vec_id", whole.alias("score")), rows.select("label", "vec_id", F.col("embedding")[0].cast("double").alias("score")), "label", "vec_id", "score")


@query("""
WITH q AS (SELECT vec_id AS q, embedding AS qe FROM embeddings WHERE vec_id % 20 = 0),
d AS (SELECT q, vec_id, list_sum(list_transform(list_zip(qe, embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) / sqrt(list_sum(list_transform(qe, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS s FROM q, embeddings WHERE vec_id <> q)
SELECT q, vec_id, rn FROM (SELECT q, vec_id, row_number() OVER (PARTITION BY q ORDER BY s DESC, vec_id) AS rn FROM d) WHERE rn <= 10
""")
def cosine_topk(spark, sf):
    """Ten nearest vectors of every row whose id is divisible by 20, against all rows, in bounded blocks."""
    near = joins.nearest(table(spark, sf, "embeddings"), "vec_id", "embedding", 10, F.col("vec_id") % 20 == 0)
    return near.select(F.col("vec_id").alias("q"), F.col("near_id").alias("vec_id"), "rn")


@query("""
WITH d AS (SELECT a.vec_id AS q, b.vec_id, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) / sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) / sqrt(list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS s FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id)
SELECT q, vec_id, rn FROM (SELECT q, vec_id, row_number() OVER (PARTITION BY q ORDER BY s DESC, vec_id) AS rn FROM d) WHERE rn <= 10
""")
def cosine_topk_all(spark, sf):
    """Ten nearest vectors of every row against all rows, in bounded blocks."""
    return joins.nearest(table(spark, sf, "embeddings"), "vec_id", "embedding", 10).select(F.col("vec_id").alias("q"), F.col("near_id").alias("vec_id"), "rn")


@query("""
SELECT user_id, CAST(sum(CASE WHEN date_trunc('month', ts) < TIMESTAMP '2024-01-01' OR event_type = 'view' THEN 0 ELSE 1 END) AS BIGINT) AS used, round(sum(CAST(value AS DECIMAL(18,2))) / nullif(count(*), 0), 4) AS mean_value FROM events GROUP BY 1
""")
def credit_accounting(spark, sf):
    stale = (F.date_trunc("month", "ts") < F.lit("2024-01-01").cast("timestamp")) | (F.col("event_type") == "view")
    return table(spark, sf, "events").groupBy("user_id").agg(F.sum(F.when(stale, 0).otherwise(1)).alias("used"), F.round(F.sum(money("value")).cast("double") / F.nullif(F.count("*"), F.lit(0)), 4).alias("mean_value"))
