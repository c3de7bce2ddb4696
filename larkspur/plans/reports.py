"""Queues, priorities, cost and coverage reports, retention lists, evaluation of lists and of parsed values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curation, filters, windows
from .common import table
from .registry import query


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders")
def global_numbering(spark, sf):
    return windows.numbered(table(spark, sf, "orders"), [F.col("o_totalprice").desc(), F.col("o_orderkey")]).select("o_orderkey", "rn")


@query("""
SELECT o_orderkey FROM orders ORDER BY (o_orderstatus = 'P') DESC, (o_orderdate < TIMESTAMP '1996-01-01') DESC, (o_orderpriority = '1-URGENT') DESC, o_orderdate, o_orderkey LIMIT 100
""")
def priority_queue(spark, sf):
    """A top-k report: the next hundred of a queue."""
    old = F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")
    return table(spark, sf, "orders").orderBy((F.col("o_orderstatus") == "P").desc(), old.desc(), (F.col("o_orderpriority") == "1-URGENT").desc(), "o_orderdate", "o_orderkey").limit(100).select("o_orderkey")


@query("""
SELECT o_orderkey, r.rank AS rank FROM orders JOIN (VALUES ('1-URGENT', 1), ('2-HIGH', 2), ('3-MEDIUM', 3)) r(code, rank) ON o_orderpriority = r.code ORDER BY o_totalprice DESC NULLS LAST, r.rank, o_orderkey LIMIT 50
""")
def vocabulary_rank_topk(spark, sf):
    """A top-k report by value, then by a vocabulary's rank."""
    ranks = spark.createDataFrame([("1-URGENT", 1), ("2-HIGH", 2), ("3-MEDIUM", 3)], "o_orderpriority string, rank int")
    joined = table(spark, sf, "orders").join(F.broadcast(ranks), "o_orderpriority")
    return joined.orderBy(F.col("o_totalprice").desc_nulls_last(), "rank", "o_orderkey").limit(50).select("o_orderkey", "rank")


@query("""
SELECT m.model, count(e.event_id) AS calls, round(coalesce(sum(CAST(e.value AS DECIMAL(18,2))), 0) / 1000000 * max(m.price), 8) AS cost, round(100.0 * count(e.event_id) / nullif((SELECT count(*) FROM events), 0), 1) AS share
FROM (VALUES ('click', 2), ('view', 3), ('none', 5)) m(model, price) LEFT JOIN events e ON e.event_type = m.model GROUP BY 1
""")
def cost_percent_view(spark, sf):
    models = spark.createDataFrame([("click", 2), ("view", 3), ("none", 5)], "model string, price int")
    events = table(spark, sf, "events")
    spent = events.groupBy(F.col("event_type").alias("model")).agg(F.count("*").alias("calls"), F.sum(F.col("value").cast("decimal(18,2)")).alias("tokens"))
    joined = models.join(spent, "model", "left").crossJoin(F.broadcast(events.agg(F.count("*").alias("whole"))))
    cost = F.round(F.coalesce(F.col("tokens").cast("double"), F.lit(0.0)) / 1_000_000 * F.col("price"), 8)
    return joined.select("model", F.coalesce("calls", F.lit(0)).alias("calls"), cost.alias("cost"), F.round(F.lit(100.0) * F.coalesce("calls", F.lit(0)) / F.nullif("whole", F.lit(0)), 1).alias("share"))


@query("""
SELECT s.source, s.region, count(n.n_nationkey) AS nations FROM (SELECT 'a' AS source, 0 AS region UNION ALL SELECT 'b', 1 UNION ALL SELECT 'c', 9) s LEFT JOIN nation n ON n.n_regionkey = s.region GROUP BY 1, 2
""")
def constant_union_coverage(spark, sf):
    wanted = spark.createDataFrame([("a", 0), ("b", 1), ("c", 9)], "source string, region int")
    return wanted.join(table(spark, sf, "nation"), F.col("n_regionkey") == F.col("region"), "left").groupBy("source", "region").agg(F.count("n_nationkey").alias("nations"))


@query("SELECT c_custkey, 'inactive' AS reason FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'no orders' FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2001-06-01')")
def retention_reasons(spark, sf):
    customer = table(spark, sf, "customer")
    recent = table(spark, sf, "orders").where(F.col("o_orderdate") >= F.lit("2001-06-01").cast("timestamp_ntz")).select(F.col("o_custkey").alias("c_custkey"))
    inactive = customer.where("c_acctbal < 0").select("c_custkey", F.lit("inactive").alias("reason"))
    return inactive.unionByName(customer.join(recent, "c_custkey", "left_anti").select("c_custkey", F.lit("no orders").alias("reason")))


@query("SELECT o_orderkey, CASE WHEN o_orderkey IN (1, 5, 7, 400) THEN 'removed' WHEN o_orderdate + INTERVAL 2000 DAYS < TIMESTAMP '2001-01-01' THEN 'expired' ELSE 'active' END AS status FROM orders")
def declared_expiry(spark, sf):
    gone = spark.createDataFrame([(1,), (5,), (7,), (400,), (-1,)], "o_orderkey long").withColumn("gone", F.lit(True))
    joined = table(spark, sf, "orders").join(F.broadcast(gone), "o_orderkey", "left")
    due = F.col("o_orderdate") + F.expr("INTERVAL 2000 DAYS") < F.lit("2001-01-01").cast("timestamp_ntz")
    return joined.select("o_orderkey", F.when(F.col("gone"), "removed").when(due, "expired").otherwise("active").alias("status"))


@query("""
WITH p AS (SELECT string_split(p_name, ' ') AS t, [lower(p_type), string_split(p_name, ' ')[1] || 'x'] AS g FROM part),
h AS (SELECT len(list_filter(g, lambda x: len(list_filter(t, lambda y: contains(lower(x), lower(y)) OR contains(lower(y), lower(x)))) > 0)) AS r, len(g) AS n, len(list_filter(t, lambda x: len(list_filter(g, lambda y: contains(lower(x), lower(y)) OR contains(lower(y), lower(x)))) > 0)) AS f, len(t) AS m FROM p)
SELECT round(sum(r) / sum(n), 4) AS precision, round(sum(f) / sum(m), 4) AS recall, round(2 * (sum(r) / sum(n)) * (sum(f) / sum(m)) / (sum(r) / sum(n) + sum(f) / sum(m)), 4) AS f1 FROM h
""")
def soft_match_f1(spark, sf):
    rows = table(spark, sf, "part").select(F.split("p_name", " ").alias("t"), F.array(F.lower("p_type"), F.concat(F.split("p_name", " ")[0], F.lit("x"))).alias("g"))
    return curation.soft_match(rows, "t", "g")


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'red|blue') THEN NULL ELSE 'onsite' END AS mode FROM part")
def onsite_by_absence(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.when(~F.col("p_name").rlike("red|blue"), "onsite").alias("mode"))


@query("""
SELECT c_nationkey, CASE WHEN p IS NULL THEN 'silent' WHEN abs(p - t) <= 0.01 THEN 'equal' WHEN p < t THEN 'low' ELSE 'high' END AS class, count(*) AS n FROM (
  SELECT c_nationkey, c_acctbal AS t, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL WHEN c_mktsegment = 'MACHINERY' THEN c_acctbal - 1 ELSE c_acctbal END AS p FROM customer) GROUP BY 1, 2
""")
def golden_disagreement(spark, sf):
    truth, parsed = F.col("c_acctbal"), F.when(F.col("c_mktsegment") == "MACHINERY", F.col("c_acctbal") - 1).when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal"))
    kind = F.when(parsed.isNull(), "silent").when(F.abs(parsed - truth) <= 0.01, "equal").when(parsed < truth, "low").otherwise("high")
    return table(spark, sf, "customer").groupBy("c_nationkey", kind.alias("class")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, count(*) AS n FROM orders WHERE list_contains(['1-URGENT', '2-HIGH'], o_orderpriority) AND NOT list_contains(['F'], o_orderstatus) GROUP BY 1")
def array_parameters(spark, sf):
    good = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & ~F.col("o_orderstatus").isin("F")
    return table(spark, sf, "orders").where(good).groupBy("o_orderkey").agg(F.count("*").alias("n"))


@query("""
SELECT event_id FROM events WHERE event_type = 'purchase' AND list_contains(list_transform(['Click', event_type], lambda x: lower(x)), 'purchase') AND user_id BETWEEN 10 AND 60
""")
def json_list_membership(spark, sf):
    rows = table(spark, sf, "events").withColumn("tags", F.to_json(F.array(F.lit("Click"), F.col("event_type"))))
    return rows.where(filters.json_list_has_ci("tags", "PURCHASE") & filters.between_open("user_id", 10, 60)).select("event_id")


@query("SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines, CASE WHEN lang = 'en' THEN 'GB' WHEN lang = 'de' THEN 'DE' END AS country FROM documents")
def code_lookup(spark, sf):
    codes = F.create_map(F.lit("en"), F.lit("GB"), F.lit("de"), F.lit("DE"))
    return table(spark, sf, "documents").select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("lines"), codes[F.col("lang")].alias("country"))
