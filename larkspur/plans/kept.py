"""What is stored between questions: inverted indexes, maintained views, table functions and named views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables
from ..operators import fulltext, maintained
from .common import table
from .registry import query
from .streams import folder

TOKENS = "regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+')"


@query(f"""
WITH q AS (SELECT item_id, list_filter({TOKENS.format("text")}, lambda x: x <> '')[:3] AS t FROM benchmark),
d AS (SELECT doc_id, {TOKENS.format("text")} AS w FROM documents)
SELECT item_id, doc_id FROM q JOIN d ON list_has_all(w, t)
""")
def fulltext_index(spark, sf):
    """The first three words of each benchmark item, asked of a stored index of all documents."""
    place = folder(spark)
    fulltext.build_index(table(spark, sf, "documents"), "doc_id", "text", place)
    first = F.array_join(F.slice(fulltext.words(F.col("text")), 1, 3), " ")
    questions = table(spark, sf, "benchmark").select("item_id", first.alias("question"))
    return fulltext.ask(spark, place, questions, "item_id", "question").select("item_id", F.col("id").alias("doc_id"))


@query("""
SELECT strftime(l_shipdate, '%Y-%m') AS month, l_returnflag, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem
WHERE NOT (l_orderkey % 5 = 0 AND l_shipdate < DATE '1995-01-01') AND (l_orderkey % 3 <> 0 OR l_shipdate >= DATE '1997-01-01') GROUP BY 1, 2
""")
def view_refreshed(spark, sf):
    """A view by month, kept through a batch that adds some rows and takes others back."""
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    rows = table(spark, sf, "lineitem").withColumn("month", F.date_format("l_shipdate", "yyyy-MM")).withColumn("price", price)
    late, gone = F.col("l_shipdate") >= F.lit("1997-01-01").cast("date"), (F.col("l_orderkey") % 5 == 0) & (F.col("l_shipdate") < F.lit("1995-01-01").cast("date"))
    third = F.col("l_orderkey") % 3 == 0
    keys, sums, path = ["month", "l_returnflag"], {"total": F.col("price")}, folder(spark)
    schema = maintained.partials(rows.limit(0), keys, sums, F.lit(1)).schema
    maintained.create_view(rows.where(~third), path, keys, sums, "month")
    maintained.refresh_view(path, schema, keys, sums, "month", rows.where(third & late & ~gone), rows.where(~third & gone))
    return maintained.read_view(spark, path, schema).withColumn("total", F.col("total").cast("double"))


@query("""
SELECT key, id, first AS duplicate_of FROM (SELECT sha256(text) AS key, doc_id AS id, first_value(doc_id) OVER (PARTITION BY sha256(text) ORDER BY source, doc_id) AS first FROM documents) WHERE id <> first
""")
def resolve_duplicates(spark, sf):
    """Documents of equal text, the first by source and id as the original, by a table function in SQL."""
    tables.register(spark)
    table(spark, sf, "documents").createOrReplaceTempView("duplicate_candidates")
    return spark.sql("""
        SELECT key, id, duplicate_of FROM resolve_duplicates(TABLE(SELECT sha2(text, 256) AS key, doc_id AS id, source FROM duplicate_candidates) PARTITION BY key ORDER BY (source, id))
    """)


@query("""
WITH s AS (SELECT event_type AS model, user_id AS id, count(*) AS score FROM events GROUP BY 1, 2),
ref AS (SELECT id FROM s WHERE model = 'click' ORDER BY score DESC, id LIMIT 20),
c AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, id) AS pos FROM s)
SELECT model, count(*) AS found, 20 AS "of", round(100.0 * count(*) / 20, 1) AS recall_pct FROM c JOIN ref USING (id) WHERE pos <= 30 GROUP BY 1
""")
def benchmark_recall(spark, sf):
    """Named views that need one another, given in any order, under a table function."""
    tables.register(spark)
    table(spark, sf, "events").createOrReplaceTempView("recall_events")
    tables.create_views(spark, {
        "recall_marked": "SELECT s.model, r.id IS NOT NULL AS wanted, n.size, s.score, s.id FROM recall_scores s LEFT JOIN recall_reference r ON r.id = s.id CROSS JOIN (SELECT count(*) AS size FROM recall_reference) n",
        "recall_reference": "SELECT id FROM recall_scores WHERE model = 'click' ORDER BY score DESC, id LIMIT 20",
        "recall_scores": "SELECT event_type AS model, user_id AS id, count(*) AS score FROM recall_events GROUP BY 1, 2",
    })
    return spark.sql("SELECT model, found, of, recall_pct FROM benchmark_recall(TABLE(recall_marked) PARTITION BY model ORDER BY (score DESC, id), 30)")
