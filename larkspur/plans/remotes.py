"""Queries over the data sources of ``sources.remote``: ranged reads, pushed filters, cursors."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import functions as F

from ..sources import readers, remote, sinks
from .common import table
from .registry import query
from .streams import folder


@query("SELECT c_custkey, c_name, c_nationkey, CAST(c_acctbal AS DOUBLE) AS c_acctbal FROM customer")
def store_zip_members(spark, sf):
    """Customers written as ZIP files with a member a nation, and read back, a task a member."""
    place = folder(spark)
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    written = sinks.zipped_members(rows, place, "c_nationkey").select("path").distinct()
    paths = ";".join(sorted(r.path for r in written.collect()))  # as many as there were tasks
    return readers.zipped_csv(spark, paths, "c_custkey long, c_name string, c_nationkey int, c_acctbal double").withColumn("c_nationkey", F.col("c_nationkey").cast(rows.schema["c_nationkey"].dataType))


@query("SELECT o_orderpriority, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders WHERE o_totalprice > 100000 AND o_orderstatus IN ('F', 'P') AND o_orderkey % 3 = 0 GROUP BY 1")
def remote_filters(spark, sf):
    """Two filters reach the row groups, the third stays with Spark; four columns are read."""
    remote.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    wanted = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority").schema
    rows = spark.read.format("remote_parquet").schema(wanted).load(f"{sf}/orders.parquet")
    rows = rows.where("o_totalprice > 100000 AND o_orderstatus IN ('F', 'P') AND o_orderkey % 3 = 0")
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


CHANGE_RUNS = ("1995-01-01", "1996-06-30", "1998-12-31")


@query(f"""
WITH o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS TIMESTAMP) AS opened, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 90 DAYS END AS closed FROM orders),
r AS (SELECT * FROM (VALUES (TIMESTAMP '1994-12-31', TIMESTAMP '{CHANGE_RUNS[0]}'), (TIMESTAMP '{CHANGE_RUNS[0]}', TIMESTAMP '{CHANGE_RUNS[1]}'), (TIMESTAMP '{CHANGE_RUNS[1]}', TIMESTAMP '{CHANGE_RUNS[2]}')) t(low, high))
SELECT 'new' AS event, id, strftime(opened, '%Y-%m-%d') AS day FROM o JOIN r ON opened > low AND opened <= high WHERE closed IS NULL OR closed > high
UNION ALL SELECT 'closed', id, strftime(closed, '%Y-%m-%d') FROM o JOIN r ON closed > low AND closed <= high
""")
def stream_change_source(spark, sf):
    """Three runs of a change feed, each from the cursor of the one before; the first looks back a day."""
    remote.register(spark)
    place, clock = folder(spark), f"{folder(spark)}-clock"
    day = F.col("o_orderdate").cast("timestamp")
    records = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), day.alias("opened"), F.when(F.col("o_orderstatus") == "F", day + F.expr("INTERVAL 90 DAYS")).alias("closed"))
    records.write.parquet(f"{place}/records")
    options = {"path": f"{place}/records", "id": "id", "opened": "opened", "closed": "closed", "clock": clock}
    for now in CHANGE_RUNS:
        system, path = fs.FileSystem.from_uri(clock)
        with system.open_output_stream(path) as f:
            f.write(now.encode())
        changes = spark.readStream.format("changes").options(**options).load().select("event", "id", F.date_format("t", "yyyy-MM-dd").alias("day"))
        changes.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(changes.schema).parquet(f"{place}/out")
