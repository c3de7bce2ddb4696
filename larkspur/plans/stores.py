"""Sources and sinks: each query writes whole tables to the shared folder, reads them back, and must find what SQL finds."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources import readers, sinks, store
from .common import day, table
from .registry import query


def folder(spark) -> str:
    return f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"


def listings(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"), F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.col("o_orderpriority")).alias("note"), F.array_compact(F.array(F.when(F.col("o_custkey") % 2 == 0, "even"))).alias("tags"))


@query("SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS note, CASE WHEN o_custkey % 2 = 0 THEN 'even' END AS tag, o_orderstatus <> 'P' AS has_status FROM orders")
def store_json_lines(spark, sf):
    """Sparse gzip JSON lines behind a pointer, read with types beside the verbatim line."""
    place = folder(spark)
    sinks.write_json_lines(listings(spark, sf), place, "listings-2024-05-01", "listings-latest")
    back = readers.json_lines(spark, store.read_text(spark, f"{place}/listings-latest"), "o_orderkey long, status string, note string, tags array<string>", partitions=8)
    return back.select("o_orderkey", "status", "note", F.get("tags", 0).alias("tag"), F.col("raw").contains('"status"').alias("has_status"))


@query("SELECT doc_id, length(text) AS n FROM documents")
def store_verbatim_lines(spark, sf):
    """JSON lines whose text holds quotes, breaks and any letters come back as they were."""
    place = folder(spark)
    sinks.write_json_lines(table(spark, sf, "documents").select("doc_id", "text"), place, "texts")
    back = readers.json_lines(spark, f"{place}/texts", "doc_id long, text string")
    return back.select("doc_id", F.length("text").cast("long").alias("n"))


@query("SELECT event_id FROM events WHERE event_id % 3 <> 0")
def store_tolerant_json(spark, sf):
    """Every third line is broken and left out."""
    place = folder(spark)
    line = F.when(F.col("event_id") % 3 == 0, F.lit('{"event_id": ')).otherwise(F.to_json(F.struct("event_id", "event_type")))
    table(spark, sf, "events").select(line.alias("value")).write.text(place)
    return readers.tolerant_json(spark, place, "event_id long, event_type string").select("event_id")


@query("SELECT c_custkey, c_name || CASE WHEN c_custkey % 5 = 0 THEN ', \"x\"' ELSE '' END AS name FROM customer")
def store_delimited(spark, sf):
    """CSV with quotes and separators inside values."""
    place = folder(spark)
    name = F.concat("c_name", F.when(F.col("c_custkey") % 5 == 0, ', "x"').otherwise(""))
    table(spark, sf, "customer").select("c_custkey", name.alias("name")).write.option("header", True).option("escape", '"').csv(place)
    return readers.delimited(spark, place, "c_custkey long, name string")


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def store_tsv(spark, sf):
    place = folder(spark)
    table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey").write.option("sep", "\t").csv(place)
    return readers.delimited(spark, place, "s_suppkey long, s_name string, s_nationkey int", "\t", header=False)


@query("SELECT o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def store_parquet_partitioned(spark, sf):
    """Compressed Parquet by a key; a filter on the key opens its files only."""
    place = folder(spark)
    sinks.write_parquet(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), place, ["o_orderstatus"])
    return spark.read.parquet(place).where("o_orderstatus = 'F'").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(DISTINCT o_orderkey) AS orders, count(l_linenumber) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1")
def store_monthly_archive(spark, sf):
    """Ended orders and their lines by month, counted again from the files."""
    place = folder(spark)
    orders = table(spark, sf, "orders").withColumn("ended", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    sinks.archive_months(orders, {"lines": lines}, "o_orderkey", "ended", place)
    both = spark.read.parquet(f"{place}/parents").select("o_orderkey", "month").join(spark.read.parquet(f"{place}/lines").groupBy("o_orderkey").agg(F.count("*").alias("n")), "o_orderkey", "left")
    return both.groupBy(F.date_format(F.to_date(F.col("month").cast("string"), "yyyy-MM"), "yyyy-MM").alias("month")).agg(F.count("*").alias("orders"), F.coalesce(F.sum("n"), F.lit(0)).alias("lines"))


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500")
def store_capped_export(spark, sf):
    """An export with its cap: at most five hundred rows in order."""
    place = folder(spark)
    sinks.export(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), place, 500, [F.col("o_totalprice").desc(), F.col("o_orderkey")])
    return readers.json_lines(spark, place, "o_orderkey long").select("o_orderkey")


@query("SELECT n_nationkey, n_name FROM nation")
def store_snapshot(spark, sf):
    """A second version takes the place of the first; readers follow the pointer."""
    place, nation = folder(spark), table(spark, sf, "nation").select("n_nationkey", "n_name")
    sinks.swap_snapshot({"nation": nation.withColumn("n_name", F.lit("old"))}, place)
    sinks.swap_snapshot({"nation": nation}, place)
    return sinks.read_snapshot(spark, place, "nation")


@query("SELECT r_regionkey, 'new' AS of FROM region")
def store_latest(spark, sf):
    """The newest file by its name; samples and pointers are passed over."""
    place, region = folder(spark), table(spark, sf, "region").select("r_regionkey")
    for name, label in (("regions-2024-04-30.jsonl", "old"), ("regions-2024-05-01.jsonl", "new"), ("regions-2024-05-02-sample.jsonl", "sample")):
        sinks.write_json_lines(region.withColumn("of", F.lit(label)), place, name)
    return readers.json_lines(spark, store.latest(spark, place, "regions"), "r_regionkey int, of string").select("r_regionkey", "of")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE ts >= (SELECT date_trunc('day', max(ts)) - INTERVAL 3 DAYS FROM events)")
def store_since(spark, sf):
    """A file a day; of a range of days only its files are opened, by their names."""
    place = folder(spark)
    events = table(spark, sf, "events").select("event_id", day("ts", "day"), F.date_format("ts", "yyyyMMdd").alias("stamp"))
    last = events.agg(F.max("day")).first()[0]
    events.write.partitionBy("stamp").json(f"{place}/all")
    for name in store.names(spark, f"{place}/all"):
        if "=" in name:
            store.rename(spark, f"{place}/all/{name}", f"{place}/changes-{name.split('=')[1]}-0000")
    paths = store.since(spark, place, "changes", datetime.date.fromisoformat(last), 3)
    return readers.tolerant_json(spark, paths, "event_id long, day string")


@query("SELECT DISTINCT 'h' || user_id || '.example.org' AS source, event_type || '.example.com' AS target FROM events WHERE event_type IN ('click', 'view')")
def store_host_edges(spark, sf):
    """A link graph's reversed hosts; only edges to wanted hosts, once each."""
    place = folder(spark)
    line = F.concat(F.lit("org.example.h"), F.col("user_id").cast("string"), F.lit("\tcom.example."), F.col("event_type"))
    table(spark, sf, "events").select(line.alias("value")).write.option("compression", "gzip").text(place)
    wanted = spark.createDataFrame([("click.example.com",), ("view.example.com",), ("none.example.com",)], "host string")
    return readers.host_edges(spark, place, wanted)


@query("SELECT DISTINCT 'h' || user_id AS host, '/' || event_type AS url_path FROM events WHERE value > 5 AND user_id % 2 = 0 AND event_type <> 'purchase'")
def store_captures(spark, sf):
    """Successful captures with short paths of wanted domains; the filters reach the scan."""
    place = folder(spark)
    path = F.when(F.col("event_type") == "purchase", F.repeat(F.lit("/long"), 30)).otherwise(F.concat(F.lit("/"), F.col("event_type")))
    captures = table(spark, sf, "events").select(F.concat(F.lit("h"), F.col("user_id").cast("string")).alias("host"), path.alias("url_path"), F.when(F.col("value") > 5, 200).otherwise(404).cast("short").alias("fetch_status"), (F.col("user_id") % 2).cast("string").alias("registered_domain"))
    sinks.write_parquet(captures, place)
    return readers.successful_paths(spark.read.parquet(place), spark.createDataFrame([("0",)], "registered_domain string"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '{\"a\":\"' || o_custkey || '\"}' ELSE '{\"a\":' || o_custkey || ',\"b\":\"long\"}' END AS raw FROM orders")
def store_slimmed(spark, sf):
    """Raw JSON of ended rows cut down to the keys that are kept."""
    raw = F.concat(F.lit('{"a":'), F.col("o_custkey").cast("string"), F.lit(',"b":"long"}'))
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", raw.alias("raw"))
    return sinks.slim(rows, "raw", ["a", "c"], F.col("o_orderstatus") == "F").select("o_orderkey", "raw")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey < 12")
def store_archive_survivors(spark, sf):
    """What an archive holds leaves the live table; the rest stays."""
    place, rows = folder(spark), table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    sinks.write_parquet(rows.where("s_nationkey >= 12"), place)
    return sinks.survivors(rows, spark.read.parquet(place), "s_suppkey").select("s_suppkey", "s_name")
