"""Structured Streaming queries run to the end of their input, and their batch twins."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ..session import shared_dir
from ..streaming import feed, stateful
from .common import money, table
from .registry import query


def folder(spark) -> str:
    """A new folder for a stream's log and output, where all executors see it."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def events(spark, sf):
    return feed.read(spark, f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("""
SELECT 'new' AS event, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders UNION ALL
SELECT 'closed', o_orderkey, strftime(o_orderdate + INTERVAL 30 DAYS, '%Y-%m-%d') FROM orders WHERE o_orderstatus = 'F'
""")
def stream_delta_feed(spark, sf):
    orders = feed.read(spark, f"{sf}/orders.parquet").withColumn("closed_at", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")))
    changes = feed.change_feed(orders, "o_orderdate", "closed_at")
    return feed.run_to_folder(changes.select("event", "o_orderkey", F.date_format("t", "yyyy-MM-dd").alias("day")), folder(spark))


@query("SELECT DISTINCT event_id, event_type FROM events")
def stream_watermark_dedup(spark, sf):
    """Every event is delivered twice; each comes out once."""
    twice = events(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return feed.run_to_folder(feed.deduplicated(twice, "ts", ["event_id", "event_type"], "7 days").select("event_id", "event_type"), folder(spark))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf):
    counts = feed.windowed(events(spark, sf), "ts", "1 day", "1 hour", None, ["event_type"], [F.count("*").alias("n"), F.sum(money("value")).cast("double").alias("total")])
    done = feed.run_latest(counts, folder(spark), "complete")
    return done.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", "total")


@query("""
SELECT strftime(h, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM (
  SELECT event_type, date_trunc('hour', ts) - k * INTERVAL 1 HOUR AS h FROM events, (SELECT unnest(generate_series(0, 23)) AS k)) GROUP BY 1, 2
""")
def sliding_24h(spark, sf):
    counts = feed.windowed(events(spark, sf), "ts", "1 day", "24 hours", "1 hour", ["event_type"], [F.count("*").alias("n")])
    return feed.run_latest(counts, folder(spark), "complete").select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


SESSIONS_SQL = "(SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS s FROM events))"


@query(f"SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM {SESSIONS_SQL} GROUP BY user_id, session")
def session_windows(spark, sf):
    grouped = feed.sessions(events(spark, sf), "ts", "2 days", "6 hours", ["user_id"], [F.count("*").alias("n")])
    return feed.run_latest(grouped, folder(spark), "complete").select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query(f"SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n FROM {SESSIONS_SQL} GROUP BY user_id, session")
def session_batch_twin(spark, sf):
    return feed.gap_sessions(table(spark, sf, "events"), ["user_id"], "ts", "event_id", 6 * 3600).groupBy("user_id", "session").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, count(*) AS mentions FROM events GROUP BY 1, 2")
def stream_memory(spark, sf):
    """State kept per key over all batches; the last emission of each key is its memory."""
    touched = feed.run_latest(feed.remember(events(spark, sf), ["user_id", "event_type"], "ts"), folder(spark), "update")
    stamp = lambda f, c: F.date_format(f(c), "yyyy-MM-dd HH:mm:ss").alias(c)
    return touched.groupBy("user_id", "event_type").agg(stamp(F.min, "first_seen"), stamp(F.max, "last_seen"), F.max("mentions").alias("mentions"))


@query("""
WITH m AS (SELECT *, sum(CASE WHEN event_type IN ('error', 'view') THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b, event_type IN ('error', 'view') AS f FROM events)
SELECT r.user_id, strftime(r.opened, '%Y-%m-%d %H:%M:%S') AS opened, strftime(c.ts, '%Y-%m-%d %H:%M:%S') AS closed, r.checks, r.checks >= 3 AS escalated
FROM (SELECT user_id, b, min(ts) AS opened, count(*) AS checks FROM m WHERE f GROUP BY 1, 2) r LEFT JOIN m c ON c.user_id = r.user_id AND NOT c.f AND c.b = r.b + 1
""")
def incident_runs(spark, sf):
    runs = feed.incidents(table(spark, sf, "events"), ["user_id"], "ts", "event_id", F.col("event_type").isin("error", "view"), 3)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return runs.select("user_id", stamp("opened"), stamp("closed"), "checks", "escalated")


def in_deliveries(spark, sf, parts: int, stream) -> tuple:
    """What ``stream(events)`` gives, and its log, after ``parts`` runs on one checkpoint: each run finds the rows that
    arrived since the last one. Rows arrive late by up to half a day (by a hash), so deliveries are out of order."""
    place, inputs = folder(spark), f"{folder(spark)}-input"
    delay = F.pmod(F.xxhash64("event_id"), F.lit(12 * 3600)) * 1_000_000
    rows = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("__arrived", F.unix_micros("ts") + delay)
    first, last = rows.agg(F.min("__arrived"), F.max("__arrived")).first()
    part = F.least(F.floor((F.col("__arrived") - first) * parts / (last - first + 1)), F.lit(parts - 1))
    for number in range(parts):
        rows.where(part == number).drop("__arrived").write.mode("append").parquet(inputs)
        with stateful.rocks_state(spark):
            out = feed.run_to_folder(stream(feed.read(spark, inputs)), place)
    return out, f"{place}/log"


#: The time up to which a watermark of one day lets rows go.
RELEASED = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY FROM events)"
STAMPS = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"


def stamps(df, *columns):
    return df.select(*(F.date_format(F.timestamp_micros(c), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) if c in columns else F.col(c) for c in df.columns))


INCIDENTS_SQL = f"""
WITH e AS (SELECT user_id, ts, event_id, event_type IN ('error', 'view') AS f FROM events WHERE ts < {RELEASED}),
m AS (SELECT *, count(*) FILTER (WHERE NOT f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM e),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS n FROM m WHERE f) WHERE n = 2),
r AS (SELECT user_id, run, min(ts) AS resolved FROM m WHERE NOT f GROUP BY 1, 2),
i AS (SELECT o.user_id, o.run, o.ts AS opened, r.resolved, o.ts + INTERVAL 6 HOURS AS due FROM o LEFT JOIN r ON r.user_id = o.user_id AND r.run = o.run + 1),
c AS (SELECT i.user_id, i.run, count(*) AS whole, count(*) FILTER (WHERE m.ts <= i.due) AS soon FROM i JOIN m ON m.user_id = i.user_id AND m.run = i.run AND m.f GROUP BY 1, 2),
x AS (SELECT user_id, 'opened' AS event, opened, opened AS at_time, 2 AS checks FROM i UNION ALL SELECT user_id, 'resolved', opened, resolved, whole FROM i JOIN c USING (user_id, run) WHERE resolved IS NOT NULL
  UNION ALL SELECT user_id, 'escalated', opened, due, soon FROM i JOIN c USING (user_id, run) WHERE due < {RELEASED} AND (resolved IS NULL OR due < resolved))
SELECT user_id, event, {STAMPS.format("opened")} AS opened, {STAMPS.format("at_time")} AS "at", checks FROM x
"""


def failing():
    return F.col("event_type").isin("error", "view")


@query(INCIDENTS_SQL)
def stream_incidents(spark, sf):
    """Incidents by a state machine a user, in four runs, over deliveries that are out of order by up to half a day."""
    out, _ = in_deliveries(spark, sf, 4, lambda checks: stateful.incident_events(checks, ["user_id"], "ts", "event_id", failing(), "1 day", dt.timedelta(hours=6)))
    return stamps(out, "opened", "at")


@query(INCIDENTS_SQL)
def incidents_batch_twin(spark, sf):
    rows = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    upto = F.lit(rows.agg(F.floor(F.unix_micros(F.max("ts")) / 1000) * 1000).first()[0] - 86_400_000_000)
    return stamps(stateful.incident_events_batch(rows, ["user_id"], "ts", "event_id", failing(), upto, dt.timedelta(hours=6)), "opened", "at")


@query(f"""
WITH e AS (SELECT * FROM events WHERE ts < {RELEASED}),
s AS (SELECT *, sum(g) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) <= INTERVAL 2 DAYS THEN 0 ELSE 1 END AS g FROM e)),
m AS (SELECT user_id, event_type, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS mentions FROM s GROUP BY user_id, event_type, session)
SELECT user_id, event_type, {STAMPS.format("first_seen")} AS first_seen, {STAMPS.format("last_seen")} AS last_seen, mentions, last_seen + INTERVAL 2 DAYS >= {RELEASED} AS alive FROM m
""")
def stream_memory_horizon(spark, sf):
    """Memories that end after two silent days, and those alive, read back from the state of the last run."""
    keys = ["user_id", "event_type"]
    ended, log = in_deliveries(spark, sf, 3, lambda rows: stateful.remember_within(rows, keys, "ts", "event_id", "1 day", dt.timedelta(days=2)))
    living = stateful.alive(spark, log, keys)
    return stamps(ended.withColumn("alive", F.lit(False)).unionByName(living.withColumn("alive", F.lit(True))), "first_seen", "last_seen")


@query("""
WITH d AS (SELECT *, ts < TIMESTAMP '2024-01-15' AND event_id % 10 <> 0 AS first FROM events),
m AS (SELECT max(ts) - INTERVAL 2 DAYS AS mark FROM d WHERE first)
SELECT event_id, event_type, NOT first AND ts < mark AS late FROM d, m
""")
def stream_late_rows(spark, sf):
    """Two deliveries; the second holds rows of long ago beside the new ones, which go to a table of their own."""
    place, inputs = folder(spark), f"{folder(spark)}-input"
    rows = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    first = (F.col("ts") < F.lit("2024-01-15").cast("timestamp")) & (F.col("event_id") % 10 != 0)
    for delivery in (first, ~first):
        rows.where(delivery).write.mode("append").parquet(inputs)
        feed.with_late_rows(feed.read(spark, inputs), "ts", "2 DAYS", lambda batch: batch.select("event_id", "event_type"), place, f"{place}/late")
    good = spark.read.schema("event_id long, event_type string").parquet(f"{place}/out").select("event_id", "event_type", F.lit(False).alias("late"))
    late = spark.read.schema(rows.schema).parquet(f"{place}/late").select("event_id", "event_type", F.lit(True).alias("late"))
    return good.unionByName(late)
