"""Change feeds as Structured Streaming: deduplication, windows, sessions, stateful memories, and how to run them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import store


def read(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream over the Parquet files of a folder (or one file), with the schema of those that are there.

    The path is given as a pattern that only it matches: Spark takes a plain path for a folder.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(f"{path[:-1]}[{path[-1]}]")


def change_feed(rows: DataFrame, opened: str, closed: str) -> DataFrame:
    """An event ``new`` for each opening and ``closed`` for each closing, at time t; events without a time are dropped."""
    kinds = F.array(F.struct(F.lit("new").alias("event"), F.col(opened).alias("t")), F.struct(F.lit("closed").alias("event"), F.col(closed).alias("t")))
    return rows.withColumn("__e", F.explode(kinds)).select("*", "__e.event", "__e.t").drop("__e").where(F.col("t").isNotNull())


def deduplicated(events: DataFrame, time: str, keys: Sequence[str], delay: str) -> DataFrame:
    """At-least-once input made exactly-once: the first event of each key within the watermark."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def windowed(events: DataFrame, time: str, delay: str, length: str, step: str | None, by: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Tumbling (no step) or sliding windows as the struct ``w``."""
    span = F.window(time, length, step) if step else F.window(time, length)
    return events.withWatermark(time, delay).groupBy(span.alias("w"), *by).agg(*aggs)


def sessions(events: DataFrame, time: str, delay: str, gap: str, by: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Sessions that end after ``gap`` without an event."""
    return events.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), *by).agg(*aggs)


def remember(events: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """First and last sighting and mentions of each key over all batches, as one streaming aggregate.

    In update mode each batch gives the keys that it touched. A memory forgets nothing: its state is one row a key.
    """
    return events.groupBy(*keys).agg(F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), F.count("*").alias("mentions"))


def with_late_rows(events: DataFrame, time: str, delay: str, on_time: Callable[[DataFrame], DataFrame], folder: str, late_folder: str) -> dict[str, int]:
    """Run a stream over all there is now; rows older than ``delay`` before the latest seen go to ``late_folder``.

    Spark drops late rows silently, so the mark is kept here: the newest time of all batches before, written beside each
    batch's output. A batch that is run again reads the mark it had, and writes the same files.
    """
    spark, marks = events.sparkSession, f"{folder}/marks"
    totals = {"late": 0, "kept": 0}

    def mark_before(number: int):
        if not number or not store.exists(spark, marks):
            return None
        seen = spark.read.parquet(marks).where(F.col("batch") < number).agg(F.max("newest")).first()[0]
        return None if seen is None else F.lit(seen) - F.expr(f"INTERVAL {delay}")

    def write(batch: DataFrame, number: int) -> None:
        mark = mark_before(number)
        late = F.lit(False) if mark is None else F.coalesce(F.col(time) < mark, F.lit(False))
        old, good = batch.where(late), batch.where(~late)
        old.write.mode("overwrite").parquet(f"{late_folder}/batch={number}")
        on_time(good).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        newest = batch.agg(F.max(time).alias("newest"), F.lit(number).cast("long").alias("batch"))
        newest.write.mode("overwrite").parquet(f"{marks}/at={number}")
        totals["late"] += spark.read.schema(batch.schema).parquet(f"{late_folder}/batch={number}").count()
        totals["kept"] += spark.read.schema(on_time(good).schema).parquet(f"{folder}/out/batch={number}").count()

    events.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return totals


def look_back(events: DataFrame, time: str, now: Column, since: Column | None = None, default: str = "1 DAY", horizon: str = "7 DAYS") -> DataFrame:
    """Events from ``since`` on, or from ``default`` before ``now`` where it is not given; never from before ``horizon``."""
    first = now - F.expr(f"INTERVAL {default}") if since is None else F.coalesce(since, now - F.expr(f"INTERVAL {default}"))
    return events.where(F.col(time) >= F.greatest(first, now - F.expr(f"INTERVAL {horizon}")))


def run_to_folder(stream: DataFrame, folder: str) -> DataFrame:
    """Run an append stream over all there is now into Parquet (exactly once: checkpoint and commit log), read back."""
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def run_latest(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all there is now; each batch writes its own folder. ``complete``: the last one; ``update``: all."""
    batches: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        batches.append(number)

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    if not batches:
        return spark.createDataFrame([], stream.schema)
    paths = [f"{folder}/batch={n}" for n in (batches[-1:] if mode == "complete" else batches)]
    return spark.read.schema(stream.schema).parquet(*paths)


def gap_sessions(events: DataFrame, by: Sequence[str], time: str, tie: str, gap_seconds: float) -> DataFrame:
    """Batch twin of ``sessions``: adds the number of the session that each event lies in."""
    order = Window.partitionBy(*by).orderBy(time, tie)
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    starts = F.when(seconds - F.lag(seconds).over(order) < gap_seconds, 0).otherwise(1)
    return events.withColumn("__s", starts).withColumn("session", F.sum("__s").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__s")


def incidents(checks: DataFrame, by: Sequence[str], time: str, tie: str, failed: Column, escalate_after: int) -> DataFrame:
    """Runs of failed checks as incidents: opened, closed (null while open), checks and whether they escalated."""
    order = Window.partitionBy(*by).orderBy(time, tie)
    marked = checks.withColumn("__f", failed.cast("int"))
    blocks = marked.withColumn("__b", F.sum(1 - F.col("__f")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    closing = blocks.where("__f = 0").select(*by, F.col("__b").alias("__c"), F.col(time).alias("closed"))
    runs = blocks.where("__f = 1").groupBy(*by, "__b").agg(F.min(time).alias("opened"), F.count("*").alias("checks"))
    joined = runs.withColumn("__c", F.col("__b") + 1).join(closing, [*by, "__c"], "left")
    return joined.select(*by, "opened", "closed", "checks", (F.col("checks") >= escalate_after).alias("escalated"))
