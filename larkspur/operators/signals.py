"""Memories of first and last sightings, and the signals derived from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def memory(events: DataFrame, keys: Sequence[str], time: str, flagged: Column | None = None) -> DataFrame:
    """first_seen, last_seen, mentions and flagged mentions of each key."""
    flag = F.lit(False) if flagged is None else flagged
    return events.groupBy(*keys).agg(F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), F.count("*").alias("mentions"), F.count_if(flag).alias("mentions_title"))


def merge_memory(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old memory with a new reading: first_seen never moves later, mentions are those of the newest reading."""
    o, n = old.withColumn("__age", F.lit(0)), new.withColumn("__age", F.lit(1))
    newest = F.max(F.struct("__age", "mentions", "mentions_title"))
    merged = o.unionByName(n).groupBy(*keys).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), newest.alias("b"))
    return merged.select(*keys, "first_seen", "last_seen", F.col("b.mentions").alias("mentions"), F.col("b.mentions_title").alias("mentions_title"))


def confidence(mentions: Column, title: Column) -> Column:
    """high: a title mention among two or more, or three mentions; medium: two mentions or a title; else low."""
    return F.when(((title >= 1) & (mentions >= 2)) | (mentions >= 3), "high").when((mentions >= 2) | (title >= 1), "medium").otherwise("low")


def adopted(pairs: DataFrame, owner: str, since: Column, settled: str) -> DataFrame:
    """Pairs first seen at ``since`` or later at an owner that had been known for longer than ``settled`` before."""
    known = pairs.groupBy(owner).agg(F.min("first_seen").alias("__known"))
    joined = pairs.where(F.col("first_seen") >= since).join(known, owner)
    return joined.where(F.col("__known") < F.col("first_seen") - F.expr(f"INTERVAL {settled}")).drop("__known").withColumn("confidence", confidence(F.col("mentions"), F.col("mentions_title")))
