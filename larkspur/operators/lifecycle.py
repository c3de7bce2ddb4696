"""Mutating operators as snapshot x batch -> snapshot: merges, expiry with a breaker, retention, rollups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import breaker


def merge(snapshot: DataFrame, batch: DataFrame, keys: Sequence[str], rules: Mapping[str, str] | None = None) -> DataFrame:
    """Upsert: one full outer join, one rule a column.

    ``new``: the batch's value, else the old one; ``old``: the old value, else the batch's; ``replace``: the batch's
    value even if null. Rows the batch does not name stay. ``is_new`` tells inserted rows.
    """
    rules = rules or {}
    old, new = snapshot.withColumn("__o", F.lit(True)).alias("o"), batch.withColumn("__n", F.lit(True)).alias("n")
    joined = old.join(new, list(keys), "full")
    out = []
    for c in snapshot.columns:
        if c in keys:
            out.append(F.col(c))
        elif c not in batch.columns:
            out.append(F.col(f"o.{c}"))
        else:
            rule = rules.get(c, "new")
            value = {"new": F.coalesce(f"n.{c}", f"o.{c}"), "old": F.coalesce(f"o.{c}", f"n.{c}"), "replace": F.when(F.col("__n"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))}[rule]
            out.append(value.alias(c))
    return joined.select(*out, F.col("__o").isNull().alias("is_new"))


def append_new(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ON CONFLICT DO NOTHING: batch rows whose key is not there yet are added (one row a key)."""
    return target.unionByName(batch.dropDuplicates(list(keys)).join(target, list(keys), "left_anti"))


def update_from(target: DataFrame, updates: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """UPDATE ... FROM: ``columns`` take the update's value where there is a non-null one."""
    u = updates.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns))
    joined = target.join(u, list(keys), "left")
    return joined.select(*(F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in target.columns))


def expire_absent(listings: DataFrame, tenant: str, group: str, seen: str, expired: str, reads: DataFrame, now: Column, least: int = 500, share: float = 0.3) -> DataFrame:
    """Set ``expired`` on live rows whose tenant was read completely after they were last seen.

    ``reads`` has one row a tenant: ok_at and complete. A group in which ``least`` rows or more and over ``share`` of the
    live rows would expire is refused: none of its rows change.
    """
    good = reads.where("complete").select(tenant, F.col("ok_at").alias("__ok"))
    joined = listings.join(good, tenant, "left")
    candidate = F.col(expired).isNull() & F.coalesce(F.col("__ok") > F.col(seen), F.lit(False))
    marked = joined.withColumn("__candidate", candidate)
    refused = breaker(marked.where(F.col(expired).isNull()), group, F.col("__candidate"), least, share).where("refused").select(group, F.lit(True).alias("__refused"))
    done = marked.join(refused, group, "left")
    go = F.col("__candidate") & F.col("__refused").isNull()
    return done.withColumn(expired, F.when(go, now).otherwise(F.col(expired))).select(*listings.columns)


def retention(dead: DataFrame, references: DataFrame, key: str, wide: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(tombstones, deleted): dead rows that something refers to keep their key but lose ``wide``; the others go."""
    held = references.select(key).distinct()
    kept = dead.join(held, key, "left_semi")
    tombstones = kept.select(*(F.lit(None).cast(dead.schema[c].dataType).alias(c) if c in wide else F.col(c) for c in dead.columns))
    return tombstones, dead.join(held, key, "left_anti")


def vanished(ours: DataFrame, upstream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Our rows that the upstream no longer has with the same values of all ``keys``."""
    return ours.join(upstream.select(*keys).distinct(), list(keys), "left_anti")


def month_rollup(rows: DataFrame, by: Sequence[str], time: str, sums: Mapping[str, Column]) -> DataFrame:
    """Sums and counts per month (no averages: rollups of batches can be added up)."""
    return rows.groupBy(*by, F.date_format(time, "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), *(F.sum(c).alias(name) for name, c in sums.items()))


def distrusted(label: Column, wrong: str, text: Column, evidence: str, counter: str) -> Column:
    """``label`` without the value ``wrong`` where the text shows ``evidence`` and not ``counter``."""
    return F.when((label == wrong) & text.rlike(evidence) & ~text.rlike(counter), None).otherwise(label)
