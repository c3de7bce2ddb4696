"""Own names matched to a registry by token prefixes: an equi-join, never a comparison of names one by one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.enrich import registry_key
from ..session import cut

#: Characters of the shortest name that may match by its beginning.
LEAST = 4


def prefixes(key: Column) -> Column:
    """All beginnings of a name that end with a word, the whole name included."""
    words = F.split(key, " ")
    return F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, 1, n), " "))


def best_entries(own: DataFrame, own_id: str, own_name: str, registry: DataFrame, entry_id: str, entry_name: str, rank: str) -> DataFrame:
    """(own id, how, entry id, entry name): the registry entry of each own name that has one.

    ``how`` is ``same`` (equal but for case, punctuation and legal forms), ``begins`` (the entry begins with the own
    name) or ``within`` (the own name begins with the entry), in this order of preference; then the smaller ``rank`` of
    the entry's kind; of those within, the longest; the shortest otherwise; then name and id. Names under four
    characters match nothing.

    The registry's beginnings are folded to the best entry of each one before they are joined, so that a beginning that
    a third of all entries share is one row; own names are folded to different ones, and meet the rows again at the end.
    """
    core = registry_key(F.col(own_name))
    rows = own.select(F.col(own_id), core.alias("__core")).where(F.length("__core") >= LEAST)
    cores = rows.select("__core").distinct()
    entries = registry.select(F.col(entry_id).alias("__id"), registry_key(F.col(entry_name)).alias("__key"), F.col(entry_name).alias("__name"), F.col(rank).alias("__rank")).where(F.length("__key") >= LEAST)
    entry = lambda tier, size: F.struct(F.lit(tier).alias("tier"), F.col("__rank").alias("rank"), size.alias("size"), F.col("__name").alias("name"), F.col("__id").alias("id"))
    begun = entries.select("*", F.explode(prefixes(F.col("__key"))).alias("__core")).where(F.length("__core") >= LEAST)
    same = F.col("__core") == F.col("__key")
    begun = begun.groupBy("__core").agg(F.min(F.when(same, entry(0, F.length("__key"))).otherwise(entry(1, F.length("__key")))).alias("best"))
    whole = entries.groupBy("__key").agg(F.min(entry(2, -F.length("__key"))).alias("best"))
    parts = cores.select("__core", F.explode(prefixes(F.col("__core"))).alias("__key")).where(F.col("__key") != F.col("__core"))
    # the longest of those within comes before its kind's rank
    within = parts.join(whole, "__key").groupBy("__core").agg(F.max_by("best", F.length("__key")).alias("best"))
    found = cores.join(begun, "__core").unionByName(within).groupBy("__core").agg(F.min("best").alias("best"))
    how = F.element_at(F.array(*map(F.lit, ("same", "begins", "within"))), F.col("best.tier") + 1)
    return rows.join(cut(found), "__core").select(own_id, how.alias("how"), F.col("best.id").alias(entry_id), F.col("best.name").alias(entry_name))
