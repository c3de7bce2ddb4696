"""Matches to be sent: judged well enough, never sent before, one a listing's cluster, a user's best ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import top_per_group


def digest(matches: DataFrame, sent: DataFrame, user: str, item: str, cluster: str, score: str, order: Sequence[str], least: float = 70, most: int = 30) -> DataFrame:
    """At most ``most`` matches a user with a score of ``least`` or more: none whose item, or whose cluster, the user was
    sent before, one of each cluster (items without a cluster stand alone), best scores first, ties by ``order``."""
    good = matches.where(F.col(score) >= least)
    fresh = good.join(sent.select(user, item).distinct(), [user, item], "left_anti")
    seen = sent.where(F.col(cluster).isNotNull()).select(user, cluster).distinct()
    fresh = fresh.join(seen, [user, cluster], "left_anti")
    best_first = [F.col(score).desc(), *(F.col(c) for c in order)]
    alone = F.coalesce(F.concat(F.lit("c"), F.col(cluster).cast("string")), F.concat(F.lit("i"), F.col(item).cast("string")))
    one_each = top_per_group(fresh.withColumn("__one", alone), [user, "__one"], best_first, 1).drop("__one")
    return top_per_group(one_each, [user], best_first, most)
