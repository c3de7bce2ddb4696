"""Exact percentiles of groups of any size by distributed selection.

Groups of up to ``SMALL`` rows are sorted by Spark's own aggregate. For a larger group the range of its values is cut
into ``BINS``, counted with partial aggregation, and only the bin that holds a wanted rank is cut again, until it holds
one value or ``SMALL`` rows. No task ever holds more than the bins of a group or ``SMALL`` of its rows.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

SMALL = 250_000
BINS = 4096
LARGEST = sys.float_info.max


def null_safe(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on columns of the same names in which null equals null; the right side's are dropped."""
    named = right.select(*(F.col(c).alias(f"__r_{c}") if c in by else F.col(c) for c in right.columns))
    on = functools.reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in by), F.lit(True))
    return left.join(named, on, how).drop(*(f"__r_{c}" for c in by))


def bin_of(value: Column) -> Column:
    """The bin of a value between low and high; rising with the value, so equal values share one.

    Halves of finite numbers, as a difference of two doubles may be infinite.
    """
    half = lambda c: F.greatest(F.least(c, F.lit(LARGEST)), F.lit(-LARGEST)) / 2
    low, high = half(F.col("low")), half(F.col("high"))
    place = F.floor((half(value) - low) / (high - low) * BINS)
    return F.when(high > low, F.least(F.greatest(place, F.lit(0)), F.lit(BINS - 1))).otherwise(F.when(value > F.col("low"), 1).otherwise(0))


def nth_values(rows: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """(by, rank, v): the value at each wanted rank (from 0) of a group. ``rows``: by, v; ``wanted``: by, rank, low, high, n."""
    found: DataFrame | None = None
    open_ranks = cut(wanted.withColumn("skip", F.lit(0).cast("long")))
    while True:
        done = open_ranks.where("low = high").select(*by, "rank", F.col("low").alias("v"))
        few = open_ranks.where(f"low < high AND n <= {SMALL}")
        inside = null_safe(rows, few.select(*by, "rank", "skip", "low", "high"), by).where("v BETWEEN low AND high")
        placed = inside.withColumn("at", F.row_number().over(Window.partitionBy(*by, "rank").orderBy("v")) - 1 + F.col("skip"))
        done = cut(done.unionByName(placed.where("at = rank").select(*by, "rank", "v")))
        found = done if found is None else found.unionByName(done)
        large = open_ranks.where(f"low < high AND n > {SMALL}")
        if large.isEmpty():
            return found
        binned = null_safe(rows, large.select(*by, "rank", "skip", "low", "high"), by).where("v BETWEEN low AND high")
        counts = binned.groupBy(*by, "rank", "skip", bin_of(F.col("v")).alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.sum("n").over(Window.partitionBy(*by, "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
        ahead = counts.withColumn("skip", F.col("skip") + before)
        open_ranks = cut(ahead.where("rank >= skip AND rank < skip + n").select(*by, "rank", "low", "high", "n", "skip"))


def percentiles(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float], name: str = "p") -> DataFrame:
    """(by, name): the exact percentiles of each group's values as an array, linear between neighbours.

    Nulls and NaN count as no value; a group without values has null. Null keys are one group.
    """
    by = list(by)
    number = F.col(value).cast("double")
    rows = df.select(*by, F.when(~F.isnan(number), number).alias("v"))
    sizes = cut(rows.groupBy(*by).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")))
    small = null_safe(rows, sizes.where(f"n <= {SMALL}").select(*by), by)
    out = small.groupBy(*by).agg(F.percentile("v", F.array(*map(F.lit, shares))).alias(name))
    large = sizes.where(f"n > {SMALL}")
    if large.isEmpty():
        return out
    at = [F.lit(s) * (F.col("n") - 1) for s in shares]
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(a), F.ceil(a)) for a in at))))
    values = nth_values(rows.where("v IS NOT NULL"), large.select(*by, F.explode(ranks).alias("rank"), "low", "high", "n"), by)
    held = values.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))  # two values a share

    def between(a: Column) -> Column:
        low, high = F.col("at")[F.floor(a)], F.col("at")[F.ceil(a)]
        return F.when(F.floor(a) == F.ceil(a), low).otherwise((F.ceil(a) - a) * low + (a - F.floor(a)) * high)

    return out.unionByName(null_safe(held, large.select(*by, "n"), by).select(*by, F.array(*map(between, at)).alias(name)))
