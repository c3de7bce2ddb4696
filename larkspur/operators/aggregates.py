"""Aggregates: coverage, exact percentiles, two-level benchmarks, histograms, breakers, rollups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(F.lit(100.0) * part / F.nullif(whole, F.lit(0)), digits)


def coverage(df: DataFrame, present: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Row count and the percentage of rows for which each condition holds, in one pass."""
    return df.groupBy(*by).agg(F.count("*").alias("rows"), *(percent(F.count_if(c), F.count("*")).alias(name) for name, c in present.items()))


def distinct_then_count(df: DataFrame, key: str, value: str, name: str = "n") -> DataFrame:
    """count(DISTINCT value) per key in two phases (pairs first), so that a hot key is spread over its values."""
    return df.where(F.col(value).isNotNull()).select(key, value).distinct().groupBy(key).agg(F.count("*").alias(name))


def top_value(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The most frequent value a group, the least on ties."""
    counted = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    return counted.groupBy(*by).agg(F.min(F.struct(-F.col("n"), F.col(value).alias("v"))).alias("b")).select(*by, F.col("b.v").alias(value), (-F.col("b")["col1"]).alias("n"))


def top_values(df: DataFrame, by: Sequence[str], value: str, k: int, separator: str = ",") -> DataFrame:
    """The ``k`` most frequent values a group, joined in order (ties: by value). Groups are first reduced to their counts."""
    counted = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    ranked = counted.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("n").desc(), F.col(value)))).where(F.col("rn") <= k)
    return ranked.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", value))), lambda x: x[value].cast("string")), separator).alias("top"))


YEARLY = {"hour": 2080, "day": 240, "week": 52, "month": 12, "year": 1}


def yearly(amount: Column, period: Column) -> Column:
    """An amount a period as an amount a year; null for an unknown period."""
    out = F.lit(None).cast("double")
    for name, factor in YEARLY.items():
        out = F.when(period == name, amount * factor).otherwise(out)
    return out


def benchmark(df: DataFrame, cell: Sequence[str], level: str, value: str, pool_least: int = 20, level_least: int = 12) -> DataFrame:
    """Exact quartiles over ``cell`` (level '') and over ``cell`` and ``level``, in one pass with grouping sets.

    A pooled cell needs ``pool_least`` rows, a specific one ``level_least``. Rows without a level form the specific cell
    ''; it is used only where no pooled cell of that key stands.
    """
    sets = df.groupingSets([[*cell], [*cell, level]], *cell, level)
    quartiles = sets.agg(
        F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("p"), F.count("*").alias("n"), F.grouping(level).alias("pooled")
    ).where(F.col("n") >= F.when(F.col("pooled") == 1, pool_least).otherwise(level_least))
    named = quartiles.withColumn(level, F.coalesce(level, F.lit("")))
    first = F.row_number().over(Window.partitionBy(*cell, level).orderBy(F.col("pooled").desc()))
    return named.withColumn("__rn", first).where("__rn = 1").select(*cell, level, *(F.col("p")[i].cast("long").alias(q) for i, q in enumerate(("p25", "p50", "p75"))), "n")


def with_estimate(df: DataFrame, bench: DataFrame, cell: Sequence[str], level: str, columns: Sequence[str]) -> DataFrame:
    """The benchmark of each row: that of its level, else the pooled one."""
    specific = bench.select(*cell, F.col(level).alias("__level"), *(F.col(c).alias(f"s_{c}") for c in columns))
    pooled = bench.where(F.col(level) == "").select(*cell, *(F.col(c).alias(f"g_{c}") for c in columns))
    joined = df.withColumn("__level", F.coalesce(level, F.lit(""))).join(specific, [*cell, "__level"], "left").join(pooled, list(cell), "left")
    return joined.select(*df.columns, *(F.coalesce(f"s_{c}", f"g_{c}").alias(c) for c in columns))


def histogram_median(df: DataFrame, by: Sequence[str], bucket: str, n: str, width: float, least: int = 100) -> DataFrame:
    """The middle of the first bucket at which the running count reaches half; groups under ``least`` are left out."""
    whole = Window.partitionBy(*by)
    running = F.sum(n).over(whole.orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0))
    marked = df.withColumn("__run", running).withColumn("total", F.sum(n).over(whole)).where((F.col("total") >= least) & (F.col("__run") * 2 >= F.col("total")))
    return marked.groupBy(*by).agg((F.min(bucket) + width / 2).alias("median"), F.max("total").alias("total"))


def median_of_maxima(df: DataFrame, group: str, row: str, value: str) -> DataFrame:
    """Per group the median of its rows' largest values (truncated), and the number of rows."""
    largest = df.groupBy(group, row).agg(F.max(value).alias("m"))
    return largest.groupBy(group).agg(F.percentile("m", F.lit(0.5)).cast("long").alias("median"), F.count("*").alias("votes"))


def merge_partials(partials: Sequence[DataFrame], by: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Additive rollups of batches (sums and counts, never averages) merged into one."""
    out = partials[0]
    for p in partials[1:]:
        out = out.unionByName(p)
    return out.groupBy(*by).agg(*(F.sum(c).alias(c) for c in sums))


def age_buckets(age_hours: Column, bounds: Mapping[str, float]) -> list[Column]:
    """One conditional count per upper bound (hours), and one for older or unknown rows."""
    out, low = [], None
    for name, high in bounds.items():
        test = age_hours <= high if low is None else (age_hours > low) & (age_hours <= high)
        out.append(F.count_if(test).alias(name))
        low = high
    return [*out, F.count_if(age_hours > low).alias("older"), F.count_if(age_hours.isNull()).alias("unknown")]


def breaker(df: DataFrame, by: str, candidate: Column, least: int = 500, share: float = 0.3) -> DataFrame:
    """Per group: rows, candidates, and whether a mass change is refused (``least`` candidates or more, over ``share``)."""
    return df.groupBy(by).agg(F.count("*").alias("rows"), F.count_if(candidate).alias("candidates")).withColumn("refused", (F.col("candidates") >= least) & (F.col("candidates") > F.col("rows") * share))


def recall_at(reference: DataFrame, other: DataFrame, query: str, item: str, score: str, k_reference: int = 20, k_other: int = 30) -> DataFrame:
    """Per query the share of the reference's top items that are among the other ranking's top items."""
    def top(df, k):
        return df.withColumn("__rn", F.row_number().over(Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(item)))).where(F.col("__rn") <= k).select(query, item)

    joined = top(reference, k_reference).join(top(other, k_other).withColumn("__in", F.lit(1)), [query, item], "left")
    return joined.groupBy(query).agg(F.count("*").alias("n"), F.count("__in").alias("found")).withColumn("recall", F.round(F.col("found") / F.col("n"), 4))


def of_largest(df: DataFrame, by: Sequence[str], source: str, k: int, other: str = "other") -> DataFrame:
    """Rows per ``by`` and source, for the ``k`` sources with most rows in all (ties: by name); the rest count as ``other``."""
    counted = df.groupBy(*by, source).agg(F.count("*").alias("n"))
    totals = counted.groupBy(source).agg(F.sum("n").alias("all")).orderBy(F.desc("all"), source).limit(k).select(source, F.lit(True).alias("__top"))
    named = counted.join(F.broadcast(totals), source, "left").withColumn(source, F.when(F.col("__top"), F.col(source)).otherwise(other))
    return named.groupBy(*by, source).agg(F.sum("n").alias("n"))


def alerts(df: DataFrame, rules: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """(rule, value, fires) of each rule, a value over all rows and a test of it, in one pass over ``df``."""
    values = df.agg(*(value.cast("double").alias(name) for name, (value, _) in rules.items()))
    each = F.array(*(F.struct(F.lit(name).alias("rule"), F.round(F.col(name), 6).alias("value"), test.alias("fires")) for name, (_, test) in rules.items()))
    return values.select(F.explode(each).alias("r")).select("r.*")
