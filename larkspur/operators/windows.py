"""Per-group choices: caps, elections, best records, round robin, stratified samples, shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut


def ranked(df: DataFrame, by: Sequence[str | Column], order: Sequence[Column], name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def top_per_group(df: DataFrame, by: Sequence[str | Column], order: Sequence[Column], k: int) -> DataFrame:
    """At most ``k`` rows a group (diversity cap); Spark stops each group's ranking at k before the shuffle."""
    return ranked(df, by, order, "__rn").where(F.col("__rn") <= k).drop("__rn")


def elect(df: DataFrame, by: Sequence[str], order: Sequence[Column], original: str, key: str) -> DataFrame:
    """Each row with the ``key`` of its group's first row as ``original`` (rows of a null group elect themselves).

    Heads are found with each task's own first row of a group, then joined back: no group is sorted or held in one task.
    """
    lone, same = F.lit(False), F.lit(True)
    for i, c in enumerate(by):
        lone, same = lone | F.col(c).isNull(), same & (F.col(c) == F.col(f"__head_{i}"))
    heads = top_per_group(df.where(~lone), by, order, 1).select(*(F.col(c).alias(f"__head_{i}") for i, c in enumerate(by)), F.col(key).alias("__first"))
    return df.join(heads, same, "left").select(*df.columns, F.when(lone, F.col(key)).otherwise(F.col("__first")).alias(original))


def oldest_of_group(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each duplicate key; rows whose key is null are never duplicates and all stay."""
    keyed = top_per_group(df.where(F.col(key).isNotNull()), [key], [F.col(c).asc_nulls_last() for c in order], 1)
    return keyed.unionByName(df.where(F.col(key).isNull()))


def round_robin(df: DataFrame, outer: str, inner: str, order: Sequence[Column]) -> DataFrame:
    """turn: the row's place in its (outer, inner) group; lap: its place among its outer group's rows of that turn."""
    with_turn = ranked(df, [outer, inner], order, "turn")
    return ranked(with_turn, [outer, "turn"], [F.col(inner), *order], "lap")


def stratified_sample(df: DataFrame, stratum: str, id_column: str, n: int) -> DataFrame:
    """The ``n`` rows a stratum with the least md5 of their id: the same rows on every run."""
    return top_per_group(df, [stratum], [F.md5(F.col(id_column).cast("string")), F.col(id_column)], n)


def sample(df: DataFrame, fraction: float, seed: int, *keys: str) -> DataFrame:
    """About ``fraction`` of the rows, by a hash of ``keys`` (all columns if none) and ``seed``: the same rows on every run
    and on every partitioning, others for another seed."""
    space = 1 << 40
    return df.where(F.pmod(F.xxhash64(F.lit(seed), *(keys or df.columns)), F.lit(space)) < int(fraction * space))


def hash_share(column: Column) -> Column:
    """A number in [0, 1) that depends on the value only (the first 32 bits of its sha1)."""
    return F.conv(F.substring(F.sha1(column.cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def shares(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n per (by, value), the group's total and the share."""
    counted = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    return counted.withColumn("total", F.sum("n").over(Window.partitionBy(*by))).withColumn("share", F.col("n") / F.col("total"))


def dominant(df: DataFrame, by: Sequence[str], value: str, least_share: float, least_n: int) -> DataFrame:
    """The value that holds at least ``least_share`` of its group and ``least_n`` rows (most rows first, then value)."""
    good = shares(df, by, value).where((F.col("share") >= least_share) & (F.col("n") >= least_n))
    return top_per_group(good, by, [F.col("n").desc(), F.col(value).asc_nulls_last()], 1)


def ranges(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, order: Sequence[Column], name: str = "rn", partitions: int | None = None) -> DataFrame:
    """Adds the place in a global order without one task that holds all rows: ranges, numbers within them, offsets.

    ``order`` must be total. What the driver sees is one count a range; there are as many ranges as the session has
    shuffle partitions, unless ``partitions`` says otherwise.
    """
    partitions = partitions or ranges(df)
    ranged = cut(df.repartitionByRange(partitions, *order).withColumn("__part", F.spark_partition_id()))
    starts, at = [], 0
    for r in sorted(ranged.groupBy("__part").agg(F.count("*").alias("n")).collect()):
        starts.append((r["__part"], at))
        at += r["n"]
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "__part int, __start long"))
    local = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.withColumn("__local", local).join(offsets, "__part").withColumn(name, F.col("__start") + F.col("__local")).drop("__part", "__local", "__start")


def running_total(df: DataFrame, order: str, value: str, name: str, partitions: int | None = None) -> DataFrame:
    """Adds the sum of ``value`` over all rows before each one in the order of a column of different values.

    No task holds all rows: ranges of the column, sums within each, and offsets, of which the driver sees one a range.
    """
    partitions = partitions or ranges(df)
    ranged = cut(df.repartitionByRange(partitions, order).withColumn("__part", F.spark_partition_id()))
    starts, at = [], 0
    for r in sorted(ranged.groupBy("__part").agg(F.sum(value).alias("n")).collect()):
        starts.append((r["__part"], at))
        at += r["n"]
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "__part int, __start long"))
    within = F.sum(value).over(Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return ranged.withColumn("__within", F.coalesce(within, F.lit(0))).join(offsets, "__part").withColumn(name, F.col("__start") + F.col("__within")).drop("__part", "__within", "__start")
