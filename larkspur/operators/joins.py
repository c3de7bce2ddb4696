"""Joins beyond the plain equi-join: pattern tables, time gaps, coverage windows, overlap, pointer chasing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import vectors
from .windows import ranked, top_per_group

#: Pattern tables up to this size are folded into one regular expression; larger ones are matched by their first word.
MAX_PATTERNS = 2000
#: Most rows and most numbers of a block of vectors, which a task holds; a block is not made smaller than this for the sake of more tasks.
VECTOR_BLOCK, BLOCK_NUMBERS, VECTOR_LEAST = 32_768, 1 << 22, 4096


def pattern_test(column: Column, patterns: Sequence[str]) -> Column:
    """Whether any pattern occurs in ``column`` at word boundaries: one expression, no join."""
    return column.rlike(r"\b(?:" + "|".join(patterns) + r")\b") if patterns else F.lit(False)


def matches_pattern_table(df: DataFrame, column: Column, patterns: DataFrame, pattern: str) -> DataFrame:
    """Rows in which some pattern of the (small, checked) table occurs at word boundaries."""
    listed = [r[0] for r in patterns.select(pattern).where(F.col(pattern).isNotNull()).distinct().orderBy(pattern).limit(MAX_PATTERNS + 1).collect()]
    if len(listed) > MAX_PATTERNS:
        raise ValueError(f"over {MAX_PATTERNS} patterns; match them as token n-grams instead")
    return df.where(pattern_test(column, listed))


def join_pairs(df: DataFrame, columns: Sequence[str], pairs: Sequence[tuple]) -> DataFrame:
    """Rows whose ``columns`` are one of the given tuples."""
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)
    return df.join(F.broadcast(df.sparkSession.createDataFrame(sorted(set(pairs)), kinds)), list(columns), "left_semi")


def not_in(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """SQL NOT IN: nothing if the other side holds a null; rows with a null key only if it is empty."""
    facts = other.agg(F.count("*").alias("n"), F.count_if(F.col(other_column).isNull()).alias("nulls")).first()
    if facts["nulls"]:
        return df.limit(0)
    kept = df.where(F.col(column).isNotNull()) if facts["n"] else df
    return kept.join(other.select(F.col(other_column).alias("__k")).distinct(), F.col(column) == F.col("__k"), "left_anti")


def latest_per_key(df: DataFrame, key: str, time: str, tie: str, columns: Sequence[str]) -> DataFrame:
    """The columns of the latest row a key (ties: the largest ``tie``): a partial aggregate, no window."""
    best = df.groupBy(key).agg(F.max(F.struct(time, tie, *(c for c in columns if c not in (time, tie)))).alias("b"))
    return best.select(key, *(F.col("b")[c].alias(c) for c in columns))


def other_members(df: DataFrame, key: str, id_column: str, value: str, separator: str = ",", most: int = 1000) -> DataFrame:
    """Each row with ``others``, the sorted values of the other rows of its key, and ``n_others``, their number.

    One aggregate a key and one join back. A row's list grows with its group, and all lists with the group's square: in
    groups of more than ``most`` rows ``others`` is null; ``other_pairs`` gives them row by row, whatever the size.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__c"))
    counted = df.join(counts, key, "left")
    members = counted.where(F.col("__c").between(2, most)).groupBy(key).agg(F.collect_list(F.struct(F.col(value).alias("v"), F.col(id_column).alias("i"))).alias("__m"))
    others = F.array_join(F.transform(F.array_sort(F.filter("__m", lambda x: x["i"] != F.col(id_column))), lambda x: x["v"].cast("string")), separator)
    shown = F.when(F.coalesce("__c", F.lit(1)) <= most, F.coalesce(others, F.lit("")))
    return counted.join(members, key, "left").withColumn("others", shown).withColumn("n_others", F.coalesce("__c", F.lit(1)) - 1).drop("__m", "__c")


def other_pairs(df: DataFrame, key: str, id_column: str, value: str) -> DataFrame:
    """(id, other_id, other): each row with each other row of its key, as an equi-join that splits hot keys."""
    left, right = df.select(key, id_column), df.select(key, F.col(id_column).alias("other_id"), F.col(value).alias("other"))
    return left.join(right, key).where(F.col(id_column) != F.col("other_id")).select(id_column, "other_id", "other")


def after_gap(df: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    """Rows for which some row of the key is older by more than ``gap`` (an interval): only the key's minimum matters."""
    first = df.groupBy(key).agg(F.min(time).alias("__first"))
    return df.join(first, key).where(F.col("__first") < F.col(time) - F.expr(f"INTERVAL {gap}")).drop("__first")


def covered_by_run(df: DataFrame, runs: DataFrame, on: Sequence[str], seen: str, posted: str, finished: str, window_start: str, grace: str) -> DataFrame:
    """Rows for which a run of the same keys finished after ``seen`` plus grace and whose window reaches back to ``posted``.

    Of a key's runs only those not dominated matter; the residual conditions stay in a semi join, which keeps no copies.
    """
    later = F.col(f"r.{finished}") > F.col(f"d.{seen}") + F.expr(f"INTERVAL {grace}")
    reaching = F.col(f"r.{window_start}") <= F.col(f"d.{posted}")
    same = [F.col(f"d.{c}") == F.col(f"r.{c}") for c in on]
    condition = later & reaching
    for s in same:
        condition = s & condition
    return df.alias("d").join(runs.alias("r"), condition, "left_semi")


def free_of_overlap(slots: DataFrame, busy: DataFrame, key: str, start: str, end: str, bucket_seconds: int = 86_400) -> DataFrame:
    """Slots that overlap no busy interval of their key; an equi-join on (key, time bucket), not a range scan.

    ``start`` and ``end`` are epoch seconds (long); intervals are half-open.
    """
    def spread(df):
        first, last = F.floor(F.col(start) / bucket_seconds), F.floor((F.greatest(F.col(end) - 1, F.col(start))) / bucket_seconds)
        return df.withColumn("__bucket", F.explode(F.sequence(first, last)))

    taken = spread(busy.select(key, F.col(start).alias("__s"), F.col(end).alias("__e")).withColumnRenamed("__s", start).withColumnRenamed("__e", end)).select(key, "__bucket", F.col(start).alias("__bs"), F.col(end).alias("__be"))
    hit = spread(slots).join(taken, [key, "__bucket"]).where((F.col(start) < F.col("__be")) & (F.col("__bs") < F.col(end))).select(key, start, end).distinct()
    return slots.join(hit, [key, start, end], "left_anti")


def chase(pointers: DataFrame, node: str, target: str, most_rounds: int = 40) -> DataFrame:
    """node -> the end of its chain of targets, by pointer doubling (rounds grow with the log of the longest chain).

    ``pointers`` has one target a node; chains must end (a node that no row has as ``node``, or that targets itself).
    """
    now = cut(pointers.select(F.col(node).alias("node"), F.col(target).alias("target")).where("node <> target"))
    for _ in range(most_rounds):
        next_hop = now.select(F.col("node").alias("target"), F.col("target").alias("further"))
        moved = now.join(next_hop, "target", "left")
        jumped = cut(moved.select("node", F.coalesce("further", "target").alias("target"), F.col("further").isNotNull().alias("moved")))
        now = jumped.select("node", "target")
        if jumped.where("moved").isEmpty():
            return now.select(F.col("node").alias(node), F.col("target").alias(target))
    raise ValueError("a chain of pointers does not end")


def cells_of(asked: int, rows: int, tasks: int, block: int) -> tuple[int, int]:
    """(blocks, stripes) for ``asked`` rows against ``rows``: blocks of at most ``block`` rows, and about ``tasks`` cells in all
    where there are rows enough. Every row is copied to one task a block, and every asked row to one a stripe."""
    least = min(block, VECTOR_LEAST)
    blocks = max(-(-asked // block), min(tasks, -(-asked // least)), 1)
    return blocks, max(1, min(-(-tasks // blocks), -(-rows // least)))


def nearest(df: DataFrame, key: str, vector: str, k: int, wanted: Column | None = None, block: int = VECTOR_BLOCK) -> DataFrame:
    """(key, near_id, score, rn): the ``k`` rows of highest cosine for every row, or every ``wanted`` one, ties by id; a row
    is not its own neighbour.

    Exact: the pairs are quadratic in the rows. A task holds one block of rows, past which the others stream, and hands on
    at most ``k`` neighbours of a row. Of equal vectors only the first ``k`` + 1 ids can be neighbours, so copies do not add to
    the others. ``key`` must be unique; null and zero vectors have no neighbours.
    """
    single = df.schema[vector].dataType.simpleString() == "array<float>"
    rows = df.select(F.col(key).alias("id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("v"), (F.lit(True) if wanted is None else wanted).alias("asked")).where(F.col("v").isNotNull())
    facts = rows.agg(F.count("*").alias("rows"), F.count_if("asked").alias("asked"), F.max(F.size("v")).alias("places")).first()
    blocks, stripes = cells_of(facts["asked"], facts["rows"], 2 * df.sparkSession.sparkContext.defaultParallelism, min(block, max(1, BLOCK_NUMBERS // max(1, facts["places"] or 1))))

    def dealt(part: DataFrame, asked: bool) -> DataFrame:
        """Rows of the blocks to every stripe, or rows of the stripes to every block."""
        own, others = (blocks, stripes) if asked else (stripes, blocks)
        at, other = F.pmod(F.xxhash64("id"), F.lit(own)), F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        both = part.select("id", "v", at.alias("own"), other.alias("other"))
        a, b = ("own", "other") if asked else ("other", "own")
        return both.select((F.col(a) * stripes + F.col(b)).cast("int").alias("cell"), F.lit(asked).alias("asked"), "id", "v")

    compared = dealt(top_per_group(rows, ["v"], [F.col("id")], k + 1), False)
    cells = dealt(rows.where("asked"), True).unionByName(compared).repartitionById(blocks * stripes, "cell").sortWithinPartitions("cell", F.desc("asked"))
    kind = rows.schema["id"].dataType.simpleString()
    found = cells.mapInArrow(lambda batches: vectors.search(batches, k), f"id {kind}, near_id {kind}, score double")
    return ranked(found, ["id"], [F.col("score").desc(), F.col("near_id")]).where(F.col("rn") <= k).withColumnRenamed("id", key)
