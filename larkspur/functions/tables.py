"""Table functions of the session's SQL. Each takes a TABLE argument dealt out and ordered by the query, and holds one
row of state: groups of any size stream through."""

from __future__ import annotations

from collections.abc import Mapping
from graphlib import TopologicalSorter

import regex
from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult
from pyspark.sql.types import DoubleType, LongType, StructType


def argument(table: AnalyzeArgument, position: int):
    if not table.isTable:
        raise ValueError("the first argument is a TABLE(...)")
    return table.dataType.fields[position]


class ResolveDuplicates:
    """``resolve_duplicates(TABLE(rows) PARTITION BY key ORDER BY (rank, id))``: the first row of a key is the original;
    every later one comes out with it. Columns of the table: key, id. Rows with a null key are no duplicates."""

    def __init__(self):
        self.original = None
        self.open = False

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        key, id_ = argument(table, 0), argument(table, 1)
        return AnalyzeResult(schema=StructType().add(key.name, key.dataType).add("id", id_.dataType).add("duplicate_of", id_.dataType))

    def eval(self, row):
        if row[0] is None:
            return
        if self.open:
            yield row[0], row[1], self.original
        else:
            self.original, self.open = row[1], True


class BenchmarkRecall:
    """``benchmark_recall(TABLE(scores) PARTITION BY model ORDER BY (score DESC, id), top)``: how many of the reference's
    items stand among the first ``top`` of each model. Columns: model, wanted (boolean), size (of the reference)."""

    def __init__(self):
        self.model, self.seen, self.found, self.size = None, 0, 0, 0

    @staticmethod
    def analyze(table: AnalyzeArgument, top: AnalyzeArgument) -> AnalyzeResult:
        model = argument(table, 0)
        return AnalyzeResult(schema=StructType().add(model.name, model.dataType).add("found", LongType()).add("of", LongType()).add("recall_pct", DoubleType()))

    def eval(self, row, top):
        self.model, self.size, self.seen = row[0], row[2], self.seen + 1
        if self.seen <= top and row[1]:
            self.found += 1

    def terminate(self):
        if self.found:
            yield self.model, self.found, self.size, round(100.0 * self.found / self.size, 1) if self.size else None


def register(spark: SparkSession) -> None:
    from pyspark.sql.functions import udtf

    spark.udtf.register("resolve_duplicates", udtf(ResolveDuplicates))
    spark.udtf.register("benchmark_recall", udtf(BenchmarkRecall))


def create_views(spark: SparkSession, views: Mapping[str, str]) -> list[str]:
    """Temporary views from SQL that may read one another in any order, made in the order of their needs (given back)."""
    needs = {name: {other for other in views if other != name and regex.search(rf"(?i)\b{regex.escape(other)}\b", sql)} for name, sql in views.items()}
    made = list(TopologicalSorter(needs).static_order())  # raises on a circle
    for name in made:
        spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW `{name}` AS {views[name]}")
    return made
