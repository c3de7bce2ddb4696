"""Shared pieces of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; those of whole texts are dealt out to all cores if they are small."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in ("documents", "pages") else rows


def money(column: str | Column) -> Column:
    """Exact sums: a double with two decimals as a decimal."""
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(18,2)")


def total(column: str | Column, name: str) -> Column:
    return F.sum(money(column)).cast("double").alias(name)


def day(column: str, name: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd").alias(name)


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with customer and nation: the listing index (employer, country, date) of the search queries."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey)
        .select("o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority", "o_totalprice", "c_custkey", "c_name", "c_mktsegment", "n_name")
    )


POSTINGS_SQL = "(SELECT o_orderkey, o_orderdate, o_orderstatus, o_orderpriority, o_totalprice, c_custkey, c_name, c_mktsegment, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"
