"""Aggregated views that are kept up to date from batches of inserted and deleted rows.

The view stores counts and sums, never averages, in folders by one of its keys. A batch is folded to the same shape with
signs, joined to the touched folders only, and these alone are written again. Groups whose count falls to zero stay as
rows with n = 0, so that an emptied folder is overwritten as well; readers do not see them.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store


def partials(rows: DataFrame, keys: Sequence[str], sums: Mapping[str, Column], sign: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum(sign).cast("long").alias("n"), *(F.coalesce(F.sum(c * sign), F.lit(0)).cast(rows.select(c.alias(name)).schema[name].dataType).alias(name) for name, c in sums.items()))


def create_view(rows: DataFrame, path: str, keys: Sequence[str], sums: Mapping[str, Column], by: str) -> None:
    """Write the view of ``rows``, in a folder for each value of the key ``by``. Sums should be exact (decimals, integers)."""
    partials(rows, keys, sums, F.lit(1)).repartition(by).write.partitionBy(by).parquet(path)


def stored_view(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_view(spark: SparkSession, path: str, schema) -> DataFrame:
    return stored_view(spark, path, schema).where("n > 0")


def refresh_view(path: str, schema, keys: Sequence[str], sums: Mapping[str, Column], by: str, inserted: DataFrame, deleted: DataFrame) -> DataFrame:
    """Bring the view up to date, and give the values of ``by`` whose folders were written again.

    A row that changed is a deletion of its old values and an insertion of the new ones. Null keys are groups of their
    own. The new folders are complete, beside the view, before the first old one is replaced by a move.
    """
    spark = inserted.sparkSession
    change = partials(inserted, keys, sums, F.lit(1)).unionByName(partials(deleted, keys, sums, F.lit(-1)))
    change = change.groupBy(*keys).agg(F.sum("n").alias("n"), *(F.sum(s).alias(s) for s in sums))
    ready = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    change.write.parquet(f"{ready}/change")
    change = spark.read.parquet(f"{ready}/change").where(F.greatest(F.abs("n"), *(F.abs(s) for s in sums)) > 0)
    touched = change.select(F.col(by).alias("__by")).distinct()
    old = stored_view(spark, path, schema)
    old = old.join(touched, F.col(by).eqNullSafe(F.col("__by")), "left_semi")
    columns = [f.name for f in schema]
    merged = old.select(*columns).unionByName(change.select(*columns)).groupBy(*keys).agg(F.sum("n").alias("n"), *(F.sum(s).cast(schema[s].dataType).alias(s) for s in sums))
    merged.repartition(by).write.partitionBy(by).parquet(f"{ready}/folders")
    for name in store.names(spark, f"{ready}/folders"):
        if "=" in name:
            store.delete(spark, f"{path}/{name}")
            store.rename(spark, f"{ready}/folders/{name}", f"{path}/{name}")
    return touched.withColumnRenamed("__by", by)
