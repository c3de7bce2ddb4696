"""Sinks: sparse JSON lines, Parquet, monthly archives with a re-read check, capped exports, guarded snapshots."""

from __future__ import annotations

import csv
import io
import json
import uuid
import zipfile
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.aggregates import percent
from . import store


def sparse_json(df: DataFrame) -> DataFrame:
    """One JSON line a row (column ``value``) without keys that are null, empty strings or empty lists."""
    def filled(field: T.StructField):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            return F.when(c != "", c).alias(field.name)
        if isinstance(field.dataType, (T.ArrayType, T.MapType)):
            return F.when(F.size(c) > 0, c).alias(field.name)
        return c

    return df.select(F.to_json(F.struct(*(filled(f) for f in df.schema.fields))).alias("value"))


def write_json_lines(df: DataFrame, folder: str, name: str, pointer: str | None = None) -> str:
    """Write gzip JSON lines to ``folder/name`` (complete or not at all); then move the pointer file to it."""
    path = f"{folder}/{name}"
    sparse_json(df).write.mode("overwrite").option("compression", "gzip").text(path)
    if pointer:
        store.write_text(df.sparkSession, f"{folder}/{pointer}", path)
    return path


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(path)


def archive_months(parents: DataFrame, children: Mapping[str, DataFrame], key: str, ended: str, folder: str) -> dict[str, int]:
    """Archive ended parents by month, and the children that belong to them; rows are counted again from the files.

    Returns rows per table; raises (and the caller deletes nothing) if a count differs. Parents without an end stay.
    """
    spark = parents.sparkSession
    done = parents.where(F.col(ended).isNotNull()).withColumn("month", F.date_format(ended, "yyyy-MM"))
    months = done.select(key, "month")
    tables = {"parents": done} | {n: c.join(months, key) for n, c in children.items()}
    counts = {}
    for name, rows in tables.items():
        path, written = f"{folder}/{name}", Observation(f"archive-{name}")
        write_parquet(rows.observe(written, F.count(F.lit(1)).alias("n")), path, ["month"])
        counts[name] = spark.read.schema(rows.schema).parquet(path).count()
        if counts[name] != written.get["n"]:
            raise RuntimeError(f"{name}: {counts[name]} rows in the archive, not as many as were to be written")
    return counts


def survivors(parents: DataFrame, archived: DataFrame, key: str) -> DataFrame:
    return parents.join(archived.select(key), key, "left_anti")


def export(df: DataFrame, path: str, most: int, order: Sequence) -> int:
    """Write at most ``most`` rows in order as one sorted set of gzip JSON files; the number of rows there are."""
    n = df.count()
    sparse_json(df.orderBy(*order).limit(most) if n > most else df.sort(*order)).write.mode("overwrite").option("compression", "gzip").text(path)
    return n


def swap_snapshot(tables: Mapping[str, DataFrame], folder: str) -> dict[str, int]:
    """Write a new version of all tables and move the pointer to it; never replace a full table by an empty one."""
    spark = next(iter(tables.values())).sparkSession
    version, counts = uuid.uuid4().hex, {}
    for name, df in tables.items():
        write_parquet(df, f"{folder}/{version}/{name}")
        counts[name] = spark.read.schema(df.schema).parquet(f"{folder}/{version}/{name}").count()
    before = current(spark, folder)
    old = before["counts"] if before else {}
    emptied = [n for n, c in counts.items() if c == 0 and old.get(n)]
    if emptied:
        store.delete(spark, f"{folder}/{version}")
        raise RuntimeError(f"refused: {', '.join(emptied)} would become empty")
    store.write_text(spark, f"{folder}/CURRENT", json.dumps({"version": version, "counts": counts}))
    return counts


def current(spark: SparkSession, folder: str) -> dict | None:
    return json.loads(store.read_text(spark, f"{folder}/CURRENT")) if store.exists(spark, f"{folder}/CURRENT") else None


def read_snapshot(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{current(spark, folder)['version']}/{name}")


def manifest(df: DataFrame, present: Mapping[str, object], path: str, extra: Mapping[str, object] | None = None) -> dict:
    """Row count and coverage percentages as a JSON file."""
    row = df.agg(F.count("*").alias("rows"), *(percent(F.count_if(c), F.count("*")).alias(n) for n, c in present.items())).first()
    facts = {"rows": row["rows"], "coverage": {n: row[n] for n in present}} | dict(extra or {})
    store.write_text(df.sparkSession, path, json.dumps(facts))
    return facts


def slim(df: DataFrame, raw: str, keep: Sequence[str], when) -> DataFrame:
    """``raw`` JSON cut down to the ``keep`` keys where ``when`` holds (null values left out)."""
    small = F.to_json(F.struct(*(F.get_json_object(raw, f"$.{k}").alias(k) for k in keep)))
    return df.withColumn(raw, F.when(when, small).otherwise(F.col(raw)))


def zipped_members(df: DataFrame, folder: str, by: str) -> DataFrame:
    """(path, member, rows): ``df`` as CSV members of ZIP files, a file a task and a member for each value of ``by``.

    Rows are dealt out and ordered by ``by``, and stream into the archive. A file is written under a name of its own, so
    a task that is tried again leaves the first try's file unnamed.
    """
    names = df.columns

    def write(batches):
        system, place = fs.FileSystem.from_uri(folder)
        system.create_dir(place, recursive=True)
        name, member, out, counts = f"{uuid.uuid4().hex}.zip", None, None, []
        with system.open_output_stream(f"{place}/{name}") as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as archive:
            for batch in batches:
                for row in batch.to_pylist():
                    if row[by] != member or out is None:
                        if out is not None:
                            out.close()
                        member = row[by]
                        counts.append([f"{member}.csv", 0])
                        out = io.TextIOWrapper(archive.open(counts[-1][0], "w", force_zip64=True), encoding="utf-8", newline="")
                        csv.writer(out).writerow(names)
                    csv.writer(out).writerow(["" if v is None else v for v in row.values()])
                    counts[-1][1] += 1
            if out is not None:
                out.close()
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"] * len(counts)), pa.array([c[0] for c in counts]), pa.array([c[1] for c in counts], pa.int64())], names=["path", "member", "rows"])

    return df.repartition(by).sortWithinPartitions(by).mapInArrow(write, "path string, member string, rows long")
