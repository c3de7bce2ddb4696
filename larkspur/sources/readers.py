"""Readers: verbatim JSON lines with typed columns, tolerant JSON, delimited files, link-graph edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import remote


def json_lines(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str, raw: str = "raw", partitions: int | None = None) -> DataFrame:
    """Typed columns beside the verbatim line: one pass, keys that are missing become null, blank lines are dropped.

    A gzip file is read by one task; ``partitions`` deals its rows out before the parsing.
    """
    lines = spark.read.text(paths if isinstance(paths, str) else list(paths)).where(F.length(F.btrim("value")) > 0)
    if partitions:
        lines = lines.repartition(partitions)
    return lines.select(F.from_json("value", schema).alias("j"), F.col("value").alias(raw)).select("j.*", raw)


def tolerant_json(spark: SparkSession, paths, schema: T.StructType | str) -> DataFrame:
    """Typed JSON lines; malformed ones are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(paths)


def delimited(spark: SparkSession, paths, schema: T.StructType | str, separator: str = ",", header: bool = True, bad: str | None = None) -> DataFrame:
    """CSV or TSV with a given schema; ``bad`` names a column that keeps malformed lines instead of failing."""
    reader = spark.read.schema(schema).option("sep", separator).option("header", header).option("quote", '"').option("escape", '"')
    return (reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad) if bad else reader).csv(paths)


def zipped_csv(spark: SparkSession, path: str, schema: T.StructType | str, member: str = ".csv", separator: str = ",", encoding: str = "utf-8") -> DataFrame:
    """The CSV members (names that end in ``member``) of ZIP files; each member is a task, which reads its own range.

    ``path``: files (``;`` between them), folders or patterns of names. The first line of a member names its columns;
    those of ``schema`` are picked by name, the others left out, and missing ones are null. Values that are not of their
    type become null.
    """
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    spark.dataSource.register(remote.ZipMembers)
    texts = spark.read.format("zip_members").schema(T.StructType([T.StructField(n, T.StringType()) for n in wanted.names])).option("member", member).option("separator", separator).option("encoding", encoding).load(path)
    return texts.select(*(F.nullif(F.col(f"`{f.name}`"), F.lit("")).try_cast(f.dataType).alias(f.name) for f in wanted))


def table_facts(spark: SparkSession, name: str) -> list[tuple[str, str]] | None:
    """(column, type) of a catalogued table, or None where there is none."""
    return [(c.name, c.dataType) for c in spark.catalog.listColumns(name)] if spark.catalog.tableExists(name) else None


def host_edges(spark: SparkSession, paths, targets: DataFrame, column: str = "host") -> DataFrame:
    """(source, target) host pairs of a link graph (reversed hosts, tab-separated) that point at one of ``targets``."""
    turn = lambda c: F.array_join(F.reverse(F.split(c, r"\.")), ".")
    parts = F.split("value", "\t")
    edges = spark.read.text(paths).select(turn(parts[0]).alias("source"), turn(parts[1]).alias("target"))
    return edges.where(F.col("source") != F.col("target")).join(targets.select(F.col(column).alias("target")).distinct(), "target", "left_semi").distinct()


def successful_paths(captures: DataFrame, domains: DataFrame, longest: int = 100) -> DataFrame:
    """Distinct (host, path) of captures with status 200 and a short path, for the given registered domains."""
    good = captures.where((F.col("fetch_status") == 200) & (F.length("url_path") < longest))
    return good.join(domains.select("registered_domain").distinct(), "registered_domain", "left_semi").select("host", "url_path").distinct()
