"""Files and folders through Spark's own file systems, so that paths may lie in any store Spark reads."""

from __future__ import annotations

import re
import uuid
from datetime import date, timedelta

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(sc._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    p, fs = _path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> bool:
    p, fs = _path(spark, old)
    return fs.rename(p, _path(spark, new)[0])


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file under a temporary name and move it over the old one: readers find the old or the new."""
    part, fs = _path(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    sc = spark.sparkContext
    rename = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
    how = sc._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri() if part.toUri().getScheme() else fs.getUri(), sc._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(part), fs.makeQualified(_path(spark, path)[0]), how)


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def latest(spark: SparkSession, folder: str, prefix: str, skip: tuple[str, ...] = ("-latest", "-sample")) -> str | None:
    """The newest ``prefix-YYYY-MM-DD...`` of a folder, by its name."""
    found = [n for n in names(spark, folder) if re.match(re.escape(prefix) + r"-\d{4}-\d\d-\d\d", n) and not any(s in n for s in skip)]
    return f"{folder}/{max(found)}" if found else None


def since(spark: SparkSession, folder: str, prefix: str, today: date, days: int) -> list[str]:
    """The ``prefix-YYYYMMDD-...`` files of the last ``days`` days, by their names: older ones are never opened."""
    first = (today - timedelta(days=days)).strftime("%Y%m%d")
    pattern = re.compile(re.escape(prefix) + r"-(\d{8})\b")
    return [f"{folder}/{n}" for n in names(spark, folder) if (m := pattern.match(n)) and m[1] >= first]
