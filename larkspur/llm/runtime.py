"""Shared-folder tables: how operators cut lineage so that a lost executor costs a re-read, not a re-run."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import ClassVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from ..session import shared_dir


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/larkspur-{label}-{uuid.uuid4().hex}"


class Scratch:
    """Tables stored within a ``with`` block are deleted at its end, but for those that ``keep`` names.

    What a block returns must read kept tables only, as results are computed later. A block within another hands on
    what it keeps.
    """

    _open: ClassVar[list[Scratch]] = []

    def __init__(self):
        self.made: list[DataFrame] = []
        self.kept: set[str] = set()

    def __enter__(self) -> Scratch:
        Scratch._open.append(self)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.add(df._larkspur_path)
        return df

    def __exit__(self, *_) -> None:
        Scratch._open.pop()
        for df in self.made:
            if df._larkspur_path not in self.kept:
                forget(df)
            elif Scratch._open:
                Scratch._open[-1].made.append(df)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back (a reliable cut of the lineage)."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._larkspur_path = path
    if Scratch._open:
        Scratch._open[-1].made.append(back)
    return back


def forget(df: DataFrame | None) -> None:
    """Delete the folder behind a DataFrame made by ``stored`` once nothing reads it any more."""
    path = getattr(df, "_larkspur_path", None)
    if path is None:
        return
    sc = df.sparkSession.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}
SLICE = 256
BATCH_ROWS = 512
BATCH_BYTES = 32 << 20


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches to ``BATCH_ROWS`` rows and ``BATCH_BYTES``: rows here hold whole texts or sets, and both sides
    buffer a batch. A setting of the session that is smaller stays; a larger one is lowered, for the session's lifetime
    (plans read it when they run)."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        own = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) if "Bytes" in key else int(spark.conf.get(key))
        if not 0 < own <= most:
            spark.conf.set(key, str(most))


def with_python_columns(df: DataFrame, inputs: list[str], outputs: dict[str, str], make: Callable[..., Iterable[tuple]], drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` without ``drop``, plus ``outputs`` (name -> type) computed in Arrow batches.

    ``make`` gets one list for each of ``inputs`` (at most ``SLICE`` rows long) and gives one tuple a row. The other
    columns pass through as Arrow data, untouched (nulls and 64-bit integers included).
    """
    small_batches(df.sparkSession)
    keep = [c for c in df.columns if c not in drop and c not in outputs]
    types = [ARROW[t] for t in outputs.values()]
    schema = T.StructType([df.schema[c] for c in keep])
    for name, kind in zip(outputs, types, strict=True):
        schema = schema.add(name, from_arrow_type(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows = list(make(*(part.column(c).to_pylist() for c in inputs)))
                made = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made], names=[*keep, *outputs])

    return df.mapInArrow(run, schema)
