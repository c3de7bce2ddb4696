"""Sources as Spark data sources over ``pyarrow.fs``: remote Parquet, members of ZIP files, and a change feed by cursors.

Plans are made from footers and directories only; each task opens its own piece and reads that range. Reads that fail
are tried again after a growing pause. Paths are local, or URIs that ``pyarrow.fs`` knows; ``system`` may name another
file system as ``module:function`` (importable by the workers), which gets the path and returns (system, place).
"""

from __future__ import annotations

import csv
import datetime as dt
import fnmatch
import importlib
import io
import os
import time
import zipfile
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual,
)
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

TRIES, PAUSE = 5, 0.1
BATCH = 10_000


def patiently(work: Callable[[], Any], tries: int = TRIES, pause: float = PAUSE) -> Any:
    """The result of ``work``, tried again after errors of input and output, each time after twice the pause."""
    for n in range(tries):
        try:
            return work()
        except FileNotFoundError:
            raise
        except OSError:
            if n + 1 == tries:
                raise
            time.sleep(pause * 2**n)


def located(path: str, options) -> tuple[fs.FileSystem, str]:
    if named := options.get("system"):
        module, function = named.split(":")
        return getattr(importlib.import_module(module), function)(path)
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def files(options, suffix: str) -> list[str]:
    """The files of the option ``path`` (``;`` between several): files, folders or patterns of names, in order."""
    found = []
    for path in filter(None, options.get("path", "").split(";")):
        system, place = located(path, options)
        folder, name = os.path.split(place.rstrip("/"))
        head = path.rstrip("/")[: -len(name)]
        if any(c in name for c in "*?["):
            found += [head + f.base_name for f in patiently(lambda s=system, d=folder: s.get_file_info(fs.FileSelector(d))) if fnmatch.fnmatch(f.base_name, name)]
        elif patiently(lambda s=system, p=place: s.get_file_info(p)).type == fs.FileType.Directory:
            inside = patiently(lambda s=system, p=place: s.get_file_info(fs.FileSelector(p)))
            found += [f"{path.rstrip('/')}/{f.base_name}" for f in inside if f.base_name.endswith(suffix) and f.base_name[0] not in "._"]
        else:
            found.append(path)
    return sorted(found)


class Piece(InputPartition):
    def __init__(self, path: str, part):
        self.path, self.part = path, part


# -- Parquet ----------------------------------------------------------------------------------------------------------

COMPARED = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


def pushed(f: Filter):
    """A filter as (column, test of an array, may a group with these least and greatest values hold a row), or None."""
    if len(getattr(f, "attribute", ())) != 1:
        return None
    name = f.attribute[0]
    if isinstance(f, IsNotNull):
        return name, pc.is_valid, lambda low, high: True
    if isinstance(f, In):
        values = [v for v in f.value if v is not None]
        return name, lambda a: pc.is_in(a, pa.array(values, a.type)), lambda low, high: any(low <= v <= high for v in values)
    test, value = COMPARED.get(type(f)), getattr(f, "value", None)
    if test is None or value is None or isinstance(value, float) and value != value:
        return None
    may = {EqualTo: lambda low, high: low <= value <= high, GreaterThan: lambda low, high: high > value, GreaterThanOrEqual: lambda low, high: high >= value, LessThan: lambda low, high: low < value, LessThanOrEqual: lambda low, high: low <= value}
    return name, lambda a: test(a, pa.scalar(value, a.type)), may[type(f)]


class ParquetReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.options, self.schema, self.filters = dict(options), schema, []

    def pushFilters(self, filters):
        for f in filters:
            if pushed(f) is not None:
                self.filters.append(f)
            else:
                yield f

    def opened(self, path: str) -> pq.ParquetFile:
        system, place = located(path, self.options)
        return pq.ParquetFile(system.open_input_file(place))

    def partitions(self) -> list[InputPartition]:
        """A partition for each row group that may hold a wanted row, by the statistics of the footers."""
        tests, found = [pushed(f) for f in self.filters], []
        for path in files(self.options, ".parquet"):
            footer = patiently(lambda p=path: self.opened(p).metadata)
            places = {footer.schema.column(i).path: i for i in range(footer.num_columns)}
            for group in range(footer.num_row_groups):
                stats = {name: footer.row_group(group).column(places[name]).statistics for name, *_ in tests if name in places}
                if all(self.may_hold(may, stats.get(name)) for name, _, may in tests):
                    found.append(Piece(path, group))
        return found

    @staticmethod
    def may_hold(may, stats) -> bool:
        try:
            return stats is None or not stats.has_min_max or may(stats.min, stats.max)
        except TypeError:  # statistics of another kind than the value
            return True

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        columns = [f.name for f in self.schema]
        tests = [pushed(f) for f in self.filters]
        asked = list(dict.fromkeys([*columns, *(name for name, *_ in tests)]))
        table = patiently(lambda: self.opened(partition.path).read_row_group(partition.part, columns=asked))
        for name, test, _ in tests:
            table = table.filter(test(table.column(name)))
        yield from table.select(columns).cast(to_arrow_schema(self.schema)).to_batches(BATCH)


class RemoteParquet(DataSource):
    """``spark.read.format("remote_parquet").schema(columns).load(path)``: filters are pushed down (with
    ``spark.sql.python.filterPushdown.enabled``), and only the columns of the given schema are read."""

    @classmethod
    def name(cls) -> str:
        return "remote_parquet"

    def schema(self) -> StructType:
        first = files(self.options, ".parquet")[0]
        return from_arrow_schema(patiently(lambda: ParquetReader(self.options, StructType()).opened(first).schema_arrow))

    def reader(self, schema: StructType) -> DataSourceReader:
        return ParquetReader(self.options, schema)


# -- CSV in ZIP -------------------------------------------------------------------------------------------------------


class ZipReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.options, self.names = dict(options), schema.names

    def archive(self, path: str) -> zipfile.ZipFile:
        system, place = located(path, self.options)
        return zipfile.ZipFile(system.open_input_file(place))

    def partitions(self) -> list[InputPartition]:
        """A partition for each member, from the central directories (the last bytes of each file) alone."""
        suffix = self.options.get("member", ".csv")
        return [Piece(path, name) for path in files(self.options, ".zip") for name in sorted(patiently(lambda p=path: self.archive(p).namelist())) if name.endswith(suffix)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        archive = patiently(lambda: self.archive(partition.path))
        with archive.open(partition.part) as raw, io.TextIOWrapper(raw, encoding=self.options.get("encoding", "utf-8"), newline="") as text:
            part = []
            for row in csv.DictReader(text, delimiter=self.options.get("separator", ",")):
                part.append([row.get(n) for n in self.names])
                if len(part) == BATCH:
                    yield self.batch(part)
                    part = []
            if part:
                yield self.batch(part)

    def batch(self, rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=self.names)


class ZipMembers(DataSource):
    """``format("zip_members")``: rows of the CSV members of ZIP files (ZIP64 too), a task a member, columns as text."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        raise ValueError("name the columns: .schema('a string, b string')")

    def reader(self, schema: StructType) -> DataSourceReader:
        return ZipReader(self.options, schema)


# -- changes ----------------------------------------------------------------------------------------------------------

CHANGES = "event string, id long, t timestamp"
UTC = dt.timezone.utc


def moment(text: str) -> dt.datetime:
    at = dt.datetime.fromisoformat(text)
    return at if at.tzinfo else at.replace(tzinfo=UTC)


class ChangeReader(DataSourceStreamReader):
    """Offsets are cursors: times at which runs started. A batch holds the changes after one cursor, up to the next."""

    def __init__(self, options):
        self.options = dict(options)

    def now(self) -> dt.datetime:
        """The start of this run: the clock, or the time that the file of the option ``clock`` holds."""
        if path := self.options.get("clock"):
            system, place = located(path, self.options)
            with system.open_input_stream(place) as f:
                return moment(f.read().decode().strip())
        return dt.datetime.now(UTC)

    def initialOffset(self) -> dict:
        """The cursor of a stream that has none: the option ``since``, else ``look_back`` seconds (a day) before now."""
        since = self.options.get("since")
        start = moment(since) if since else self.now() - dt.timedelta(seconds=float(self.options.get("look_back", 86_400)))
        return {"cursor": start.isoformat()}

    def latestOffset(self) -> dict:
        return {"cursor": self.now().isoformat()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """Row groups in which a record was opened or closed between the cursors, by their statistics."""
        low, high = moment(start["cursor"]), moment(end["cursor"])
        if low >= high:
            return []
        found = []
        for path in files(self.options, ".parquet"):
            footer = patiently(lambda p=path: self.opened(p).metadata)
            places = {footer.schema.column(i).path: i for i in range(footer.num_columns)}
            for group in range(footer.num_row_groups):
                stats = [footer.row_group(group).column(places[self.options[c]]).statistics for c in ("opened", "closed")]
                if any(s is None or not s.has_min_max or not (self.aware(s.max) <= low or self.aware(s.min) > high) for s in stats):
                    found.append(Piece(path, (group, start["cursor"], end["cursor"])))
        return found

    @staticmethod
    def aware(at: dt.datetime) -> dt.datetime:
        return at if at.tzinfo else at.replace(tzinfo=UTC)

    def opened(self, path: str) -> pq.ParquetFile:
        system, place = located(path, self.options)
        return pq.ParquetFile(system.open_input_file(place))

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        group, low, high = partition.part
        names = [self.options[c] for c in ("id", "opened", "closed")]
        table = patiently(lambda: self.opened(partition.path).read_row_group(group, columns=names))
        kind = pa.timestamp("us", "UTC")
        for event, column in (("new", names[1]), ("closed", names[2])):
            at = table.column(column)
            at = at.cast(kind) if pa.types.is_timestamp(at.type) and at.type.tz else at.cast(pa.timestamp("us")).cast(kind)
            meant = pc.and_(pc.greater(at, pa.scalar(moment(low), kind)), pc.less_equal(at, pa.scalar(moment(high), kind)))
            if event == "new":  # a record that is closed already is not announced any more
                closed = table.column(names[2]).cast(pa.timestamp("us")).cast(kind)
                meant = pc.and_(meant, pc.fill_null(pc.greater(closed, pa.scalar(moment(high), kind)), True))
            rows = pa.table([table.column(names[0]).cast(pa.int64()), at], names=["id", "t"]).filter(meant)
            yield from pa.table([pa.array([event] * rows.num_rows, pa.string()), *rows.columns], names=["event", "id", "t"]).to_batches(BATCH)

    def commit(self, end: dict) -> None:
        """Nothing to do: the cursor of a finished batch is in the stream's own log."""


class ChangeSource(DataSource):
    """``spark.readStream.format("changes")``: events ``new`` and ``closed`` of the records in Parquet files.

    Options: path; id, opened, closed (columns); since or look_back; clock. The cursor moves to the start of a run, so
    changes made while it runs fall to the next one; a batch that failed is read again between the same two cursors.
    """

    @classmethod
    def name(cls) -> str:
        return "changes"

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return ChangeReader(self.options)


def register(spark) -> None:
    for source in (RemoteParquet, ZipMembers, ChangeSource):
        spark.dataSource.register(source)
