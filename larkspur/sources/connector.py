"""Connector contract: a source adapter as a Spark data source that replays saved pages, a partition a file.

Files are opened through ``pyarrow.fs``, so that they may lie in any store that all executors reach.
"""

from __future__ import annotations

import io
import json
import os
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "id string, title string, url string, company string, country string, city string, posted_at string, raw string"


class Page(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ReplayReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.names = options, schema.names

    def partitions(self) -> list[InputPartition]:
        return [Page(p) for p in self.options.get("paths", "").split(";") if p]

    def read(self, partition: Page) -> Iterator[tuple]:
        if partition is None or not getattr(partition, "path", None):
            return
        system, place = fs.FileSystem.from_uri(partition.path if "://" in partition.path else os.path.abspath(partition.path))
        with system.open_input_stream(place) as raw, io.TextIOWrapper(raw, encoding="utf-8") as f:
            for line in f:
                try:
                    entry = json.loads(line)
                except json.JSONDecodeError:
                    continue
                if isinstance(entry, dict) and entry.get("id") is not None:
                    yield tuple(line.rstrip("\n") if n == "raw" else None if entry.get(n) is None else str(entry[n]).replace("\x00", "") for n in self.names)


class ReplaySource(DataSource):
    """``spark.read.format("listing_replay").option("paths", "a;b").load()``: a live adapter differs in ``read`` only."""

    @classmethod
    def name(cls) -> str:
        return "listing_replay"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return ReplayReader(self.options, schema)
