"""Small file compaction plan by square-root exit pointers.

A row's file is (source, block, slot), all from its id. Dirty and small files of a source are packed in order, each into
the last group or, where that would pass ``CAPACITY`` live bytes, into a new one: a chain in which each group's start
follows from the one before. The chain of a source may have any length, so it is not followed file by file:

- ``FILE_BLOCKS`` neighbouring blocks make a node; each node computes, for every file that a group may start with, the
  last group start of that chain inside the node, and from it the byte place at which the chain goes on;
- these places are looked up among all files of the source at once, which makes exit pointers from node to node;
- ``FAN`` nodes make a larger node, whose exits follow from theirs, until one node is left to a source;
- from the top the visited start of each node is handed down, and the nodes entered expand their chains in parallel.

Groups are queued in a global order that is dealt out in ranges. Texts are hashed in order as they stream by.
No step holds more than a node, a stretch of ``CAPACITY`` bytes or one count a range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import Scratch, small_batches, stored

CAPACITY = 131072
ROWS_PER_BLOCK = 2000
#: Blocks of a node of the lowest level (eight files each at most), and nodes of a node above it.
FILE_BLOCKS = 16
FAN = 32
FILE = ["source", "block", "slot"]
#: Per cent of a file's rows that make it dirty, of the capacity under which it is small, of the queue that is rewritten.
DIRTY, SMALL, REWRITTEN = 50, 75, 30
FILE_COST = 4096
WAVE = 4
#: What an exit pointer leads to: nothing, a named file, or the first file of the next node.
END, NAMED, FOLLOWING = 0, 1, 2
POINTER = "source string, node long, block long, slot long, kind int, to_block long, to_slot long"


def files_of(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Rows with the file they lie in (source, block, slot) and whether they are deleted."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = rows.withColumn("h", h).withColumn("block", F.expr(f"doc_id div {ROWS_PER_BLOCK} - if(doc_id % {ROWS_PER_BLOCK} < 0, 1, 0)"))
    rows = rows.withColumn("slot", F.expr("least(h % 8, (h div 8) % 8)"))
    return rows.withColumn("deleted", F.expr("(h div 64) % 100 < 9 * pmod(slot + block, 8)")).drop("h")


def file_sizes(rows: DataFrame) -> DataFrame:
    size, live = F.octet_length("text").cast("long"), ~F.col("deleted")
    files = rows.groupBy(*FILE).agg(
        F.count("*").alias("n"), F.sum(size).alias("bytes"), F.count_if(live).alias("live_rows"), F.sum(F.when(live, size).otherwise(0)).alias("live_bytes")
    )
    return files.withColumn("dirty", 100 * (F.col("n") - F.col("live_rows")) >= DIRTY * F.col("n")).withColumn("small", 100 * F.col("bytes") < SMALL * CAPACITY)


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join that never sends a side to all workers: both grow with the input."""
    return left.join(right.hint("merge"), on, how)


def above(node: Column) -> Column:
    return F.floor(node / FAN)


def running(files: DataFrame, value: str, name: str, levels: int) -> DataFrame:
    """Adds the sum of ``value`` over the files of the source up to each one, itself included: sums by nodes, and of these
    by nodes of nodes, so that no window holds more than a node."""
    sums = [files.groupBy("source", "node").agg(F.sum(value).alias("n"))]
    for _ in range(levels):
        sums.append(sums[-1].groupBy("source", above(F.col("node")).alias("node")).agg(F.sum("n").alias("n")))
    ahead = sums[levels].select("source", "node", F.lit(0).cast("long").alias("ahead"))
    for level in reversed(range(levels)):
        before = F.sum("n").over(Window.partitionBy("source", "parent").orderBy("node").rowsBetween(Window.unboundedPreceding, -1))
        nodes = sums[level].withColumn("parent", above(F.col("node"))).withColumn("before", F.coalesce(before, F.lit(0)))
        ahead = joined(nodes, ahead.withColumnRenamed("node", "parent"), ["source", "parent"]).select("source", "node", (F.col("ahead") + F.col("before")).alias("ahead"))
    within = F.sum(value).over(Window.partitionBy("source", "node").orderBy("block", "slot").rowsBetween(Window.unboundedPreceding, 0))
    return joined(files.withColumn("within", within), ahead, ["source", "node"]).withColumn(name, F.col("ahead") + F.col("within")).drop("ahead", "within")


def next_starts(live: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """For a group that starts at each file: the place of the first file that would not fit any more (n if all fit)."""
    return np.maximum(np.searchsorted(upto, upto - live + CAPACITY, side="right"), np.arange(1, len(live) + 1))


def node_exits(files: pd.DataFrame) -> pd.DataFrame:
    """For every file as a group start: the byte place at which the chain leaves the node, or that the last group is
    one file over the capacity, which the very next file leaves (following)."""
    files = files.sort_values(["block", "slot"])
    live, upto = files.live_bytes.to_numpy(), files.upto.to_numpy()
    n = len(live)
    after, last = next_starts(live, upto), np.arange(n)
    for i in range(n - 1, -1, -1):
        if after[i] < n:
            last[i] = last[after[i]]
    return pd.DataFrame({"source": files.source, "node": files.node, "block": files.block, "slot": files.slot, "place": (upto - live + CAPACITY)[last], "following": (live > CAPACITY)[last]})


def found_files(files: DataFrame, places: DataFrame) -> DataFrame:
    """(source, place, to_block, to_slot): the file whose bytes hold each place; no row past the source's end.

    Places and files meet in stretches of ``CAPACITY`` bytes. A file without live bytes holds no place.
    """
    first, end = F.col("upto") - F.col("live_bytes"), F.col("upto")
    stretch = F.explode(F.sequence(F.expr(f"(upto - live_bytes) div {CAPACITY}"), F.expr(f"(upto - 1) div {CAPACITY}")))
    held = files.where("live_bytes > 0").select("source", stretch.alias("stretch"), first.alias("at"), F.lit(0).alias("asks"), F.struct("block", "slot", end.alias("end")).alias("file"))
    asked = places.select("source", F.expr(f"place div {CAPACITY}").alias("stretch"), F.col("place").alias("at"), F.lit(1).alias("asks"), F.lit(None).cast(held.schema["file"].dataType).alias("file"))
    latest = F.last("file", ignorenulls=True).over(Window.partitionBy("source", "stretch").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0))
    both = held.unionByName(asked).withColumn("found", latest)
    return both.where((F.col("asks") == 1) & (F.col("found.end") > F.col("at"))).select("source", F.col("at").alias("place"), F.col("found.block").alias("to_block"), F.col("found.slot").alias("to_slot"))


def entries_only(pointers: DataFrame) -> DataFrame:
    """The pointers of files at which a chain can enter a node: its first one, and those that other pointers name."""
    first = pointers.groupBy("source", "node").agg(F.min(F.struct("block", "slot")).alias("f")).select("source", "f.block", "f.slot")
    named = pointers.where(F.col("kind") == NAMED).select("source", F.col("to_block").alias("block"), F.col("to_slot").alias("slot"))
    return joined(pointers, first.union(named).distinct(), FILE, "left_semi").select("source", "node", "block", "slot", "kind", "to_block", "to_slot")


def file_pointers(files: DataFrame) -> DataFrame:
    """Exit pointers of the lowest nodes."""
    exits = stored(files.groupBy("source", "node").applyInPandas(node_exits, "source string, node long, block long, slot long, place long, following boolean"), "exits")
    found = found_files(files, exits.where("not following").select("source", "place").distinct())
    kind = F.when(F.col("following"), FOLLOWING).when(F.col("to_block").isNotNull(), NAMED).otherwise(END)
    met = joined(exits, found, ["source", "place"], "left").withColumn("named", ~F.col("following") & F.col("to_block").isNotNull())
    to = [F.when(F.col("named"), F.col(c)).otherwise(0).cast("long").alias(c) for c in ("to_block", "to_slot")]
    pointers = stored(met.select("source", "node", "block", "slot", kind.cast("int").alias("kind"), *to), "file-pointers")
    return stored(entries_only(pointers), "entry-pointers")


def targets(pointers: pd.DataFrame) -> tuple[list, list, list]:
    """Files of a larger node in order, the node of each, and where each one's pointer leads (a place in the list, -1 for
    a named file outside, -2 for the file that follows the last one's node, -3 for the end)."""
    pointers = pointers.sort_values(["block", "slot"])
    files, nodes = list(zip(pointers.block, pointers.slot, strict=True)), list(pointers.node)
    places, to, following = {f: i for i, f in enumerate(files)}, [0] * len(files), -2
    rows = list(zip(pointers.kind, pointers.to_block, pointers.to_slot, strict=True))
    for i in range(len(files) - 1, -1, -1):
        if i + 1 < len(files) and nodes[i] != nodes[i + 1]:
            following = i + 1
        kind, *named = rows[i]
        to[i] = following if kind == FOLLOWING else places.get(tuple(named), -1) if kind == NAMED else -3
    return files, nodes, to


def composed(pointers: pd.DataFrame) -> pd.DataFrame:
    """Exit pointers of a larger node from those of its nodes (both of one source)."""
    pointers = pointers.sort_values(["block", "slot"])
    _, _, to = targets(pointers)
    last = list(range(len(to)))
    for i in range(len(to) - 1, -1, -1):
        if to[i] >= 0:
            last[i] = last[to[i]]
    out = pointers[["source", "parent", "block", "slot"]].rename(columns={"parent": "node"})
    for c in ("kind", "to_block", "to_slot"):
        out[c] = pointers[c].to_numpy()[last]
    return out


def entered(pointers: pd.DataFrame) -> pd.DataFrame:
    """The nodes that a chain enters from the larger node's own start, and the file at which it enters each."""
    files, nodes, to = targets(pointers)
    at = files.index((pointers.start_block.iloc[0], pointers.start_slot.iloc[0]))
    seen = []
    while at >= 0:
        seen.append((pointers.source.iloc[0], nodes[at], *files[at]))
        at = to[at]
    return pd.DataFrame(seen, columns=["source", "node", "start_block", "start_slot"])


def expanded(files: pd.DataFrame) -> pd.DataFrame:
    """The group starts of an entered node, from the file at which it is entered."""
    files = files.sort_values(["block", "slot"])
    after = next_starts(files.live_bytes.to_numpy(), files.upto.to_numpy())
    at = int(np.flatnonzero((files.block == files.start_block) & (files.slot == files.start_slot))[0])
    seen = []
    while at < len(after):
        seen.append(at)
        at = after[at]
    return files.iloc[seen][FILE].assign(starts=1)


def group_starts(files: DataFrame, levels: int) -> DataFrame:
    """(source, block, slot, starts) of the files with which groups start."""
    entry, steps = "source string, node long, start_block long, start_slot long", []
    pointers = file_pointers(files) if levels else None
    for level in range(levels):
        steps.append(pointers.withColumn("parent", above(F.col("node"))))
        if level + 1 < levels:
            pointers = stored(entries_only(stored(steps[-1].groupBy("source", "parent").applyInPandas(composed, POINTER), "larger-pointers")), "larger-entries")
    first = files.groupBy("source").agg(F.min(F.struct("block", "slot")).alias("f"))
    visits = first.select("source", F.lit(0).cast("long").alias("node"), F.col("f.block").alias("start_block"), F.col("f.slot").alias("start_slot"))
    for step in reversed(steps):
        walked = joined(step, visits.withColumnRenamed("node", "parent"), ["source", "parent"])
        visits = stored(walked.groupBy("source", "parent").applyInPandas(entered, entry), "visits")
    return joined(files, visits, ["source", "node"]).groupBy("source", "node").applyInPandas(expanded, "source string, block long, slot long, starts long")


def queued(groups: DataFrame) -> DataFrame:
    """(source, first_block, first_slot, wave) of the groups to rewrite: the longest prefix of the queue within its share.

    The queue is cut into ranges, as many as the session's shuffle partitions; of each the driver sees its sums.
    """
    spark = groups.sparkSession
    order = [F.col("n_files").desc(), F.col("bytes").asc(), *(F.col(c).asc() for c in ("source", "first_block", "first_slot"))]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    queue = groups.where((F.col("n_files") > 1) | F.col("dirty")).select("source", "first_block", "first_slot", "n_files", "bytes")
    queue = stored(queue.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "queue")
    ahead, places, total = [], 0, 0
    for r in sorted(queue.groupBy("range").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect()):
        ahead.append((r["range"], places, total))
        places, total = places + r["n"], total + r["bytes"]
    ahead = F.broadcast(spark.createDataFrame(ahead, "range int, places_ahead long, bytes_ahead long"))
    window = Window.partitionBy("range").orderBy(*order)
    upto = F.sum("bytes").over(window.rowsBetween(Window.unboundedPreceding, 0)) + F.col("bytes_ahead")
    place = F.row_number().over(window) - 1 + F.col("places_ahead")
    placed = queue.join(ahead, "range").withColumn("upto", upto).withColumn("wave", F.floor(place / WAVE))
    return placed.where(100 * F.col("upto") <= REWRITTEN * total).select("source", "first_block", "first_slot", "wave")


def streamed_digests(rows: DataFrame, unit: list[str]) -> DataFrame:
    """unit and live_sha256, the digest of ``doc_id:text\\n`` of its rows by doc_id (repeated ids by text), of any size."""
    small_batches(rows.sparkSession)
    ordered = rows.repartition(*unit).sortWithinPartitions(*unit, "doc_id", "text")
    schema = rows.select(*unit).schema.add("live_sha256", "string")
    arrow = pa.schema([(unit[0], pa.string()), *((c, pa.int64()) for c in unit[1:]), ("live_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            done = []
            for *own, doc_id, text in zip(*(batch.column(c).to_pylist() for c in (*unit, "doc_id", "text")), strict=True):
                if own != key:
                    if key is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = own, hashlib.sha256()
                digest.update(f"{doc_id}:{text}\n".encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(arrow.types)], schema=arrow)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key, digest.hexdigest()), arrow.types, strict=True)], schema=arrow)

    return ordered.select(*unit, "doc_id", "text").mapInArrow(run, schema)


def compaction_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per rewritten group or untouched file: source, block and slot of its first file, n_files, live_rows, bytes,
    cost and wave (both null if untouched), live_sha256, and live_bytes.

    Null source or text is empty. A row without an id has no file and is left out. A file without live bytes joins any
    group but one that starts with a file over the capacity. Rows repeated with one id each count and are hashed in the
    order of their texts; groups that tie in the queue go by source, block and slot; ids may be negative. Texts of any
    length are hashed as they stream by. An empty table gives no rows; other columns are ignored.
    """
    with Scratch() as scratch:
        rows = files_of(docs, id_col, text_col, source_col)
        files = scratch.keep(stored(file_sizes(rows), "files"))
        low, high = files.agg(F.min("block"), F.max("block")).first()
        levels, nodes = 0, ((high or 0) - (low or 0)) // FILE_BLOCKS
        while nodes:
            levels, nodes = levels + 1, nodes // FAN
        packed = files.where("dirty or small").withColumn("node", F.expr(f"(block - {low or 0}L) div {FILE_BLOCKS}"))
        packed = stored(running(packed, "live_bytes", "upto", levels), "packed")
        starts = stored(group_starts(packed, levels), "group-starts")
        members = joined(packed, starts, FILE, "left").withColumn("starts", F.coalesce("starts", F.lit(0)))
        members = stored(running(members, "starts", "grp", levels), "members")
        groups = members.groupBy("source", "grp").agg(
            F.count("*").alias("n_files"), F.sum("bytes").alias("bytes"), F.sum("live_bytes").alias("live_bytes"), F.sum("live_rows").alias("live_rows"), F.bool_or("dirty").alias("dirty"), F.min(F.struct("block", "slot")).alias("f")
        )
        groups = stored(groups.select("*", F.col("f.block").alias("first_block"), F.col("f.slot").alias("first_slot")).drop("f"), "groups")
        chosen = joined(groups, queued(groups), ["source", "first_block", "first_slot"])
        chosen = scratch.keep(stored(chosen.withColumn("cost", F.col("bytes") + F.col("live_bytes") + FILE_COST * F.col("n_files")), "rewritten"))
        moved = joined(members.select("source", "grp", "block", "slot"), chosen.select("source", "grp", "first_block", "first_slot"), ["source", "grp"]).drop("grp")
        homes = joined(files.select(*FILE), moved, FILE, "left").select(*FILE, *(F.coalesce(f"first_{c}", c).alias(f"first_{c}") for c in ("block", "slot")), F.col("first_block").isNull().alias("untouched"))
        homes = scratch.keep(stored(homes, "homes"))
    unit = ["source", "first_block", "first_slot"]
    columns = [*unit, "n_files", "live_rows", "bytes", "cost", "wave", "live_bytes"]
    left = joined(files, homes.where("untouched").select(*FILE), FILE, "left_semi")
    none = F.lit(None).cast("long")
    left = left.select("source", F.col("block").alias("first_block"), F.col("slot").alias("first_slot"), F.lit(1).cast("long").alias("n_files"), "live_rows", "bytes", none.alias("cost"), none.alias("wave"), "live_bytes")
    live = rows.where("not deleted").join(homes.drop("untouched").hint("shuffle_hash"), FILE).select(*unit, "doc_id", "text")
    units = joined(chosen.select(*columns).unionByName(left), streamed_digests(live, unit), unit, "left")
    return units.select("source", F.col("first_block").alias("block"), F.col("first_slot").alias("slot"), *columns[3:8], F.coalesce("live_sha256", F.sha2(F.lit(b""), 256)).alias("live_sha256"), "live_bytes")
