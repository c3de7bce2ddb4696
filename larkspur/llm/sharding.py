"""Sharding by best-fit-decreasing bin packing of indivisible groups.

A group is all rows with equal text (null counts as empty); it is never split over shards. Every group is packed by its
own size, however small. Groups of equal size are alike to the packing, so the driver packs classes, a size and the
number of groups that have it: when a group goes into the tightest bin that fits, the next one of its size goes there
as long as it fits, which is what packing them one by one does. Different sizes sum up, so there are at most
sqrt(2 * bytes) classes (250,000 for 30 GB, in practice the number of different text lengths). The groups of a class get
ranks, and the packing's answer is which ranks go to which shard.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import forget, stored

#: Groups of a class are ranked in parts of about so many.
RANKED = 4096
#: Groups with more than 1/HOT of all rows (so at most HOT of them) join their rows by broadcast.
HOT = 4096
#: Classes up to this number are broadcast to the groups; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


class CapacityTree:
    """AVL tree of open bins keyed by (remaining capacity, bin number); finds the tightest bin that still fits."""

    class _Node:
        __slots__ = ("key", "left", "right", "height")

        def __init__(self, key):
            self.key, self.left, self.right, self.height = key, None, None, 1

    def __init__(self):
        self.root = None

    @staticmethod
    def _h(n):
        return n.height if n else 0

    def _fix(self, n):
        n.height = 1 + max(self._h(n.left), self._h(n.right))
        lean = self._h(n.left) - self._h(n.right)
        if lean > 1:
            if self._h(n.left.left) < self._h(n.left.right):
                n.left = self._rotate(n.left, "right", "left")
            return self._rotate(n, "left", "right")
        if lean < -1:
            if self._h(n.right.right) < self._h(n.right.left):
                n.right = self._rotate(n.right, "left", "right")
            return self._rotate(n, "right", "left")
        return n

    def _rotate(self, n, up, down):
        child = getattr(n, up)
        setattr(n, up, getattr(child, down))
        setattr(child, down, n)
        n.height = 1 + max(self._h(n.left), self._h(n.right))
        child.height = 1 + max(self._h(child.left), self._h(child.right))
        return child

    def add(self, key):
        def put(n):
            if n is None:
                return self._Node(key)
            if key < n.key:
                n.left = put(n.left)
            else:
                n.right = put(n.right)
            return self._fix(n)

        self.root = put(self.root)

    def remove(self, key):
        def cut(n, key):
            if key < n.key:
                n.left = cut(n.left, key)
            elif key > n.key:
                n.right = cut(n.right, key)
            elif n.left is None or n.right is None:
                return n.left or n.right
            else:
                heir = n.right
                while heir.left:
                    heir = heir.left
                n.key = heir.key
                n.right = cut(n.right, heir.key)
            return self._fix(n)

        self.root = cut(self.root, key)

    def tightest(self, size):
        """Smallest (remaining, bin) with remaining >= size, or None."""
        n, best = self.root, None
        while n:
            if n.key[0] >= size:
                best, n = n.key, n.left
            else:
                n = n.right
        return best


def best_fit_decreasing(classes: Iterable[tuple[int, int]], capacity: int, most: int | None = None) -> dict[int, list[tuple[int, int]]] | None:
    """{size: [(bin, number of items), ...]} of items given as (size, count) with sizes all different.

    Items by falling size go into the tightest bin, a new one only when none fits; the items of a class are put into a
    bin as many at once as one by one would follow each other there. None as soon as more than ``most`` bins are open.
    """
    tree, bins, placed = CapacityTree(), 0, {}
    for size, count in sorted(classes, reverse=True):
        own = placed[size] = []
        while count:
            found = tree.tightest(size)
            if found is None:
                found, bins = (capacity, bins), bins + 1
                if most is not None and bins > most:
                    return None
            else:
                tree.remove(found)
            taken = min(count, max(found[0] // size, 1))
            tree.add((found[0] - taken * size, found[1]))
            own.append((found[1], taken))
            count -= taken
    return placed


def balanced_packing(classes: Iterable[tuple[int, int]], shards: int) -> dict[int, list[tuple[int, int]]]:
    """{size: [(shard, number of items), ...]} with at most ``shards`` bins of the least capacity that best fit can meet.

    An item above the mean of what is left gets a shard of its own, so that one huge group does not set the
    capacity of all the others.
    """
    rest, alone, first = sorted(classes, reverse=True), {}, 0
    left = sum(size * count for size, count in rest)
    while rest and shards - first > 1 and rest[0][0] * (shards - first) > left:
        size, count = rest.pop(0)
        alone.setdefault(size, []).append((first, 1))
        first, left = first + 1, left - size
        if count > 1:
            rest.insert(0, (size, count - 1))
    if not rest:
        return alone
    n = shards - first
    low, high = max(-(-left // n), rest[0][0]), left
    best = None
    while low < high:
        middle = (low + high) // 2
        tried = best_fit_decreasing(rest, middle, n)
        if tried is not None:
            high, best = middle, tried
        else:
            low = middle + 1
        if best is not None and high - low <= max(1, low // 100_000):
            break
    best = best if best is not None else best_fit_decreasing(rest, high)
    return {size: alone.get(size, []) + [(b + first, k) for b, k in best.get(size, [])] for size in {**alone, **best}}


def shards_of_groups(groups: DataFrame, shards: int) -> DataFrame:
    """``groups`` (grp, bytes, rows) with the shard of each: packed by classes, dealt out within a class by rank."""
    spark = groups.sparkSession
    classes = [(r.bytes, r.n) for r in groups.groupBy("bytes").agg(F.count("*").alias("n")).toLocalIterator()]
    counts, cuts = dict(classes), []
    for size, parts in balanced_packing(classes, shards).items():
        at, starts = 0, []
        for shard, taken in parts:
            starts.append((at, shard))
            at += taken
        cuts.append((size, -(-counts[size] // RANKED), starts))
    table = spark.createDataFrame(cuts, "bytes long, parts long, starts array<struct<start: long, shard: int>>")
    table = F.broadcast(table) if len(cuts) <= BROADCAST_ROWS else table
    # a class that lies in one shard needs no ranks
    whole = groups.join(table, "bytes").withColumn("part", F.pmod(F.xxhash64("grp"), "parts"))
    simple = whole.where(F.size("starts") == 1).select("grp", "rows", F.col("starts")[0]["shard"].alias("shard"))
    split = stored(whole.where(F.size("starts") > 1).select("grp", "rows", "bytes", "part", "starts"), "shard-classes")
    sizes = split.groupBy("bytes", "part").agg(F.count("*").alias("n"))
    ahead = sizes.select(F.col("bytes").alias("of_bytes"), F.col("part").alias("of_part"), (F.sum("n").over(Window.partitionBy("bytes").orderBy("part")) - F.col("n")).alias("ahead"))
    ranked = split.withColumn("own", F.row_number().over(Window.partitionBy("bytes", "part").orderBy("grp")) - 1)
    ranked = ranked.join(ahead, (F.col("bytes") == F.col("of_bytes")) & (F.col("part") == F.col("of_part"))).withColumn("rank", F.col("ahead") + F.col("own"))
    chosen = F.element_at(F.filter("starts", lambda s: s["start"] <= F.col("rank")), -1)["shard"]
    homes = stored(simple.unionByName(ranked.select("grp", "rows", chosen.alias("shard"))), "shard-homes")
    forget(split)
    return homes


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size (UTF-8 bytes + 1), text_crc32, shard and a gapless slot within the shard.

    Null text counts as empty text; texts of any length are sized whole and never moved; rows repeated with the same id
    keep one slot each; an empty table gives no rows; groups that tie in size are dealt out by their hash, slots go by
    a hash of the id, then by the id and the text's hash. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("grp"),
    )
    rows = stored(rows, "shard-rows")
    n_rows = rows.count()
    groups = stored(rows.groupBy("grp").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "shard-groups")
    homes = shards_of_groups(groups, shards)
    forget(groups)
    hot = F.col("rows") * HOT > n_rows
    few = F.broadcast(homes.where(hot).select("grp", F.col("shard").alias("hot_shard")))
    rest = homes.where(~hot).select("grp", "shard")
    buckets = max(1024, min(65536, n_rows // RANKED // shards))
    kept = ("doc_id", "size", "text_crc32", "grp")
    known = rows.join(few, "grp", "left")
    assigned = (
        known.where(F.col("hot_shard").isNotNull()).select(*kept, F.col("hot_shard").alias("shard"))
        .unionByName(known.where(F.col("hot_shard").isNull()).select(*kept).join(rest, "grp").select(*kept, "shard"))
        .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), F.lit(buckets)).cast("int"))
    )
    assigned = stored(assigned, "shard-assigned")
    counts = {(r.shard, r.bucket): r.n for r in assigned.groupBy("shard", "bucket").agg(F.count("*").alias("n")).toLocalIterator()}
    starts, at = [], dict.fromkeys(range(shards), 0)
    for shard, bucket in sorted(counts):
        starts.append((shard, bucket, at[shard]))
        at[shard] += counts[shard, bucket]
    offsets = F.broadcast(spark.createDataFrame(starts, "shard int, bucket int, start long"))
    forget(rows)
    forget(homes)
    local = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "grp", "size"))
    return (
        assigned.withColumn("local", local).join(offsets, ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("local") - 1).alias("slot"))
    )
