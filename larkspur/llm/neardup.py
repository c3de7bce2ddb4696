"""Near-duplicate documents: MinHash, banding, signature and exact verification, alternating-star components.

1. Each document gets the digest of its word sequence, minima of many universal hashes over its distinct 5-word
   shingles (bands of them, and one byte of each as signature). Documents of equal word sequences form a class; only its
   smallest id goes on.
2. Bands that two or more representatives share are buckets. Every member is paired with the bucket's smallest id only,
   so a bucket of any size gives a linear number of pairs. Pairs pass the signature test, then the test on full sets.
3. Components of these links are found by alternating large-star and small-star. In buckets that still hold several
   components, members that can have no link there go (an exact bound by the shingles that no other member document
   holds), the others are paired with the bucket's most central member, and components are found again.
4. What is left in buckets of several components is pruned again; members outside a bucket's largest component are
   paired with the members of other components, where the bound allows a link. So each pair of a bucket has been tested,
   is ruled out or lies in one component, and no link between components is lost.

Bands are chosen so that a pair at the threshold shares none with a probability of at most ``MISS``.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch, forget, stored, with_python_columns

WORDS = 5
PERCENT = 80
MISS = 1e-6
MAX_MINIMA = 280
SLACK = 0.12  # over five standard deviations of the signature's estimate
SHORT, SHORT_SLACK = 64, 0.27  # minima of the signature kept beside full sets, and five standard deviations of its estimate
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
BLOCK = 128
#: Ids of documents in buckets are broadcast up to this number of rows (about 100 MB); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def band_plan(percent: int) -> tuple[int, int]:
    """(bands, rows a band): the longest bands for which the miss bound holds within ``MAX_MINIMA`` minima."""
    best = None
    for rows in range(1, 20):
        bands = math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** rows)))
        if bands * rows <= MAX_MINIMA or best is None:
            best = bands, rows
    return best


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the text with A-Z in lower case, in UTF-8 (bytes split and lower just so)."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; fewer words make one shingle, none make none."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(WORDS, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64) * GOLDEN
    for k in range(size):
        total = mix(total + h[k : len(words) - size + 1 + k])
    return np.unique(total)


class MinHash:
    """The minima of ``bands * rows`` multiply-add-shift hashes."""

    def __init__(self, percent: int):
        self.bands, self.rows = band_plan(percent)
        rng = np.random.default_rng(20)
        n = self.bands * self.rows
        self.a = rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64) * np.uint64(2)

    def minima(self, shingle: np.ndarray, first: int | None = None) -> np.ndarray:
        """The least value of each hash, or of the ``first`` ones only."""
        a, b = self.a[:first], self.b[:first]
        x = (shingle >> np.uint64(32)) ^ (shingle & np.uint64(0xFFFFFFFF))
        least = np.full(len(a), np.uint64(2**64 - 1))
        for at in range(0, len(x), BLOCK):
            h = x[at : at + BLOCK, None] * a
            h += b
            np.minimum(least, h.min(axis=0), out=least)
        return least >> np.uint64(32)

    def buckets(self, minima: np.ndarray) -> np.ndarray:
        total = np.arange(1, self.bands + 1, dtype=np.uint64) * GOLDEN
        for column in minima.reshape(self.bands, self.rows).T:
            total = mix(total + column)
        return total.astype(np.int64)

    @staticmethod
    def signature(minima: np.ndarray) -> bytes:
        return (minima & np.uint64(255)).astype(np.uint8).tobytes()


def similar_signatures(a: bytes, b: bytes, percent: int, slack: float = SLACK) -> bool:
    same = float((np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).mean())
    return (same - 1 / 256) / (1 - 1 / 256) >= percent / 100 - slack


def linked(a: bytes, b: bytes, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sets of sorted 64-bit hashes."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def fingerprints(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, n_shingles, seq (digest of the word sequence; null without words), signature and buckets."""
    hasher = MinHash(percent)

    def make(texts):
        for text in texts:
            words = words_of(text)
            if not words:
                yield 0, None, None, None
                continue
            own = shingles(words)
            least = hasher.minima(own)
            yield len(own), hashlib.blake2b(b" ".join(words), digest_size=16).digest(), hasher.signature(least), hasher.buckets(least).tolist()

    return with_python_columns(docs, ["text"], {"n_shingles": "long", "seq": "binary", "signature": "binary", "buckets": "array<long>"}, make, drop=("text",))


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star step (neighbours above a node join its least neighbour) or small-star step (those below do)."""
    if large:
        around = edges.union(edges.select("dst", "src"))
        least = around.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("root"))
        moved = around.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("root").alias("dst"))
    else:
        down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        least = down.groupBy("src").agg(F.min("dst").alias("root"))
        moved = down.join(least, "src").select(F.col("dst").alias("src"), F.col("root").alias("dst")).union(least.select("src", F.col("root").alias("dst")))
    return moved.where("src <> dst").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(src, dst): each node that has a smaller node in its component, with the smallest; ``edges`` has src and dst."""
    now = stored(edges.select("src", "dst").where("src <> dst").distinct(), "edges")
    while True:
        then, now = now, stored(star(star(now, large=True), large=False), "edges")
        forget(then)
        # a forest of stars: no node has two roots and no root has a root
        twice = now.groupBy("src").count().where("count > 1").select("src")
        chained = now.select(F.col("dst").alias("src")).join(now.select("src"), "src", "left_semi")
        if twice.union(chained).isEmpty():
            return now


def shingle_sets(docs: DataFrame, ids: DataFrame, percent: int) -> DataFrame:
    """(doc_id, hashes, short): the sorted shingle hashes of the documents of ``ids`` (one row an id), as bytes, and a
    signature of ``SHORT`` minima beside them."""
    hasher = MinHash(percent)

    def made(texts):
        for t in texts:
            own = shingles(words_of(t))
            yield own.astype("<u8").tobytes(), hasher.signature(hasher.minima(own, SHORT))

    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return with_python_columns(docs.select("doc_id", "text").join(few, "doc_id", "left_semi"), ["text"], {"hashes": "binary", "short": "binary"}, made, drop=("text",))


def similar(pairs: DataFrame, prints: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose sizes and signatures allow a link."""
    def side(name):
        return prints.select(F.col("doc_id").alias(name), F.col("n_shingles").alias("n_" + name), F.col("signature").alias("s_" + name))

    def close(sa, sb):
        return ((similar_signatures(x, y, percent),) for x, y in zip(sa, sb, strict=True))

    near = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent).select("a", "b", "s_a", "s_b")
    return stored(with_python_columns(near, ["s_a", "s_b"], {"close": "boolean"}, close, drop=("s_a", "s_b")).where("close").select("a", "b").distinct(), "near-pairs")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose signatures allow a link and whose full shingle sets have it, as a stored table src, dst."""
    def confirm(sa, sb, ha, hb):
        return ((similar_signatures(s, t, percent, SHORT_SLACK) and linked(x, y, percent),) for s, t, x, y in zip(sa, sb, ha, hb, strict=True))

    def side(name):
        return sets.select(F.col("doc_id").alias(name), F.col("short").alias("s_" + name), F.col("hashes").alias("h_" + name))

    both, read = pairs.join(side("a"), "a").join(side("b"), "b"), ("s_a", "s_b", "h_a", "h_b")
    return stored(with_python_columns(both, list(read), {"ok": "boolean"}, confirm, drop=read).where("ok").select(F.col("b").alias("src"), F.col("a").alias("dst")).distinct(), "links")


def placed(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """``buckets`` with the root of each member's component."""
    return buckets.drop("first").join(roots.select(F.col("src").alias("doc_id"), F.col("dst").alias("found")), "doc_id", "left").withColumn("root", F.coalesce("found", "doc_id")).drop("found")


def several(members: DataFrame) -> DataFrame:
    """The rows of those buckets that hold more than one component."""
    roots = stored(members.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket"), "several")
    return members.join(roots, "bucket")


def shingle_rows(sets: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_id, shingle) of the documents of ``members``."""
    def unpacked(hashes):
        return ((np.frombuffer(h, "<i8").tolist(),) for h in hashes)

    wanted = sets.drop("short").join(members.select("doc_id").distinct(), "doc_id", "left_semi")
    return with_python_columns(wanted, ["hashes"], {"own": "array<long>"}, unpacked, drop=("hashes",)).select("doc_id", F.explode("own").alias("shingle")).distinct()


def prune(members: DataFrame, shingle: DataFrame, percent: int) -> DataFrame:
    """``members`` (bucket, doc_id, root, n) that can still have a link in their bucket, with c.

    c is the number of a document's shingles that another member document holds too; it bounds every intersection. So a
    partner y needs n(y) <= c * (100 + percent) / percent - n, and a document whose bucket has none so small has no link.
    """
    lone = shingle.join(members.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("shingle").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("held")).where("held = 1")
    private = stored(lone.groupBy("doc_id").agg(F.count("*").alias("private")), "private-shingles")
    bounded = members.join(private, "doc_id", "left").withColumn("c", F.col("n") - F.coalesce("private", F.lit(0))).drop("private")
    least = stored(members.groupBy("bucket").agg(F.min("n").alias("least")), "least-sizes")
    return several(bounded.join(least, "bucket").where(F.col("c") * (100 + percent) >= percent * (F.col("n") + F.col("least"))).drop("least"))


def near_duplicate_roots(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored tables: the fingerprints of all rows, (doc_id, rep) of copies, and (src, dst) of nodes under a smaller one."""
    every = stored(fingerprints(docs, percent), "fingerprints")
    prints = every.where(F.col("seq").isNotNull() & F.col("doc_id").isNotNull())

    # one text an id
    texts = prints.groupBy("doc_id").agg(F.min("seq").alias("own"), F.max("seq").alias("last")).where("own < last").select("doc_id", "own")
    texts = stored(texts, "ids-of-several-texts")
    if not texts.isEmpty():
        prints = stored(prints.join(texts, "doc_id", "left").where("own IS NULL OR own = seq").drop("own"), "one-text-an-id")
        docs = docs.join(prints.select("doc_id", "text_hash").distinct(), ["doc_id", "text_hash"], "left_semi")

    # classes of equal word sequences
    classes = stored(prints.groupBy("seq").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last").select("seq", "rep"), "classes")
    copies = stored(prints.select("doc_id", "seq").join(classes, "seq").where("doc_id <> rep").select("doc_id", "rep").distinct(), "copies")
    reps = prints.join(copies.select("doc_id"), "doc_id", "left_anti")

    # buckets with two representatives or more
    rows = reps.select("doc_id", F.explode("buckets").alias("bucket"))
    shared = stored(rows.groupBy("bucket").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("bucket", "first"), "shared-buckets")
    buckets = stored(rows.join(shared, "bucket").select("bucket", "doc_id", "first").distinct(), "buckets")

    # first round: every member with its bucket's smallest id
    tried = stored(buckets.where("doc_id > first").select(F.col("first").alias("a"), F.col("doc_id").alias("b")).distinct(), "pairs")
    sets = stored(shingle_sets(docs, stored(buckets.select("doc_id").distinct(), "bucket-members"), percent), "shingle-sets")
    links = verified(similar(tried, prints, percent), sets, percent)
    roots = components(links)

    # buckets that still hold several components: prune, link by central members, prune again, then pair the rest
    sizes = prints.select("doc_id", F.col("n_shingles").alias("n")).distinct()
    mixed = stored(several(placed(buckets, roots).join(sizes, "doc_id")), "mixed-buckets")
    members = stored(shingle_rows(sets, mixed), "member-shingles")
    mixed = stored(prune(mixed, members, percent), "pruned-buckets")
    central = stored(mixed.groupBy("bucket").agg(F.min(F.struct(F.col("n") - F.col("c"), F.col("doc_id")))["doc_id"].alias("centre")), "centres")
    spokes = mixed.join(central, "bucket").where("doc_id <> centre").select(F.least("doc_id", "centre").alias("a"), F.greatest("doc_id", "centre").alias("b"))
    more = verified(similar(spokes.distinct().join(tried, ["a", "b"], "left_anti"), prints, percent), sets, percent)
    if not more.isEmpty():
        roots = components(roots.union(more))
        mixed = several(placed(mixed.drop("root", "c"), roots))
    mixed = stored(prune(mixed.drop("c"), members, percent), "pruned-buckets")
    largest = mixed.groupBy("bucket", "root").agg(F.count("*").alias("held")).groupBy("bucket").agg(F.max(F.struct("held", "root"))["root"].alias("main"))
    mixed = stored(mixed.join(largest, "bucket").join(prints.select("doc_id", "buckets").distinct(), "doc_id"), "mixed-buckets")
    left = mixed.where("root <> main").select("bucket", *(F.col(k).alias("x_" + k) for k in ("doc_id", "root", "n", "c", "buckets")))
    right = mixed.select("bucket", "main", *(F.col(k).alias("y_" + k) for k in ("doc_id", "root", "n", "c", "buckets")))
    possible = F.least("x_c", "y_c") * (100 + percent) >= percent * (F.col("x_n") + F.col("y_n"))
    # a pair comes out of the least bucket that it shares, once
    once = ((F.col("y_root") == F.col("main")) | (F.col("x_doc_id") < F.col("y_doc_id"))) & (F.array_min(F.array_intersect("x_buckets", "y_buckets")) == F.col("x.bucket"))
    crossed = left.alias("x").join(right.alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x_root") != F.col("y_root")) & possible & once)
    pairs = crossed.select(F.least("x_doc_id", "y_doc_id").alias("a"), F.greatest("x_doc_id", "y_doc_id").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    # signatures and sets in one pass: the bound has left few of these
    more = verified(stored(pairs, "crossed-pairs"), sets, percent)
    if not more.isEmpty():
        roots = components(roots.union(more))
    return every, copies, roots


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that are kept: of each component the document with the smallest id."""
    gone = near_duplicates(docs, id_col, text_col, percent).where(~F.col("kept")).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable over links) and kept.

    Documents without a word are linked with nothing. Rows repeated with one id are one document and each keep a row; of
    different texts under one id that with the least digest stands for it. Rows without an id are linked with nothing:
    null component, kept. Texts of any length are read whole. Pairs at the threshold are linked; of documents that tie
    in a choice the smallest id is taken. An empty table gives no rows; other columns are ignored.
    """
    with Scratch() as scratch:
        every, copies, roots = near_duplicate_roots(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash")), percent)
        for table in (every, copies, roots):
            scratch.keep(table)
    own_copy = copies.groupBy("doc_id").agg(F.min("rep").alias("rep"))
    placed_copies = every.select("doc_id", "n_shingles").join(own_copy, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    return (
        placed_copies.join(roots.select(F.col("src").alias("rep"), F.col("dst").alias("root")), "rep", "left")
        .select("doc_id", "n_shingles", F.coalesce("root", "rep").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
