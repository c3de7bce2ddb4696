"""Benchmark decontamination by spaced seeds, in Catalyst expressions only.

Each fixed mask picks some neighbouring tokens and ignores others, so a window with replaced words at ignored places
still gives the same hash. The hashes of all windows of all documents are joined with those of the benchmark; each hit
fixes an alignment (document position minus item position). Items that share a seed at one place are one class, so a
document has one hit for all items that begin alike; only the comparison goes through the members of the class. Along the whole alignment the tokens are compared place by
place; an item is found when, in some stretch of ``WINDOW`` of its tokens (all of them if it has fewer), at least
``PERCENT`` of the places agree. Items under ``SPAN`` tokens are found where all their tokens stand word for word.

No overlap is lost. A stretch of 14 tokens may differ at 2 places, one of 15 or 16 at 3: wherever they lie, one of the
two ``MASKS`` fits between them (all cases are enumerated in the tests). The masks share the places of ``COMMON``, so
that a window is one row with one hash to look up, and the masks' own places are compared in windows that pass. Items of
``SPAN`` to ``THIRDS`` tokens may differ at two places, so one third of their tokens is always whole: their thirds are
looked for as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import let
from .runtime import Scratch, stored

#: Fixed masks: the places that both pick, and the place that each adds.
COMMON = (0, 1, 2, 4)
ADDED = (3, 5)
MASKS = tuple(tuple(sorted((*COMMON, own))) for own in ADDED)
#: Items of fewer tokens are found whole.
SPAN = 10
#: Items of up to this number of tokens are also looked for by runs of a third of their tokens.
THIRDS = 13
WINDOW = 16
PERCENT = 80
#: Scripts that are written without blanks: each character is a token.
UNSPACED = r"[฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\x{20000}-\x{323AF}]"
#: Hits of a document are held in one row for each stretch of so many positions.
BLOCK = 1 << 16
#: Tables of up to this number of bytes, as counted over all their rows, are broadcast; larger ones are shuffled.
BROADCAST_BYTES = 64 << 20


def tokens(text: Column) -> Column:
    """Runs of letters and digits, in lower case; single characters of unspaced scripts."""
    low = F.lower(text)
    spaced = F.when(low.rlike(UNSPACED), F.regexp_replace(low, f"({UNSPACED})", " $1 ")).otherwise(low)
    return F.filter(F.split(spaced, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def windows(df: DataFrame, columns: list[str], words: Column) -> DataFrame:
    """``columns`` with a row for each window of ``words``: its place ``at``, the hash of the common places, and those of
    the places that the masks add (null past the end)."""

    def zipped(w: Column) -> Column:
        n = F.greatest(F.size(w) - COMMON[-1], F.lit(0))
        # the last place of a mask may lie past the end in the last window: zipping pads it with a null
        return F.slice(F.arrays_zip(*(F.slice(w, k + 1, n) for k in range(max(ADDED) + 1))), 1, n)

    rows = df.select(*columns, F.posexplode(let(words, zipped)).alias("at", "w"))
    added = (F.when(F.col(f"w.{k}").isNotNull(), F.hash(f"w.{k}")).alias(f"added_{k}") for k in ADDED)
    return rows.select(*columns, "at", F.xxhash64(*(f"w.{k}" for k in COMMON)).alias("seed"), *added)


def run_hashes(words: Column, length: int) -> Column:
    """array of hashes of all runs of ``length`` neighbouring words."""

    def hashed(w: Column) -> Column:
        n = F.greatest(F.size(w) - (length - 1), F.lit(0))
        return F.transform(F.arrays_zip(*(F.slice(w, k + 1, n) for k in range(length))), lambda x: F.xxhash64(F.lit(length), *(x[str(k)] for k in range(length))))

    return let(words, hashed)


def short_marks(items: DataFrame) -> DataFrame:
    """(item_key, item, n, run, item_at) of items of up to ``THIRDS`` tokens: the runs to look for, by length and place."""
    short = items.where(F.col("n") <= THIRDS)
    run = F.when(F.col("n") < SPAN, F.col("n")).otherwise(F.floor(F.col("n") / 3).cast("int"))
    places = F.when(F.col("n") < SPAN, F.array(F.lit(0))).otherwise(F.array(F.lit(0), run, 2 * run))
    return short.select("item_key", "item", "n", run.alias("run"), F.explode(places).alias("item_at"))


def short_hits(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """The runs of short items in ``docs``, as ``seed_hits`` gives them; none if no item is short."""
    marks = short_marks(items)
    lengths = sorted(r[0] for r in marks.select("run").distinct().collect())  # at most SPAN - 1
    if not lengths:
        return None
    seeds, members = classes(marks.select("item_key", "n", "item_at", run_seed(lengths).alias("seed")), ["seed", "item_at"])
    runs = F.flatten(F.array(*(F.transform(run_hashes(F.col("words"), n), lambda h, i: F.struct(h.alias("seed"), i.alias("at"))) for n in lengths)))
    rows = docs.select("doc_id", "text_hash", F.explode(runs).alias("r")).select("doc_id", "text_hash", "r.seed", "r.at")
    return rows.join(bounded(seeds), "seed").select("doc_id", "text_hash", "class", "n", (F.col("at") - F.col("item_at")).alias("shift")), members


def run_seed(lengths: list[int]) -> Column:
    """Hash of the run of ``run`` tokens of ``item`` at ``item_at``."""
    part = F.slice("item", F.col("item_at") + 1, F.col("run"))
    return F.coalesce(*(F.when(F.col("run") == n, run_hashes(part, n)[0]) for n in lengths))


def overlap(part: Column, item: Column, shift: Column, percent: int) -> Column:
    """Largest share of agreeing places in a stretch of ``WINDOW`` tokens of ``item``, laid on a document at ``shift``.

    ``part`` is the stretch of the document under the item, or longer. Null where too few places agree in all.
    """
    skip = F.greatest(-shift, F.lit(0))
    n = F.greatest(F.size(item) - skip, F.lit(0))
    same = F.transform(F.arrays_zip(F.slice(item, skip + 1, n), F.slice(part, F.lit(1), n).alias("1")), lambda z: F.when(z["0"] == z["1"], 1).otherwise(0))
    wide = F.least(F.size(item), F.lit(WINDOW))

    def best(s: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(s) - wide + 1, F.lit(1)))
        stretch = F.array_max(F.transform(starts, lambda i: F.aggregate(F.slice(s, i, wide), F.lit(0), lambda a, x: a + x))) / wide
        return F.when(F.aggregate(s, F.lit(0), lambda a, x: a + x) * 100 >= wide * percent, stretch)

    return let(same, best)


def held_bytes(df: DataFrame) -> int:
    """About the bytes that all rows of ``df`` take in memory: numbers, strings and arrays of strings are counted whole."""
    def of(field) -> Column:
        c, kind = F.col(field.name), field.dataType.simpleString()
        each = F.octet_length(F.array_join(c, "")) + 32 * F.size(c) if kind == "array<string>" else F.octet_length(c) if kind in ("string", "binary") else F.lit(0)
        return F.coalesce(each, F.lit(0)) + 16

    whole = F.lit(16).cast("long")
    for field in df.schema:
        whole = whole + of(field)
    return df.agg(F.sum(whole)).first()[0] or 0


def bounded(df: DataFrame, measured: DataFrame | None = None) -> DataFrame:
    """``df`` to be broadcast if it, or ``measured`` that holds all its rows, is small enough."""
    return F.broadcast(df) if held_bytes(df if measured is None else measured) <= BROADCAST_BYTES else df


def classes(marks: DataFrame, place: list[str]) -> tuple[DataFrame, DataFrame]:
    """(place, class, n) of all places of ``marks`` and (class, item_key) of the classes: a class is a set of items that
    have a place in common, named by a hash of the set, and ``n`` the tokens of its longest item.

    Sets are never gathered: their hash is folded, and their members are those of one of their places.
    """
    marks = stored(marks.select(*place, "item_key", "n").distinct().withColumn("mark", F.xxhash64(*place)), "benchmark-marks")
    name = F.xxhash64(F.count("*"), F.bit_xor("item_key"), F.bit_xor(F.xxhash64("item_key")))
    seeds = stored(marks.groupBy(*place).agg(name.alias("class"), F.max("n").alias("n"), F.first("mark").alias("mark")), "benchmark-seeds")
    one = seeds.groupBy("class").agg(F.min("mark").alias("mark"))
    return seeds.drop("mark"), marks.select("mark", "item_key").join(one, "mark").select("class", "item_key").distinct()


def masked(rows: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of ``windows`` with a row for each mask that fits: the hash of its places as ``mask``."""
    each = F.array(*(F.when(F.col(f"added_{k}").isNotNull(), F.xxhash64("seed", F.lit(k), f"added_{k}")) for k in ADDED))
    return rows.select(*columns, F.explode(F.array_compact(each)).alias("mask"))


def seed_hits(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, class, n, shift): the alignments of all documents and classes of items that share a seed, and
    (class, item_key), the members of the classes.

    Windows are looked up by the places that both masks pick; only those that are known are looked up by each mask.
    """
    marks = stored(windows(items, ["item_key", "n"], F.col("item")).withColumnRenamed("at", "item_at"), "benchmark-windows")
    seeds, members = classes(masked(marks, "item_key", "n", "item_at"), ["mask", "item_at"])
    known = windows(docs, ["doc_id", "text_hash"], F.col("words")).join(bounded(marks.select("seed").distinct(), marks.select("seed")), "seed", "left_semi")
    hits = masked(known, "doc_id", "text_hash", "at").join(bounded(seeds), "mask")
    hits = hits.select("doc_id", "text_hash", "class", "n", (F.col("at") - F.col("item_at")).alias("shift"))
    short = short_hits(docs, items)
    if short is not None:
        hits, members = hits.unionByName(short[0]), members.unionByName(short[1]).distinct()
    return stored(hits.distinct(), "seed-hits"), members


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_hash, item_id, overlap) of all verified overlaps; a document is its id and the hash of its text."""
    if percent < PERCENT:
        raise ValueError(f"the masks lose no overlap of {PERCENT} % or more; {percent} % is less")
    with Scratch() as scratch:
        texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        texts = texts.withColumn("text_hash", F.xxhash64("text"))
        items = benchmark.select(F.col(item_col).alias("item_id"), tokens(F.coalesce(F.col(item_text_col), F.lit(""))).alias("item")).where(F.size("item") > 0).distinct()
        items = stored(items.withColumn("n", F.size("item")).withColumn("item_key", F.xxhash64(F.col("item_id").isNull(), "item_id", "item")), "items")
        hits, members = seed_hits(texts.select("doc_id", "text_hash", tokens(F.col("text")).alias("words")), items)
        known = stored(members.join(items.select("item_key", "item_id", "item"), "item_key").select("class", "item_id", "item"), "members")
        # only small numbers are gathered, and of a long document no more than a block's; the words join them once
        laid = hits.groupBy("doc_id", "text_hash", F.floor(F.col("shift") / BLOCK).alias("block")).agg(F.collect_list(F.struct("class", "n", "shift")).alias("hits"))
        laid = laid.select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), "hits")
        ids = laid.select("hit_id", "hit_hash").distinct()
        same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash"))
        hit_texts = texts.distinct().join(bounded(ids, hits.select("doc_id", "text_hash")), same, "left_semi").join(laid, same)
        part = lambda w, h: F.slice(w, F.greatest(h["shift"], F.lit(0)) + 1, F.greatest(h["n"] - F.greatest(-h["shift"], F.lit(0)), F.lit(0)))
        parts = hit_texts.select("doc_id", "text_hash", F.explode(let(tokens(F.col("text")), lambda w: F.transform("hits", lambda h: F.struct(h["class"].alias("class"), h["shift"].alias("shift"), part(w, h).alias("part"))))).alias("h"))
        # a pair is compared where it is made: it is written nowhere before
        scored = parts.select("doc_id", "text_hash", "h.*").join(bounded(known), "class")
        scored = scored.select("doc_id", "text_hash", "item_id", F.size("item").alias("n"), overlap(F.col("part"), F.col("item"), F.col("shift"), percent).alias("overlap"))
        enough = F.col("overlap") * 100 >= F.when(F.col("n") < SPAN, 100).otherwise(percent)
        found = scored.where(enough).groupBy("doc_id", "text_hash", "item_id").agg(F.max("overlap").alias("overlap"))
        return scratch.keep(stored(found, "overlaps"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, contaminated, n_items, items (sorted ids, comma-joined) and its largest overlap.

    Null text has no tokens and is clean. Items under ``SPAN`` tokens are found word for word only; null and empty ones
    are not looked for. Texts of any length are read whole, a row for each window. Of overlaps that tie all count as
    items. Repeated rows get the same result each; repeated items count once. An empty table gives no rows, an empty
    benchmark only clean rows; other columns are ignored. ``percent`` must be ``PERCENT`` or more.
    """
    found = overlaps(docs, benchmark, id_col, text_col, percent=percent).groupBy("doc_id", "text_hash").agg(
        F.count("*").alias("n_items"), F.array_join(F.transform(F.array_sort(F.collect_set("item_id")), lambda x: x.cast("string")), ",").alias("items"), F.max("overlap").alias("overlap")
    ).select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), "n_items", "items", "overlap")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"))
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")), "left").select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.lit("")).alias("items"), F.coalesce("overlap", F.lit(0.0)).alias("overlap")
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, with their own columns."""
    hit_id, hit_hash = ("_" * max(map(len, docs.columns)) + name for name in ("hit_id", "hit_hash"))  # longer than any column's name
    found = overlaps(docs, benchmark, id_col, text_col, percent=percent).select(F.col("doc_id").alias(hit_id), F.col("text_hash").alias(hit_hash)).distinct()
    same = F.col(id_col).eqNullSafe(F.col(hit_id)) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(hit_hash))
    return docs.join(found, same, "left_anti")
