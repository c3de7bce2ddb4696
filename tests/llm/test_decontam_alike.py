"""Items that begin alike: a document has a hit for all of them together, and each is still found or not by itself."""

from larkspur.llm import decontam
from larkspur.llm.runtime import Scratch

START = "which of the following words is the best answer here"
N_ITEMS, N_DOCS = 5000, 40


def tail(i):
    return " ".join(f"w{i}x{k}" for k in range(8))


def test_hits_are_linear_in_documents(spark):
    items = spark.createDataFrame([(i, f"{START} {tail(i)}") for i in range(N_ITEMS)], "item_id long, text string")
    texts = [f"some words before {START} and then others that no item has at all in it {k}" for k in range(N_DOCS)]
    texts += [f"before {START} {tail(i)} after" for i in (7, 4321)] + [f"{START} {tail(11)} {START} {tail(12)}".upper()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    with Scratch():
        words = docs.select("doc_id", decontam.F.xxhash64("text").alias("text_hash"), decontam.tokens(decontam.F.col("text")).alias("words"))
        known = items.select("item_id", decontam.tokens(decontam.F.col("text")).alias("item"))
        known = known.withColumn("n", decontam.F.size("item")).withColumn("item_key", decontam.F.xxhash64("item_id", "item"))
        hits, members = decontam.seed_hits(words, known)
        assert len(texts) <= hits.count() <= 12 * len(texts)
        assert members.where(members["class"] == -1).count() == 0 and members.count() <= 2 * N_ITEMS
    got = {r.doc_id: (r.contaminated, r["items"]) for r in decontam.contamination(docs, items).collect()}
    assert got == {**{k: (False, "") for k in range(N_DOCS)}, N_DOCS: (True, "7"), N_DOCS + 1: (True, "4321"), N_DOCS + 2: (True, "11,12")}


def test_sizes_are_bytes(spark):
    small = spark.createDataFrame([(1, "a", ["b"])], "i long, t string, w array<string>")
    large = spark.createDataFrame([(1, "a" * 100_000, ["b" * 100_000] * 3)], "i long, t string, w array<string>")
    assert decontam.held_bytes(small) < 200 and decontam.held_bytes(large) > 400_000 and decontam.held_bytes(small.limit(0)) == 0


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, f"{START} {tail(1)}", "a", 5, 6), (2, "clean words", "b", 7, 8)], "doc_id long, text string, __hit_id string, __hit_hash int, hit_id int")
    items = spark.createDataFrame([(1, f"{START} {tail(1)}")], "item_id long, text string")
    kept = decontam.without_contaminated(docs, items)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, "clean words", "b", 7, 8)]
