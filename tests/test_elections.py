"""Heads of duplicate groups by join, and the paired bootstrap."""

from pyspark.sql import functions as F

from larkspur.operators import curation, windows


def test_heads(spark):
    rows = [("a", 1, 5), ("a", 2, 9), ("a", 3, 9), (None, 4, 1), (None, 5, 2), ("b", 6, None)]
    df = spark.createDataFrame(rows + [("hot", k, k % 7) for k in range(100, 3100)], "g string, id long, size long")
    out = windows.elect(df, ["g"], [F.col("size").desc(), F.col("id")], "original", "id")
    got = {r.id: r.original for r in out.collect()}
    assert got == {1: 2, 2: 2, 3: 2, 4: 4, 5: 5, 6: 6, **{k: 104 for k in range(100, 3100)}}
    assert out.columns == ["g", "id", "size", "original"]
    assert "Window [first" not in out._jdf.queryExecution().toString()


def test_paired_bootstrap(spark):
    df = spark.createDataFrame([(k, 1 if k % 4 else 0, 1 if k % 2 else 0) for k in range(400)], "id long, a int, b int")
    r = curation.paired_bootstrap(df, "id", F.col("a"), F.col("b"), 200, 1).first()
    assert r.difference == 0.25 and 0.18 < r.low < 0.25 < r.high < 0.32 and r.differs
    same = curation.paired_bootstrap(df, "id", F.col("a"), F.col("a"), 50, 1).first()
    assert (same.difference, same.low, same.high, same.differs) == (0.0, 0.0, 0.0, False)
    # the weight of a row does not depend on the rows beside it, and rows of one key weigh alike
    twice = curation.paired_bootstrap(df.union(df), "id", F.col("a"), F.col("b"), 200, 1).first()
    assert twice == r
    assert curation.paired_bootstrap(df.limit(0), "id", F.col("a"), F.col("b"), 50, 1).first().difference is None
