"""Inverted index, maintained views and table functions on small fixtures with the awkward cases."""

import random

import pytest
from pyspark.sql import functions as F

from larkspur.functions import tables
from larkspur.operators import fulltext, maintained


def test_index_equals_a_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fulltext, "STRETCH", 8)
    monkeypatch.setattr(fulltext, "BUCKETS", 3)
    rnd = random.Random(3)
    words = ["alpha", "Beta", "gamma", "é", "x1", "common"]
    texts = [(i, " ".join(["common", *(rnd.choice(words) for _ in range(rnd.randint(0, 5)))])) for i in range(-20, 60)]
    rows = [*texts, (5, "Alpha again"), (None, "common"), (100, None), (101, "")]
    folder = str(tmp_path / "index")
    fulltext.build_index(spark.createDataFrame(rows, "id long, words string").repartition(3), "id", "words", folder)
    questions = [(1, "common"), (2, "ALPHA beta"), (3, "é, gamma; x1"), (4, "alpha alpha"), (5, "missing common"), (6, "..."), (7, None)]
    got = fulltext.ask(spark, folder, spark.createDataFrame(questions, "q long, t string"), "q", "t").collect()
    assert len(got) == len({(r.q, r.id) for r in got})
    own = {}
    for i, text in rows:
        if i is not None:
            own.setdefault(i, set()).update((text or "").lower().split())
    asked = {1: {"common"}, 2: {"alpha", "beta"}, 3: {"é", "gamma", "x1"}, 4: {"alpha"}}
    assert {(r.q, r.id) for r in got} == {(q, i) for q, t in asked.items() for i, w in own.items() if t <= w}


def test_questions_read_the_folders_of_their_tokens_only(spark, tmp_path):
    folder = str(tmp_path / "index")
    fulltext.build_index(spark.createDataFrame([(1, "one two"), (2, "three")], "id long, words string"), "id", "words", folder)
    plan = fulltext.ask(spark, folder, spark.createDataFrame([(1, "two")], "q long, t string"), "q", "t")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [" in plan and "In(token, [two])" in plan.replace("EqualTo(token,two)", "In(token, [two])")


SCHEMA = "k string, g string, v decimal(12,2)"


def test_refreshed_view_equals_recomputation(spark, tmp_path):
    rnd = random.Random(1)
    row = lambda: (rnd.choice(["a", "b", "c", None]), rnd.choice(["x", "y", None]), rnd.choice([None, round(rnd.uniform(-5, 5), 2)]))
    from decimal import Decimal

    exact = lambda rows: [(k, g, None if v is None else Decimal(str(v))) for k, g, v in rows]
    rows, keys, sums, path = [row() for _ in range(60)] + [("gone", "x", 1.0)], ["k", "g"], {"total": F.col("v")}, str(tmp_path / "view")
    df = lambda rows: spark.createDataFrame(exact(rows), SCHEMA)
    schema = maintained.partials(df(rows).limit(0), keys, sums, F.lit(1)).schema
    maintained.create_view(df(rows), path, keys, sums, "k")
    for _ in range(2):
        deleted = [r for r in rows if r[0] == "gone" or rnd.random() < 0.2]
        for r in deleted:
            rows.remove(r)
        inserted = [row() for _ in range(10)] + [("new", "x", 2.0)]
        rows += inserted
        touched = {r.k for r in maintained.refresh_view(path, schema, keys, sums, "k", df(inserted), df(deleted)).collect()}
        assert touched >= {"new"} and "untouched" not in touched
        want = {(r.k, r.g): (r.n, r.total) for r in maintained.partials(df(rows), keys, sums, F.lit(1)).collect()}
        assert {(r.k, r.g): (r.n, r.total) for r in maintained.read_view(spark, path, schema).collect()} == want
    files = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "view").glob("k=b/*.parquet")}
    maintained.refresh_view(path, schema, keys, sums, "k", df([("a", "x", 1.0)]), df([]))
    assert files == {p.name: p.stat().st_mtime_ns for p in (tmp_path / "view").glob("k=b/*.parquet")}


def test_table_functions(spark):
    tables.register(spark)
    spark.createDataFrame([("k", 3), ("k", 1), ("k", 2), ("l", 9), (None, 5), (None, 6)], "key string, id long").createOrReplaceTempView("kept_rows")
    out = spark.sql("SELECT * FROM resolve_duplicates(TABLE(kept_rows) PARTITION BY key ORDER BY id)").collect()
    assert sorted(tuple(r) for r in out) == [("k", 2, 1), ("k", 3, 1)]
    spark.createDataFrame([("m", True, 2, 9.0), ("m", False, 2, 8.0), ("m", True, 2, 7.0), ("n", False, 2, 1.0)], "model string, wanted boolean, size long, score double").createOrReplaceTempView("kept_scores")
    out = spark.sql("SELECT * FROM benchmark_recall(TABLE(kept_scores) PARTITION BY model ORDER BY (score DESC), 2)").collect()
    assert [tuple(r) for r in out] == [("m", 1, 2, 50.0)]


def test_views_are_made_in_the_order_of_their_needs(spark):
    made = tables.create_views(spark, {"kept_c": "SELECT a + 1 AS a FROM kept_b JOIN kept_a USING (a)", "kept_b": "SELECT a FROM kept_a", "kept_a": "SELECT 1 AS a"})
    assert made == ["kept_a", "kept_b", "kept_c"] and spark.table("kept_c").first().a == 2
    with pytest.raises(ValueError):
        tables.create_views(spark, {"kept_x": "SELECT * FROM kept_y", "kept_y": "SELECT * FROM kept_x"})
