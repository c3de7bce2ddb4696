"""Operators at odd sizes: no task that holds all rows, late rows kept, pointers that are never gone."""

import json
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import curation, joins, windows
from larkspur.session import shared_dir, spread
from larkspur.sources import connector, readers, sinks, store
from larkspur.streaming import feed


def test_running_total_and_mean_ranks(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.randint(0, 40)) for i in range(500)] + [(500, None)]
    df = spark.createDataFrame(rows, "i int, v int")
    values = sorted(v for _, v in rows if v is not None)
    want = {v: (values.index(v) + 1 + len(values) - values[::-1].index(v)) / 2 for v in values}
    got = {r.i: r.r for r in curation.mean_ranks(df, "v", "r").collect()}
    assert got == {i: want[v] for i, v in rows if v is not None}
    plan = curation.mean_ranks(df, "v", "r")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    counts = df.where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    assert {r.v: r.t for r in windows.running_total(counts, "v", "n", "t").collect()} == {v: values.index(v) for v in values}
    assert windows.running_total(counts.limit(0), "v", "n", "t").count() == 0


def test_others_of_large_groups_come_as_pairs(spark):
    rows = [(i, "a" if i < 5 else "b", f"v{i}") for i in range(8)] + [(8, None, "x")]
    df = spark.createDataFrame(rows, "id int, k string, v string")
    got = {r.id: (r.others, r.n_others) for r in joins.other_members(df, "k", "id", "v", most=3).collect()}
    assert got[0] == (None, 4) and got[5] == ("v6,v7", 2) and got[8] == ("", 0)
    pairs = {(r.id, r.other_id, r.other) for r in joins.other_pairs(df, "k", "id", "v").collect()}
    assert pairs == {(a, b, w) for a, k, _ in rows for b, m, w in rows if a != b and k == m and k}


def test_late_rows_go_to_a_side_folder(spark, tmp_path):
    for n, (stamp, ids) in enumerate([("2024-01-01", [1, 2]), ("2024-01-10", [3]), ("2024-01-02", [4])]):
        spark.createDataFrame([(i, stamp) for i in ids], "id int, t string").select("id", F.col("t").cast("timestamp").alias("t")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if n < 2:
            feed.with_late_rows(feed.read(spark, f"{tmp_path}/in", 1), "t", "3 DAYS", lambda d: d.select("id"), f"{tmp_path}/run", f"{tmp_path}/late")
    totals = feed.with_late_rows(feed.read(spark, f"{tmp_path}/in", 1), "t", "3 DAYS", lambda d: d.select("id"), f"{tmp_path}/run", f"{tmp_path}/late")
    assert totals == {"late": 1, "kept": 0}
    assert [r.id for r in spark.read.parquet(f"{tmp_path}/late").collect()] == [4]
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/run/out").collect()) == [1, 2, 3]


def test_a_pointer_is_swapped_in_place(spark, tmp_path):
    path = f"{tmp_path}/CURRENT"
    for text in ("one", "two"):
        store.write_text(spark, path, text)
        assert store.read_text(spark, path) == text
    assert not [n for n in store.names(spark, str(tmp_path)) if n.endswith(".part")]


def test_archived_rows_are_counted_as_they_are_written(spark, tmp_path):
    parents = spark.createDataFrame([(1, "2024-01-05"), (2, None), (3, "2024-02-01")], "id int, ended string").withColumn("ended", F.col("ended").cast("date"))
    children = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id int, v string")
    assert sinks.archive_months(parents, {"children": children}, "id", "ended", str(tmp_path / "a")) == {"parents": 2, "children": 2}


def test_zipped_csv(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("rows.csv", 'id,name,extra\n1,"a, b",x\n2,,y\nz,c,\n')
        z.writestr("readme.txt", "none")
    got = readers.zipped_csv(spark, str(tmp_path / "a.zip"), "name string, id int, missing double").collect()
    assert sorted(map(tuple, got), key=str) == sorted([("a, b", 1, None), (None, 2, None), ("c", None, None)], key=str)


def test_replayed_pages_are_opened_by_their_address(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text(json.dumps({"id": "1", "title": "t"}) + "\nbroken\n")
    spark.dataSource.register(connector.ReplaySource)
    for path in (str(tmp_path / "p.jsonl"), f"file://{tmp_path}/p.jsonl"):
        assert [r.title for r in spark.read.format("listing_replay").option("paths", path).load().collect()] == ["t"]


def test_sample_is_the_same_on_every_partitioning(spark):
    df = spark.range(20_000).withColumn("v", F.col("id") % 7)
    one, two = ({r.id for r in windows.sample(df.repartition(n), 0.1, 5, "id").collect()} for n in (2, 9))
    assert one == two and 1800 < len(one) < 2200 and one != {r.id for r in windows.sample(df, 0.1, 6, "id").collect()}


def test_bootstrap_against_resampling_by_hand(spark):
    rng = np.random.default_rng(4)
    values = rng.random(400)
    got = curation.bootstrap(spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double"), F.col("v"), 400, 3).first()
    means = [rng.choice(values, len(values)).mean() for _ in range(4000)]
    assert abs(got.mean - values.mean()) < 0.003
    assert abs(got.low - np.quantile(means, 0.05)) < 0.006 and abs(got.high - np.quantile(means, 0.95)) < 0.006


def test_small_scans_are_spread_and_a_cluster_needs_a_shared_folder(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "t"))
    assert spread(spark.read.parquet(str(tmp_path / "t"))).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(10).repartition(16)
    assert spread(wide) is wide

    class Away:
        class sparkContext:
            master = "spark://somewhere:7077"

            class _jsc:
                sc = staticmethod(lambda: type("C", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))

            getConf = staticmethod(lambda: {})

    with pytest.raises(RuntimeError):
        shared_dir(Away)
