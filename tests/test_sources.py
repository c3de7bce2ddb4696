import gzip
import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from larkspur.sources import connector, readers, sinks, store
from larkspur.streaming import feed


def test_json_lines_keep_the_line_and_type_the_columns(spark, tmp_path):
    lines = ['{"id": "1", "n": 3,  "tags": ["a"]}', '{"id": "2", "extra": {"x": 1}}', "", '{"id": "3", "n": null}']
    with gzip.open(tmp_path / "listings-2024-05-01.jsonl.gz", "wt") as f:
        f.write("\n".join(lines))
    (tmp_path / "listings-2024-04-30.jsonl.gz").write_bytes(gzip.compress(b'{"id": "old"}'))
    (tmp_path / "listings-2024-05-02-sample.jsonl.gz").write_bytes(gzip.compress(b'{"id": "sample"}'))
    path = store.latest(spark, str(tmp_path), "listings")
    assert path.endswith("listings-2024-05-01.jsonl.gz")
    got = {r.id: (r.n, r.tags, r.raw) for r in readers.json_lines(spark, path, "id string, n int, tags array<string>", partitions=2).collect()}
    assert got == {"1": (3, ["a"], lines[0]), "2": (None, None, lines[1]), "3": (None, None, lines[3])}


def test_files_are_pruned_by_name(spark, tmp_path):
    for day in ("20240401", "20240429", "20240501"):
        (tmp_path / f"news-{day}-1200.jsonl").write_text("{}")
    assert [p[-20:] for p in store.since(spark, str(tmp_path), "news", date(2024, 5, 1), 7)] == ["ws-20240429-1200.jsonl"[-20:], "ws-20240501-1200.jsonl"[-20:]]
    assert store.latest(spark, str(tmp_path / "none"), "x") is None


def test_tolerant_and_delimited(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1}\n{bad\n{"id": 2}\n')
    assert sorted(r.id for r in readers.tolerant_json(spark, str(tmp_path / "a.json"), "id int").collect()) == [1, 2]
    (tmp_path / "b.tsv").write_text("k\tv\n1\ta\n")
    assert [tuple(r) for r in readers.delimited(spark, str(tmp_path / "b.tsv"), "k int, v string", "\t").collect()] == [(1, "a")]
    (tmp_path / "e.txt").write_text("com.acme.www\tcom.shop\ncom.acme\tcom.acme\norg.x\tcom.other\n")
    edges = readers.host_edges(spark, str(tmp_path / "e.txt"), spark.createDataFrame([("shop.com",), ("acme.com",)], "host string"))
    assert [(r.source, r.target) for r in edges.collect()] == [("www.acme.com", "shop.com")]
    assert readers.table_facts(spark, "no_such_table") is None


def test_sparse_lines_and_pointer(spark, tmp_path):
    df = spark.createDataFrame([(1, "", [], None), (2, "x", ["t"], 1.5)], "id int, s string, l array<string>, d double")
    path = sinks.write_json_lines(df, str(tmp_path), "out-2024-05-01", "out-latest")
    assert sorted(r.value for r in spark.read.text(path).collect()) == ['{"id":1}', '{"id":2,"s":"x","l":["t"],"d":1.5}']
    assert store.read_text(spark, f"{tmp_path}/out-latest") == path


def test_snapshot_swap_refuses_to_empty_a_table(spark, tmp_path):
    full, folder = spark.range(5), str(tmp_path / "snap")
    assert sinks.current(spark, folder) is None
    assert sinks.swap_snapshot({"a": full, "b": full.limit(0)}, folder) == {"a": 5, "b": 0}
    with pytest.raises(RuntimeError):
        sinks.swap_snapshot({"a": full.limit(0), "b": full}, folder)
    assert sinks.read_snapshot(spark, folder, "a").count() == 5
    facts = sinks.manifest(full, {"odd": F.col("id") % 2 == 1}, f"{tmp_path}/manifest.json", {"date": "2024-05-01"})
    assert facts == json.loads((tmp_path / "manifest.json").read_text()) and facts["coverage"] == {"odd": 40.0}


def test_monthly_archive(spark, tmp_path):
    parents = spark.createDataFrame([(1, "2024-01-05"), (2, "2024-02-01"), (3, None)], "id int, ended string").withColumn("ended", F.col("ended").cast("timestamp_ntz"))
    children = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z")], "id int, v string")
    assert sinks.archive_months(parents, {"cards": children}, "id", "ended", str(tmp_path)) == {"parents": 2, "cards": 2}
    back = spark.read.parquet(f"{tmp_path}/parents")
    assert sorted((r.id, r.month) for r in back.collect()) == [(1, "2024-01"), (2, "2024-02")]
    assert [r.id for r in sinks.survivors(parents, back, "id").collect()] == [3]
    assert sinks.export(parents, f"{tmp_path}/e", 2, ["id"]) == 3 and spark.read.text(f"{tmp_path}/e").count() == 2
    slim = sinks.slim(spark.createDataFrame([('{"a":1,"b":2}', True)], "raw string, old boolean"), "raw", ["a", "c"], F.col("old"))
    assert slim.first().raw == '{"a":"1"}'


def test_replay_connector(spark, tmp_path):
    (tmp_path / "p1.jsonl").write_text('{"id": 1, "title": "t\\u0000", "x": 2}\nbad\n')
    (tmp_path / "p2.jsonl").write_text('{"id": "2", "country": "IT"}\n{"title": "no id"}\n')
    spark.dataSource.register(connector.ReplaySource)
    df = spark.read.format("listing_replay").option("paths", f"{tmp_path}/p1.jsonl;{tmp_path}/p2.jsonl").load()
    assert sorted((r.id, r.title, r.country) for r in df.collect()) == [("1", "t", None), ("2", None, "IT")]


def test_stream_is_resumed_without_holes_or_repeats(spark, tmp_path):
    source, work = str(tmp_path / "in"), str(tmp_path / "work")
    make = lambda low, high: spark.range(low, high).select("id", F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000).alias("ts"))
    make(0, 10).write.parquet(source)
    run = lambda: feed.run_to_folder(feed.deduplicated(feed.read(spark, source, 1), "ts", ["id"], "1 day"), work)
    assert run().count() == 10
    make(5, 15).write.mode("append").parquet(source)
    assert sorted(r.id for r in run().collect()) == list(range(15))
