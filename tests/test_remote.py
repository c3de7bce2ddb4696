"""Data sources over file systems: retries, pushed filters, members of archives, and cursors that survive a crash."""

import datetime as dt
import zipfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual, StringContains

from larkspur.sources import readers, remote, sinks


@pytest.fixture
def table(tmp_path):
    path = str(tmp_path / "t.parquet")
    rows = pa.table({"a": list(range(1000)), "b": [f"v{i % 7}" for i in range(1000)], "c": [None if i % 2 else i / 2 for i in range(1000)]})
    pq.write_table(rows, path, row_group_size=100)
    return path


def reader(path, *filters, **options):
    r = remote.ParquetReader({"path": path, **options}, remote.from_arrow_schema(pa.schema([("a", pa.int64())])))
    return r, list(r.pushFilters(list(filters)))


def test_row_groups_are_pruned_by_their_statistics(table):
    r, left = reader(table, GreaterThan(("a",), 750), LessThanOrEqual(("a",), 830), StringContains(("b",), "v"))
    assert [type(f).__name__ for f in left] == ["StringContains"]
    assert [p.part for p in r.partitions()] == [7, 8]
    assert [x for p in r.partitions() for b in r.read(p) for x in b.column("a").to_pylist()] == list(range(751, 831))
    assert [p.part for p in reader(table, In(("a",), (5, 950, None)))[0].partitions()] == [0, 9]
    assert len(reader(table, EqualTo(("b",), "v3"), IsNotNull(("c",)))[0].partitions()) == 10
    assert reader(table, EqualTo(("a",), 5000))[0].partitions() == []


def test_spark_pushes_filters_and_reads_the_named_columns(spark, table):
    remote.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format("remote_parquet").schema("a long, c double").load(table).where("a >= 250 AND c IS NOT NULL AND a < 260")
    assert sorted(tuple(r) for r in df.collect()) == [(i, i / 2) for i in range(250, 260, 2)]
    assert df.rdd.getNumPartitions() == 1  # one row group of ten
    assert spark.read.format("remote_parquet").load(table).columns == ["a", "b", "c"]


def test_failing_reads_are_tried_again(spark, table):
    remote.register(spark)
    df = spark.read.format("remote_parquet").schema("a long").option("system", "tests.flaky:flaky").load(table)
    assert df.count() == 1000
    with open(f"{table}.tries") as f:
        assert len(f.read()) >= 3
    pauses = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(remote.time, "sleep", pauses.append)
        with pytest.raises(OSError, match="gone for good"):
            reader(table, system="tests.flaky:broken")[0].partitions()
    assert pauses == [0.1, 0.2, 0.4, 0.8]


def test_members_of_several_archives(spark, tmp_path):
    folder = tmp_path / "zips"
    folder.mkdir()
    for name, members in (("a.zip", {"x.csv": "id,name\n1,one\n2,\"two, too\"\n", "note.txt": "no"}), ("b.zip", {"y.csv": "name,id,more\nthree,3,z\nfour,x,z\n", "z.csv": "id\n"}), ("none.csv", {})):
        with zipfile.ZipFile(folder / name, "w") as z:
            for member, text in members.items():
                z.writestr(member, text)
    for path in (str(folder), f"{folder}/*.zip", f"{folder}/a.zip;{folder}/b.zip"):
        df = readers.zipped_csv(spark, path, "id int, name string, missing double")
        assert sorted(map(tuple, df.collect()), key=str) == sorted([(1, "one", None), (2, "two, too", None), (3, "three", None), (None, "four", None)], key=str)
        assert df.rdd.getNumPartitions() == 3


def test_written_members_hold_every_row_once(spark, tmp_path):
    df = spark.range(2000).select("id", (F.col("id") % 5).alias("k"), F.when(F.col("id") % 3 > 0, F.concat(F.lit('a "b", '), F.col("id").cast("string"))).alias("s"))
    made = sinks.zipped_members(df, f"file://{tmp_path}/out", "k").collect()
    assert sum(r.rows for r in made) == 2000 and len(made) == 5
    back = readers.zipped_csv(spark, ";".join({r.path for r in made}), "id long, k long, s string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def changes(spark, tmp_path, now, fail=False, **options):
    remote.register(spark)
    (tmp_path / "clock").write_text(now)
    stream = spark.readStream.format("changes").options(path=str(tmp_path / "records"), id="id", opened="made", closed="ended", clock=str(tmp_path / "clock"), **options).load()
    seen = []

    def write(batch, number):
        batch.write.mode("overwrite").parquet(str(tmp_path / "out" / f"b={number}"))
        seen.append(number)
        if fail:
            raise RuntimeError("lost")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    return seen


def test_cursor_after_a_crash_and_the_default_look_back(spark, tmp_path):
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    rows = [(1, day(1), None), (2, day(4, 12), None), (3, day(5), day(6)), (4, day(2), day(4, 20)), (5, day(5, 12), None), (6, day(8), None), (7, None, None), (8, day(4), None)]
    spark.createDataFrame(rows, "id long, made timestamp, ended timestamp").repartition(2).write.parquet(str(tmp_path / "records"))
    changes(spark, tmp_path, "2024-01-05T00:00:00")
    with pytest.raises(Exception, match="lost"):
        changes(spark, tmp_path, "2024-01-05T18:00:00", fail=True)
    changes(spark, tmp_path, "2024-01-07T00:00:00")
    changes(spark, tmp_path, "2024-01-07T00:00:00")
    got = sorted((r.event, r.id) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    # a day before the first run; 8 lies on the cursor itself, 6 in the future
    assert got == [("closed", 3), ("closed", 4), ("new", 2), ("new", 3), ("new", 5)]


def test_since_comes_before_the_look_back():
    r = remote.ChangeReader({"since": "2024-01-01", "look_back": "5"})
    assert r.initialOffset() == {"cursor": "2024-01-01T00:00:00+00:00"}
    assert remote.ChangeReader({}).partitions({"cursor": "2024-01-02"}, {"cursor": "2024-01-02"}) == []
