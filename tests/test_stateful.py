"""State machines over streams in small deliveries: out-of-order and late rows, restarts, and an initial state."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from larkspur.streaming import feed, stateful

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "user string, ts timestamp, id long, bad boolean"


def at(hours):
    return DAY + dt.timedelta(hours=hours)


def micros(hours):
    return int((at(hours) - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000


def deliver(spark, tmp_path, deliveries, stream):
    place = str(tmp_path / uuid.uuid4().hex)
    for rows in deliveries:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{place}/in")
        with stateful.rocks_state(spark):
            out = feed.run_to_folder(stream(feed.read(spark, f"{place}/in")), f"{place}/run")
    return out, f"{place}/run/log"


def incidents(events, hours=4):
    return stateful.incident_events(events, ["user"], "ts", "id", F.col("bad"), "2 hours", dt.timedelta(hours=hours))


def test_opens_escalates_and_resolves_in_the_order_of_time(spark, tmp_path):
    first = [("a", at(1), 2, True), ("a", at(0), 1, True), ("b", at(1), 3, True), ("b", at(1.5), 4, False), ("c", at(0), 5, True)]
    second = [("a", at(9), 6, False), ("c", at(1.9), 7, True), ("c", at(3), 8, False), ("z", at(30), 9, False)]
    out, _ = deliver(spark, tmp_path, [first, second], incidents)
    assert sorted(tuple(r) for r in out.collect()) == [
        ("a", "escalated", micros(1), micros(5), 2), ("a", "opened", micros(1), micros(1), 2), ("a", "resolved", micros(1), micros(9), 2),
        ("c", "opened", micros(1.9), micros(1.9), 2), ("c", "resolved", micros(1.9), micros(3), 2),
    ]


def test_rows_older_than_the_watermark_are_left_out(spark, tmp_path):
    out, _ = deliver(spark, tmp_path, [[("a", at(10), 1, True), ("a", at(11), 2, True)], [("a", at(1), 3, False), ("a", at(20), 4, False)], [("z", at(40), 5, True)]], incidents)
    assert sorted((r.event, r.at) for r in out.collect()) == [("escalated", micros(15)), ("opened", micros(11)), ("resolved", micros(20))]


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_its_batch_twin_whatever_the_deliveries(spark, tmp_path, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice("abcd"), at(rnd.randrange(2000) / 10), i, rnd.random() < 0.6) for i in range(400)]
    rows.sort(key=lambda r: r[1] + dt.timedelta(minutes=rnd.randrange(110)))
    cuts = sorted(rnd.sample(range(400), 3))
    out, _ = deliver(spark, tmp_path, [rows[a:b] for a, b in zip([0, *cuts], [*cuts, 400], strict=True)], incidents)
    last = int((max(r[1] for r in rows) - dt.datetime(1970, 1, 1)).total_seconds() * 1000) * 1000 - 2 * 3_600_000_000
    twin = stateful.incident_events_batch(spark.createDataFrame(rows, SCHEMA), ["user"], "ts", "id", F.col("bad"), F.lit(last), dt.timedelta(hours=4))
    assert sorted(tuple(r) for r in out.collect()) == sorted(tuple(r) for r in twin.collect())


def test_memory_starts_from_a_snapshot_and_forgets_silent_keys(spark, tmp_path):
    known = spark.createDataFrame([("old", micros(-200), micros(-100), 7), ("kept", micros(-5), micros(-1), 3)], "user string, first_seen long, last_seen long, mentions long")
    rows = [[("kept", at(1), 1, True), ("new", at(2), 2, True), ("new", at(0), 3, True)], [("later", at(40), 4, True), ("new", at(8), 5, True)], [("end", at(70), 6, True)]]
    out, log = deliver(spark, tmp_path, rows, lambda e: stateful.remember_within(e, ["user"], "ts", "id", "2 hours", dt.timedelta(hours=24), known))
    assert sorted(tuple(r) for r in out.collect()) == [("kept", micros(-5), micros(1), 4), ("later", micros(40), micros(40), 1), ("new", micros(0), micros(8), 3), ("old", micros(-200), micros(-100), 7)]
    assert stateful.alive(spark, log, ["user"]).collect() == []
