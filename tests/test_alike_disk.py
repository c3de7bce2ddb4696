"""What the alike texts write, and the cells in which whole sets are compared."""

import os
import random

import duckdb
import numpy as np

from larkspur.operators import alike, curation
from larkspur.plans import registry
from larkspur.session import shared_dir


def on_disk(spark):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, names in os.walk(shared_dir(spark).removeprefix("file://")) for f in names)


def by_sql(rows):
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    return sorted(db.execute(registry.oracle_sql()["near_dup_jaccard"]).fetchall(), key=str)


def found(spark, rows):
    return sorted(map(tuple, curation.alike_texts(spark.createDataFrame(rows, "id string, t string").repartition(3), "id", "t", 85).collect()), key=str)


def test_writes_less_than_the_texts(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(4, 12))) for _ in range(8000)]
    rows = [(i, " ".join(rnd.sample(words, 300))) for i in range(500)]
    df, before = spark.createDataFrame(rows, "id long, t string"), on_disk(spark)
    assert curation.alike_texts(df, "id", "t", 85).count() == 500
    assert on_disk(spark) - before < sum(len(t) for _, t in rows)


def test_crowds_are_dealt_out_to_cells(spark, monkeypatch):
    monkeypatch.setattr(curation, "CELL_PAIRS", 20)
    monkeypatch.setattr(curation, "CELL_TOKENS", 200)
    rnd = random.Random(4)
    base = [f"w{k}" for k in range(40)]
    rows = [(f"d{k:02}", " ".join(rnd.sample(base, 37) + [f"x{rnd.randrange(9)}"])) for k in range(60)]
    got = found(spark, rows)
    assert got == by_sql(rows) and len(got) > 600


def test_ids_that_are_missing_or_repeated(spark):
    body = " ".join(f"w{k}" for k in range(30))
    rows = [("1", body), ("1", body), (None, body), ("2", body + " more"), ("3", "else"), (None, "nothing with an id"), ("4", None), ("5", body + " more more"), ("3", body + " other")]
    assert found(spark, rows) == by_sql(rows)


def test_parities_differ_no_more_than_sets():
    rnd = random.Random(5)
    for n in (1, 60, 92, 93, 200, 400, 3000):
        a = [rnd.randrange(-(2**31), 2**31) for _ in range(n)]
        b = a[: int(n * 0.9)] + [rnd.randrange(-(2**31), 2**31) for _ in range(n // 5)]
        bits = [alike.parity(np.array(x, np.int32)) for x in (a, b)]
        assert alike.fewest(*bits) <= len(set(a) ^ set(b)) and alike.fewest(bits[0], bits[0]) == 0
