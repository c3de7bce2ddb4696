"""Nearest vectors: copies, near copies, stripes of the compared rows, and how many tasks a row goes to."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from larkspur.operators import joins, vectors


def brute(v, k):
    """(row, rank, neighbour), scores summed in the order of the places."""
    own = vectors.in_order(v, v)
    for i, x in enumerate(v):
        if own[i] > 0:
            score = vectors.in_order(np.tile(x, (len(v), 1)), v) / np.sqrt(own[i]) / np.sqrt(np.where(own > 0, own, np.nan))
            found = sorted((-s, j) for j, s in enumerate(score) if j != i and s == s)[:k]
            yield from ((i, rn, j) for rn, (_, j) in enumerate(found, 1))


def got(spark, v, k, kind, **how):
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], f"id long, v array<{kind}>").union(spark.sql(f"SELECT 900L, CAST(NULL AS array<{kind}>)"))
    return sorted(tuple(r) for r in joins.nearest(df, "id", "v", k, **how).select("id", "rn", "near_id").collect())


def test_copies_near_copies_and_stripes(spark):
    rng = np.random.default_rng(8)
    v = rng.integers(-2, 3, size=(120, 5)).astype(float)
    v[20:60] = v[20]  # copies
    v[60:90] = v[60] + rng.normal(size=(30, 5)) * 1e-7  # closer than single precision tells
    v[60:90, 0] += 3
    v[119] = 0
    want = list(brute(v, 4))
    assert len({i for i, _, _ in want}) < 120
    assert joins.cells_of(120, 120, 8, 60)[1] > 1
    for block in (7, 60, 1000):
        assert got(spark, v, 4, "double", block=block) == want
    assert got(spark, v, 4, "double", block=60, wanted=F.col("id") % 3 == 0) == [w for w in want if w[0] % 3 == 0]
    single = v.astype(np.float32).astype(float)
    assert got(spark, single, 4, "float", block=60) == list(brute(single, 4))


def test_a_row_goes_to_few_tasks():
    # blocks of 2048 rows against blocks of 2048 sent every row of 6 GB to 301 tasks, twice
    blocks, stripes = joins.cells_of(615_384, 615_384, 24, joins.VECTOR_BLOCK)
    assert blocks + stripes <= 40 and 615_384 / blocks <= joins.VECTOR_BLOCK
    assert joins.cells_of(0, 0, 24, joins.VECTOR_BLOCK) == (1, 1)
    blocks, stripes = joins.cells_of(10_256, 10_256, 24, joins.VECTOR_BLOCK)
    assert blocks * stripes >= 6


def test_equal_scores_are_held_in_parts():
    ids, v = np.arange(4096), np.outer(np.exp2(np.arange(4096) % 9), np.ones(64))  # one direction: no score tells two apart
    best = vectors.Best(ids, v, 10)
    tracemalloc.start()
    for at in range(0, 2048, vectors.CHUNK):
        best.add(ids[at : at + vectors.CHUNK], v[at : at + vectors.CHUNK])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    rows = best.rows(vectors.pa.int64()).to_pydict()
    assert rows["near_id"][:10] == list(range(1, 11)) and rows["near_id"][-10:] == list(range(10))
