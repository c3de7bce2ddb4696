"""Percentiles by selection against Spark's own aggregate, with small limits so that groups are cut many times."""

import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import selection

SHARES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)


@pytest.mark.parametrize("small,bins", [(5, 4), (50, 16)])
def test_equals_the_aggregate(spark, monkeypatch, small, bins):
    monkeypatch.setattr(selection, "SMALL", small)
    monkeypatch.setattr(selection, "BINS", bins)
    rnd = random.Random(small)
    rows = [("hot", rnd.choice([rnd.gauss(0, 1), rnd.gauss(0, 1e9), 7.0, -0.0, 1e-300])) for _ in range(900)]
    rows += [("ties", 3.0)] * 200 + [(None, float(i)) for i in range(100)] + [("one", 2.5), ("none", None), ("nan", float("nan")), ("hot", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(3)
    got = {r.k: r.p for r in selection.percentiles(df, ["k"], "x", SHARES).collect()}
    clean = df.withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    want = {r.k: r.p for r in clean.groupBy("k").agg(F.percentile("x", F.array(*map(F.lit, SHARES))).alias("p")).collect()}
    assert got.keys() == want.keys()
    for k, values in want.items():
        assert got[k] == values if values is None else got[k] == pytest.approx(values, rel=1e-12)


def test_no_task_sorts_more_than_the_limit(spark, monkeypatch):
    """A hot group of one distribution is narrowed to bins before any rank is looked up."""
    monkeypatch.setattr(selection, "SMALL", 1000)
    df = spark.range(200_000).select(F.lit("hot").alias("k"), (F.col("id") * 7919 % 200_000).cast("double").alias("x"))
    assert [tuple(r) for r in selection.percentiles(df, ["k"], "x", (0.25, 0.5)).collect()] == [("hot", [49999.75, 99999.5])]


def test_infinite_and_huge_values(spark, monkeypatch):
    monkeypatch.setattr(selection, "SMALL", 3)
    monkeypatch.setattr(selection, "BINS", 4)
    values = [float("-inf")] * 20 + [-1.7e308, -1e308, 0.0, 5e-324, 1e-323, 1.0, 1.7e308, 1.7976931348623157e308] + [float("inf")] * 30
    df = spark.createDataFrame([("k", v) for v in values], "k string, x double")
    shares = [i / (len(values) - 1) for i in range(0, len(values), 3)]
    got = selection.percentiles(df, ["k"], "x", shares).first().p
    at = [s * (len(values) - 1) for s in shares]
    assert all(g == values[round(a)] for g, a in zip(got, at, strict=True) if a == int(a))


def test_empty(spark):
    assert selection.percentiles(spark.createDataFrame([], "k string, x double"), ["k"], "x", (0.5,)).collect() == []
