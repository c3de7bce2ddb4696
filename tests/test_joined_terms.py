"""The terms are the side that a term join sends to the workers, however small the texts' table looks."""

from pyspark.sql import functions as F

from larkspur.operators import entities


def test_texts_are_never_broadcast(spark, tmp_path):
    path = str(tmp_path / "texts")
    spark.range(50).select("id", F.concat(F.lit("a red gear "), F.col("id").cast("string")).alias("t")).write.parquet(path)
    terms = spark.createDataFrame([("red gear",), ("7",)], "term string")
    found = entities.matched(spark.read.parquet(path), "id", "t", terms, "term")
    assert "BuildLeft" not in found._jdf.queryExecution().toString()
    assert found.count() == 51
