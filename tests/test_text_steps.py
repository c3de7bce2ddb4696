"""Costly parts of text functions are made once, and redaction goes by lines without losing anything."""

import pytest
from pyspark.sql import functions as F

from larkspur.functions import text as T


def plan(spark, column):
    return spark.range(1).select(F.col("id").cast("string").alias("t")).select(column(F.col("t")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()


def test_the_sources_numbers_are_found_outside_the_sentences(spark):
    found = plan(spark, lambda t: T.numbers_grounded(t, F.concat(F.lit("source "), t)))
    assert found.count("source ") == 1 and found.index("source ") < found.index("filter(split")


def test_the_json_of_a_contract_is_made_once(spark):
    assert plan(spark, lambda t: T.contract_of(F.concat(F.lit("made "), t))).count("made ") == 1


@pytest.mark.parametrize("text, want", [
    ("vat ABCDEFG", "[ID]"), ("no\nwww.a.b\n\nx.y@z.org\n", "no\n[LINK]\n\n[EMAIL]\n"), ("call\n+39 333 1234567\nor 030 1234567", "call\n[PHONE]\nor [PHONE]"), ("", ""), ("github.com/a", "[LINK]"), (None, None), ("plain\n\ntext", "plain\n\ntext"),
])
def test_redaction_by_lines(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(T.redact(F.col("t"))).first()[0]
    assert got == want
