"""Special cases of the record functions whose queries read whole columns."""

import pytest
from pyspark.sql import functions as F

from larkspur.functions import udfs as U
from larkspur.operators import paging, places
from larkspur.plans import records

STRINGS = [("$18.25 per hour", (18.25, 18.25, "USD", "hour")), ("2.800 € - 3.100 € monatlich", (2800, 3100, "EUR", "month")), ("NOK 610 000", (610000, 610000, "NOK", None)), ("competitive", None), ("12 - 15", None), ("C$ 70k a year", (70000, 70000, "CAD", "year")), ("$2 - $900000", None), (None, None)]


@pytest.mark.parametrize("name", sorted(records.WHOLE))
def test_cases(spark, name):
    inputs, outputs, cases = records.CASES[name]
    rows = spark.createDataFrame([(i, *given) for i, (given, _) in enumerate(cases)], f"i long, {inputs}")
    got = {r.i: tuple(r)[1:] for r in rows.select("i", *(make().alias(out) for out, make in outputs.items())).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_nul_is_removed(spark):
    _, outputs, _ = records.CASES["nul_removed"]
    assert spark.createDataFrame([("a\x00b\x00",)], "t string").select(outputs["t2"]()).first()[0] == "ab"


def test_salary_strings(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(STRINGS)], "i long, t string")
    got = {r.i: r.s and tuple(r.s) for r in rows.select("i", U.field_salary("t").alias("s")).collect()}
    for i, (_, want) in enumerate(STRINGS):
        assert (got[i] if got[i] and any(x is not None for x in got[i]) else None) == want


def test_places(spark):
    countries = spark.createDataFrame([("Germany", "DE"), ("India", "IN"), ("France", "FR"), ("Georgia", "GE"), ("Canada", "CA"), ("United States", "US")], "name string, code string")
    towns = spark.createDataFrame([("Berlin", "DE", 3_500_000), ("Bengaluru", "IN", 8_400_000), ("Toronto", "CA", 2_700_000), ("Paris", "FR", 2_100_000), ("Paris", "US", 25_000), ("Springfield", "US", 150_000), ("Köln", "DE", 1_000_000), ("Aix-en-Provence", "FR", 140_000), ("Gary", "US", 69_000)], "name string, country string, population long")
    rows = spark.createDataFrame([(i, *given) for i, (given, _) in enumerate(records.PLACE_CASES)], "i long, place string")
    got = {r.i: r.country for r in places.countries_of(rows, "i", "place", countries, towns).collect()}
    assert got == {i: want[0] for i, (_, want) in enumerate(records.PLACE_CASES) if want[0] is not None}


def test_most_populous_town(spark):
    towns = spark.createDataFrame([("Paris", "FR", 48.85, 2.35, 2_100_000), ("Paris", "FR", 0.0, 0.0, 10), ("Paris", "US", 33.66, -95.55, 25_000)], "name string, country string, lat double, lon double, population long")
    rows = spark.createDataFrame([(0, "PARIS, centre", "fr"), (1, "Páris", "US"), (2, "Paris", None), (3, "Atlantis", "GR"), (4, None, "FR")], "i long, city string, country string")
    got = {r.i: r.lat for r in places.coordinates(rows, "city", "country", towns).collect()}
    assert got == {0: 48.85, 1: 33.66, 2: None, 3: None, 4: None}


def test_row_cursors(spark):
    rows = spark.createDataFrame([(1, 'a "b"'), (2, None), (3, "é>?~")], "i long, t string").select("i", "t", paging.row_cursor("t", "i").alias("token"))
    for r in rows.collect():
        assert paging.read_cursor(r.token, 2) == [r.t, str(r.i)]
    assert [tuple(r.v) for r in rows.select(paging.row_values(rows.token).alias("v")).collect()] == [('a "b"', "1"), (None, "2"), ("é>?~", "3")]
    assert spark.createDataFrame([("%%%",)], "t string").select(paging.row_values(F.col("t")).alias("v")).first().v is None
