"""The pay query reads every order."""

from larkspur.plans import registry

SF = "/root/testdata/sf0.001"


def test_every_order_has_its_row(spark):
    got = registry.queries()["salary_field"](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/orders.parquet").count()
    assert {r[0] for r in got.select("currency").distinct().collect()} == {"USD", "EUR", "NOK", "CAD", "GBP", None}
