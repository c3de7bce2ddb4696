"""Every registered query with SQL gives the rows of that SQL; the others run."""

import pytest

from larkspur.plans import registry

from .oracle import differences

SF = "/root/testdata/sf0.01"
#: queries whose own result is checked elsewhere (no SQL form)
PLAIN = sorted(set(registry.queries()) - set(registry.oracle_sql()))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert differences(spark, SF, registry.queries()[name], registry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", PLAIN)
def test_query_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
