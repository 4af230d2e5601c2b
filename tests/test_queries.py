import pytest
from compare import same

from chunklens import plans


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, sf, name):
    same(plans.QUERIES[name](spark, sf), plans.ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
