"""Every core query against its SQL, over the smallest tables."""

import pytest

from tests.compare import same
from trendloom.plans import catalogue

NAMES = sorted(catalogue.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, data, duck, name):
    got = catalogue.queries()[name](spark, data).toPandas()
    same(got, duck.execute(catalogue.oracle_sql()[name]).df())


def test_every_sql_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["msg_id", "field", "utc_us"] and df.count() > 0
