import pytest

import __spark_entry__ as entry
from helpers import DATA, same_as_sql
from loomglot.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    same_as_sql(duck, QUERIES[name](spark, DATA), ORACLE_SQL[name])


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "completion" in df.columns


def test_every_catalog_query_is_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())
