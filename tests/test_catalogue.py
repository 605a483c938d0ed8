import pytest

import __spark_entry__ as entry
from tessera.plans import catalogue
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, name):
    assert_same(catalogue.QUERIES[name](spark, SF), catalogue.ORACLES[name], SF)


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() == 18


def test_rows_only_queries(spark):
    for name in set(catalogue.QUERIES) - set(catalogue.ORACLES):
        assert catalogue.QUERIES[name](spark, SF).count() > 0
