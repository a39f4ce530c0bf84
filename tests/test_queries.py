import pytest

from siftwell.plans.sql import oracle_sql

from .compare import compare


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, name):
    compare(spark, name, "/root/testdata/sf0.001")


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
