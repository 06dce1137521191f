"""Every registered query against its SQL on the smallest tables."""

import pytest

from kinfold.workload import queries_and_sql
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries_and_sql()))
def test_query(spark, name):
    f, sql = queries_and_sql()[name]
    compare(spark, SF, f, sql)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
