"""Every registered query against its SQL."""

import oracle_check
import pytest

from lipikar.plans import catalogue

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_same_rows_as_sql(spark, tiny, name):
    assert oracle_check.compare(spark, catalogue.queries()[name], SQL[name], tiny) is None


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "text"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
