"""Every query beside its SQL, and rows from those that SQL cannot express."""

import pytest

from compare import differences
from tensorloom.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_equals_sql(spark, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    if name in catalogue.ORACLES:
        assert differences(df, catalogue.ORACLES[name], sf_dir) == []
    else:
        assert df.take(1)


def test_entry_points_without_the_training_operators(spark):
    import __spark_entry__ as entry

    assert {*catalogue.QUERIES} <= {*entry.queries()}
    assert {*entry.oracle_sql()} <= {*entry.queries()}
    assert entry.entry(spark).columns
