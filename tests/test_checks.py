"""Every registered query against its check SQL, on the same tables."""

import pytest

from compare import compare, connect
from textprep.plans.catalogue import CHECKS, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, con, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    if name not in CHECKS:
        assert df.count() > 0
        return
    assert compare(df, con, CHECKS[name]) is None
    assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
