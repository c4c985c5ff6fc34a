"""Registered queries of the subpackage: against their SQL where there is some, and over whole tables."""

import pytest
from compare import compare, connect

from textprep.llm.queries import CHECKS, QUERIES


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_sql(name, spark, sf_dir):
    assert compare(QUERIES[name](spark, sf_dir), connect(sf_dir), CHECKS[name]) is None


@pytest.mark.parametrize("number", range(1, 14))
def test_one_query_each(number):
    assert sum(name.startswith(f"op{number}_") for name in QUERIES) == 1
