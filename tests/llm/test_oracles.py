"""Queries of this subpackage against their SQL over a whole small table."""

from __future__ import annotations

import pytest

from folioscope.llm.queries import ORACLE, QUERIES
from tests.test_oracle import normal, sql_result


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    got = sorted(found.columns), normal(found.columns, found.collect())
    assert got == sql_result(sf_dir, ORACLE[name])
