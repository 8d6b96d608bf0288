"""Queries of the text operators against their SQL on the small test tables."""

import os

import pytest
from compare import compare

from threadloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    ok, said = compare(spark, name, queries.QUERIES[name], queries.ORACLES[name], SF)
    assert ok, said
