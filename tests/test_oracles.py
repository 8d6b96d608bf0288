"""Cheap queries against their SQL on the small test tables."""

import os

import pytest
from compare import compare

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(n for n in entry.plans.QUERIES if n in entry.plans.ORACLES))
def test_query(spark, name):
    ok, said = compare(spark, name, entry.plans.QUERIES[name], entry.plans.ORACLES[name], SF)
    assert ok, said
