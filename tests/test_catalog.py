"""Every registered query is built and runs on the smallest tables, where those are there."""

import os

import pytest

import __spark_entry__ as e
from leafmill.plans import catalog

SF = "/root/testdata/sf0.001"


def test_names():
    assert set(e.oracle_sql()) <= set(e.queries()) and catalog.FLAGSHIP in e.queries()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_core_query(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0
