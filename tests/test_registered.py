"""Every registered query against its SQL on the smallest tables."""

import __spark_entry__ as entry
import pytest
from attesta.plans import registry
from compare import connect, differences

SF = "/root/testdata/sf0.001"
QUERIES, CHECKS = registry.queries(), registry.checks()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    result = QUERIES[name](spark, SF)
    assert name in CHECKS
    assert differences(result, con, CHECKS[name]) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
