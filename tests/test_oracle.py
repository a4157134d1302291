"""Every registered query against its SQL, on the smallest tables."""

import pytest

from pagestrata.plans import catalog
from tests.oracle import compare, connect

#: Queries that SQL cannot express or that still lack it; they are tested against brute force elsewhere or only run here.
NO_SQL = {"consolidate_items", "outside_text_blocks"}
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    ok, message, rows, _ = compare(spark, duck, name, SF)
    assert ok, message
    assert rows > 0 or name in catalog.ORACLES
    assert (name in catalog.ORACLES) != (name in NO_SQL)
