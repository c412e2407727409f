"""Every registered query of the library runs on the smallest tables and, where it has one, equals its oracle."""

import pytest

from tests.oracle import same
from varspan.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, name):
    if name in catalog.ORACLES:
        same(spark, sf, catalog.QUERIES[name], catalog.ORACLES[name])
    else:
        assert catalog.QUERIES[name](spark, sf).toPandas() is not None
