"""Every registered query against its SQL twin on the smallest tables."""

import pytest

from sparktraces.plans import catalog
from tests.oracle import compare, connect

REGISTRY = catalog.load()
#: Queries that SQL cannot express.
WITHOUT_TWIN: set[str] = set()
#: Queries that rightly find nothing in the smallest tables.
EMPTY_WHEN_TINY = {"entry_quality"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, sf_dir, duck, name):
    q = REGISTRY[name]
    df = q.run(spark, sf_dir)
    if q.sql is None:
        assert name in WITHOUT_TWIN and df.count() > 0
        return
    why = compare(df, duck, q.sql)
    assert why is None or why == "no rows" and name in EMPTY_WHEN_TINY, why
