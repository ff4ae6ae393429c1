"""Every registered query of the engine against its SQL, on the smallest tables."""

import pytest

from helpers import same_rows
from costloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_equals_sql(spark, tables, name):
    folder, connection = tables
    frame = catalog.QUERIES[name](spark, folder)
    if name not in catalog.ORACLES:
        assert frame.toArrow().num_rows > 0
        return
    got, want = same_rows(frame, connection, catalog.ORACLES[name])
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
