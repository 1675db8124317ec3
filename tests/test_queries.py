"""Every query against its SQL, and those without SQL for their rows."""

import pytest

from roundweave.plans import ORACLES, QUERIES
from tests.conftest import SF, same_rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    ours = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        same_rows(ours, duck.sql(ORACLES[name]).df())
    else:
        assert len(ours)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 1
