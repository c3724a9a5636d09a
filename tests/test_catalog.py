"""Every registered query against its SQL on the smallest tables."""

import math

import pytest

import __spark_entry__ as entry
from tincture.plans import catalog

from .conftest import SMALL


def values(frame):
    columns = sorted(frame.columns)
    clean = lambda v: "" if v is None or isinstance(v, float) and math.isnan(v) else str(v)
    return columns, sorted(tuple(map(clean, r)) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SMALL).toPandas()
    if name in catalog.oracle_sql():
        assert values(got) == values(duck.execute(catalog.oracle_sql()[name]).df())
    else:
        assert len(got)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
