"""Every query with SQL gives DuckDB's rows; the others run and have columns."""

import pytest

from lodestone.plans import catalog
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_same_rows_as_sql(spark, con, name):
    oracle.compare(spark, con, catalog.queries()[name], catalog.oracles()[name], SF)


@pytest.mark.parametrize("name", sorted(catalog.queries().keys() - catalog.oracles().keys()))
def test_runs(spark, name):
    df = catalog.queries()[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert e.oracle_sql().keys() <= e.queries().keys()
