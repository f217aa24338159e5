"""The queries that SQL can express give DuckDB's rows."""

import pytest

from lodestone.llm import queries
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    oracle.compare(spark, oracle.duck(SF), queries.QUERIES[name], queries.ORACLES[name], SF)
