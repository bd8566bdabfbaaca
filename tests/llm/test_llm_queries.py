"""Queries of the training-data problems over the smallest tables."""

import pytest
from compare import DATA, connection, have_data, rows_of, same_rows

from tonelake.llm import queries
from tonelake.llm.sql import SQL

pytestmark = pytest.mark.skipif(not have_data(), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    same_rows(queries.QUERIES[name](spark, DATA), connection(), SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(SQL)))
def test_runs(spark, name):
    rows = rows_of(queries.QUERIES[name](spark, DATA))[1]
    assert rows and rows == rows_of(queries.QUERIES[name](spark, DATA))[1]  # some rows, and the same ones again
