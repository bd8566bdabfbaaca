"""Every query over the smallest tables: against its SQL counterpart where there is one, else it must give rows, and the same ones again."""

import pytest
from compare import DATA, connection, have_data, rows_of, same_rows

from tonelake.plans import excerpts, problems, ratings, relations, sessions, study, submissions, summaries, vectors

MODULES = [problems, ratings, vectors, study, relations, submissions, excerpts, summaries, sessions]
QUERIES = {n: f for m in MODULES for n, f in m.QUERIES.items()}
SQL = {n: s for m in MODULES for n, s in m.SQL.items()}

#: the smallest tables hold no devices
NO_ROWS = {"p4_devices", "p4_device_levels"}

pytestmark = pytest.mark.skipif(not have_data(), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    same_rows(QUERIES[name](spark, DATA), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    rows = rows_of(QUERIES[name](spark, DATA))[1]
    assert (rows or name in NO_ROWS) and rows == rows_of(QUERIES[name](spark, DATA))[1]  # some rows, and the same ones again


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_spearman_pairs_of_all_scalars(spark):
    assert QUERIES["spearman_pairs"](spark, DATA).select("x", "y").distinct().count() == 28
