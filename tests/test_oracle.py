"""Every query with an oracle SQL text equals DuckDB on the same tables."""

import pytest

import __spark_entry__ as E
from tests.oracle_harness import duck, rows_of

SQL = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con(small_dir):
    return duck(small_dir)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(SQL))
def test_matches_duckdb(spark, small_dir, con, key):
    got = QUERIES[key](spark, small_dir).toPandas()
    want = con.execute(SQL[key]).df()
    gc, gr = rows_of(got)
    wc, wr = rows_of(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["customer", "recency_days", "frequency", "monetary",
                          "r_score", "f_score", "m_score", "rfm_score"]
    assert df.count() >= 0
