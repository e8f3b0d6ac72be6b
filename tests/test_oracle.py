"""Oracle parity: every registered query with SQL equals DuckDB on the same tables."""
import pytest

import __spark_entry__ as E
from cohortlens.plans.compare import compare, duck

ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_duckdb(frame_of, con, name):
    ok, msg = compare(frame_of(name), con, ORACLES[name])
    assert ok, f"{name}: {msg}"


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "vle_total_clicks" in df.columns
