"""Every registered query against its DuckDB oracle (or rows-only) at sf0.001."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tests.oracle_harness import compare, duck_connect

QUERIES = E.queries()
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF_SMALL)


def test_every_query_has_a_callable():
    assert len(QUERIES) >= 70
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, SF_SMALL, name, QUERIES[name], ORACLE.get(name), con)
    assert res["status"] in ("ok", "rows-only"), res
    if name in ORACLE:
        assert res["rows"] == res["oracle_rows"]


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 20
    assert "processing_id" in df.columns and "has_next" in df.columns
