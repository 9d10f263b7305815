"""Every registered query against its DuckDB oracle (or rows-only) at sf0.001, plus the entry smoke."""

import pytest

from threadspark.plans.catalog import ORACLES, QUERIES
from threadspark.plans.compare import compare, duck_connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, con, name, SF)
    if name in ORACLES:
        assert res["status"] == "match", res
    else:
        assert res["status"] == "rows-only" and res["spark_rows"] > 0


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
