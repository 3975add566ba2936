"""Every registered query with SQL gives what DuckDB gives."""

import oracle
import pytest

from loomstead import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_matches_sql(spark, con, name):
    assert not oracle.compare(spark, con, plans.QUERIES[name], plans.SQL[name], SF)
