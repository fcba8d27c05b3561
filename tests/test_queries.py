"""Every registered query against its SQL, on the smallest tables."""

import oracle
import pytest

from lodestone import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connection(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, con, name):
    assert oracle.differences(registry.QUERIES[name](spark, SF), con, registry.ORACLE_SQL[name]) == ""
