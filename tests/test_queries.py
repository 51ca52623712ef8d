"""Every query of the engine's own operators against its SQL, or at least run."""

import pytest
from compare import connect, same

from lexweave import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, data, con):
    df = QUERIES[name](spark, data)
    if name in SQL:
        same(df, con, SQL[name])
    else:
        assert df.columns and df.count() >= 0
