import pytest

from versefold.llm import oracles, queries

from ..compare import check, database


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(name, spark, small):
    df = queries.QUERIES[name](spark, small)
    if name in oracles.ORACLES:
        check(df, database(small), oracles.ORACLES[name])
    else:
        assert df.count() > 0
