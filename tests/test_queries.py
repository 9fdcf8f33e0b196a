import pytest
from oracle import same

from tidemark.plans.queries import KV


@pytest.mark.parametrize("name,query,sql", KV, ids=[k[0] for k in KV])
def test_same_as_sql(spark, name, query, sql):
    n = same(spark, query, sql)
    assert n > 0
    if name == "as_of_snapshot":
        assert n == 123
    if name == "gc_compact":
        assert n == 5150
