import pytest
from oracle import compare

from triplewright.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    assert compare(QUERIES[name], ORACLE_SQL[name], spark, sf) > 0
