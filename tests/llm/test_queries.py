import pytest

from roamer.llm.queries import oracle_sql, queries
from tests.compare import same


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, sf, name):
    same(spark, sf, queries()[name], oracle_sql()[name])


def test_there_is_one_of_each():
    assert [n.split("_")[0] for n in queries()] == [f"op{i}" for i in range(1, 11)]
