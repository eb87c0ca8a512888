"""Every registered mobility query: equal to its SQL, or it has rows (see test_brute for these)."""

import pytest

from roamer.plans import all_queries, all_sql
from tests.compare import same

Q, S = all_queries(), all_sql()


@pytest.mark.parametrize("name", sorted(S))
def test_sql(spark, sf, name):
    same(spark, sf, Q[name], S[name])


@pytest.mark.parametrize("name", sorted(set(Q) - set(S)))
def test_runs(spark, sf, name):
    df = Q[name](spark, sf)
    assert df.columns and df.count() > 0
