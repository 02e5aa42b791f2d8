"""Queries against their registered SQL."""

import pytest

from lexikv.llm.oracles import SQL
from lexikv.llm.queries import QUERIES
from tests.test_queries import SF, _key, duck  # noqa: F401


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):  # noqa: F811
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    rows = [sorted(tuple(map(_key, r)) for r in f[sorted(f.columns)].itertuples(index=False)) for f in (ours, theirs)]
    assert rows[0] == rows[1]
