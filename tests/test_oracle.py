"""Every registered query against its SQL on the same tables."""

import pytest

from __spark_entry__ import oracle_sql, queries
from corpusops.plans import registry
from tools.check_oracle import norm

NAMES = sorted(queries())


def test_every_query_has_sql_or_a_test_of_its_own():
    assert not set(registry.QUERIES) - set(registry.ORACLES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, duck, name):
    got = queries()[name](spark, sf).toPandas()
    if name not in oracle_sql():
        assert len(got) > 0
        return
    want = duck.execute(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert norm(got) == norm(want)


def test_entry(spark):
    from __spark_entry__ import entry

    out = entry(spark)
    assert {"chunk_id", "score", "vector_score", "text_score"} <= set(out.columns)
    assert out.count() > 0
