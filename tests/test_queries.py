"""Every query of the engine that has SQL against that SQL, on the smallest tables."""

import pytest

from loomstrand.oracles import ORACLE_SQL
from loomstrand.queries import QUERIES

from .conftest import canonical


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, duck, small, name):
    got = [r.asDict() for r in QUERIES[name](spark, small).collect()]
    rel = duck.sql(ORACLE_SQL[name])
    want = [dict(zip(rel.columns, row, strict=True)) for row in rel.fetchall()]
    assert canonical(got) == canonical(want)


def test_entry_lists_every_query():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
