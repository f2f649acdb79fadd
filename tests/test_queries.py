"""Every core query against its SQL, and that it has a result at all."""

import pytest
from conftest import WHOLE

from lontar.plans.queries import QUERIES
from lontar.plans.sql import SQL


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, WHOLE)
    mine = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    assert mine
    if name not in SQL:
        return
    cursor = duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    theirs = sorted((tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in cursor.fetchall()), key=repr)
    assert mine == theirs


def test_entry_imports():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
