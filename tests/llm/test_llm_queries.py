"""Every text query has a result, the same as its SQL where it has one."""

import pytest
from conftest import WHOLE

from lontar.llm.queries import QUERIES
from lontar.llm.sql import SQL

COLUMNS = {
    "p2_found": ["entry_id", "keep_id"],
    "p3_found": ["id", "defect"],
    "p4_found": ["id_a", "id_b"],
    "p6_found": ["table_name", "id_a", "id_b"],
    "p7_found": ["regulation_key", "group_key"],
    "p8_ids": ["doc_id", "ids"],
    "p9_found": ["doc_id", "case_id"],
    "p10_found": ["doc_id", "kind"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, WHOLE)
    rows = [tuple(r) for r in df.collect()]
    assert df.columns == COLUMNS.get(name, df.columns)
    assert rows
    assert name == "p8_ids" or name.endswith("s") or len(rows) == len(set(map(repr, rows)))
    if name in SQL:
        cursor = duck.execute(SQL[name])
        columns = [c[0] for c in cursor.description]
        assert sorted((tuple(r[columns.index(c)] for c in df.columns) for r in cursor.fetchall()), key=repr) == sorted(rows, key=repr)
