import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = "/root/testdata/sf0.001"
WHOLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from lontar.runtime import session

    s = session("tests", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(WHOLE):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{WHOLE}/{name}'")
    return con


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
