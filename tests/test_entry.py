"""The queries against their SQL on the smallest tables, where these are there."""

import hashlib
import glob
import os

import __spark_entry__ as entry
import pytest
from lodestrata.plans import catalogue, oracle

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def told(x):
    return "-" if x is None else f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", list(oracle.ORACLES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SMALL)
    found = duck.sql(oracle.ORACLES[name])
    assert sorted(df.columns) == sorted(found.columns)
    want = found.fetchall()
    order = [found.columns.index(c) for c in df.columns]
    assert sorted(tuple(map(told, r)) for r in df.collect()) == sorted(tuple(told(r[i]) for i in order) for r in want)


def test_entry(spark, duck):
    df = entry.entry(spark)
    assert df.columns == ["event_id", "user_id", "event_type", "value"]
    want = duck.sql("SELECT event_id, user_id, event_type, value FROM events WHERE value BETWEEN 20 AND 60").fetchall()
    assert len(want) > 100 and sorted(map(tuple, df.collect())) == sorted(want)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_sha512(spark, duck):
    texts = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    got = {r["doc_id"]: r["digest"] for r in catalogue.QUERIES["sha512"](spark, SMALL).collect()}
    assert got == {i: None if t is None else hashlib.sha512(t.encode()).hexdigest() for i, t in texts.items()}


def test_other_queries_stand_alone():
    """Without the training-data operators, or what they need, all other queries are there."""
    import subprocess
    import sys

    told = "import sys; sys.modules['xxhash'] = None\nimport __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", told], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert out.stdout.split() == [str(len(catalogue.QUERIES)), str(len(oracle.ORACLES))]
