"""Registered queries against their SQL on the smallest tables."""

import math
import os

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.5g}"
    if isinstance(v, (list, tuple)):
        return str([_cell(x) for x in v])
    return str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def _names():
    from passagemill.plans import catalog

    return sorted(catalog.oracle_sql())


@pytest.mark.parametrize("name", _names() if os.path.isdir(DATA) else [])
def test_query_matches_its_sql(spark, duck, name):
    from passagemill.plans import catalog

    found = catalog.queries()[name](spark, DATA)
    columns = sorted(found.columns)
    got = sorted(tuple(_cell(v) for v in r) for r in found.select(*columns).collect())
    cursor = duck.execute(catalog.oracle_sql()[name])
    heads = [d[0] for d in cursor.description]
    assert sorted(heads) == columns
    want = sorted(tuple(_cell(r[heads.index(c)]) for c in columns) for r in cursor.fetchall())
    assert got == want


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["question_no", "passage_id", "score", "rank", "path"]
    assert set(e.oracle_sql()) <= set(e.queries())
