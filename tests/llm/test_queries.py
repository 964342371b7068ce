import os

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")

COLUMNS = {
    "p1_found": [("prediction_id", "bigint"), ("defect", "string")],
    "p2_found": [("origin", "string"), ("row_no", "bigint"), ("item_no", "bigint"), ("start_pos", "bigint"), ("end_pos", "bigint")],
    "p4_found": [("corpus_id", "string"), ("question_type", "string")],
    "p6_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
    "p8_found": [("doc_id", "bigint"), ("seg_no", "bigint"), ("lang", "string")],
}


def _run(spark, name):
    from passagemill.llm import catalog

    return catalog.queries()[name](spark, DATA)


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns(spark, name):
    found = _run(spark, name)
    assert found.dtypes == COLUMNS[name]
    keys = found.columns if name != "p6_ids" else ["doc_id"]
    assert found.count() == found.select(*keys).distinct().count() > 0


def test_two_steps_give_the_same_totals(spark):
    once, twice = (sorted(map(tuple, _run(spark, n).collect())) for n in ("p3_token_budget", "p3_token_budget_update"))
    assert once == twice


@pytest.mark.parametrize("name", ["p4_found", "p4_quotas", "p4_sample", "p5_stable_sample"])
def test_sql(spark, name):
    import duckdb

    from passagemill.llm import oracles

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    found = _run(spark, name)
    columns = sorted(found.columns)
    cursor = con.execute(oracles.SQL[name])
    heads = [d[0] for d in cursor.description]
    want = sorted(str([r[heads.index(c)] for c in columns]) for r in cursor.fetchall())
    assert sorted(str([r[c] for c in columns]) for r in found.collect()) == want
