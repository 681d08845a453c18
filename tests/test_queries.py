"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from corpuscle.plans import queries as q

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, duck, name):
    df = q.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    if name not in q.SQL:
        assert got
        return
    cur = duck.execute(q.SQL[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    want = [tuple(r[i] for i in at) for r in cur.fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_short_items_are_grounded(spark, tmp_path):
    """Items of any length, held against the query's own SQL."""
    duckdb = pytest.importorskip("duckdb")
    texts = ["The cat sat, on a MAT today.", "concatenate satin", "a cat", "", None, "one two three four five six seven", "zone two three four fives", "x one two three four five sixty", "one two", "!!!", "three four"]
    items = ["cat", "cat sat", "cat sat on", "ne two three four five", "one two three four", "two", "mat to", "", None, "?!", "one two three four five six eight", "one two three four five six", "absent", "one three", "cat on mat"]
    rows = {"documents": ("doc_id long, text string", texts), "benchmark": ("item_id long, text string", items)}
    con = duckdb.connect()
    for few in (items, items[10:12], items[:2]):
        for t, (schema, values) in rows.items():
            values = few if t == "benchmark" else values
            spark.createDataFrame(list(enumerate(values)), schema).write.mode("overwrite").parquet(f"{tmp_path}/{t}.parquet")
            con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        got = q.QUERIES["contamination_grounding"](spark, str(tmp_path)).select("doc_id", "item_id", "whole").collect()
        want = con.execute("SELECT doc_id, item_id, whole FROM (" + q.SQL["contamination_grounding"] + ")").fetchall()
        assert sorted(map(tuple, got)) == sorted(want) and want
