"""Queries against their SQL on small tables of the rows on which they once differed."""

import itertools

import pytest

from corpuscle.plans import queries as q


def held(spark, tmp_path, name, **tables):
    """The query's and the SQL's rows over tables given as (schema, rows)."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = q.QUERIES[name](spark, str(tmp_path))
    cols = ", ".join(f'"{c}"' for c in df.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got, want = [tuple(r) for r in df.collect()], con.execute(f"SELECT {cols} FROM ({q.SQL[name]})").fetchall()
    return sorted(got, key=key), sorted(want, key=key)


def lines():
    """Orders of up to four lines of any depth in the first bucket and four in the second, under
    required years and each number of known ones."""
    rows, key = [], 0
    for n in range(5):
        for depths in itertools.combinations_with_replacement(range(4), n):
            for other in ((0, 0, 1, 3), (2, 3, 3, 3)):
                for residue in (21, 36, 9, 3, 18, 12, 6):  # of 105: divisible by 3, not by 5, 0 to 6 by 7
                    key += 105
                    rows += [(key + residue, 4 + d, "N", 0.3 + d / 10) for d in depths] + [(key + residue, 4 + d, "R", 0.5) for d in other]
    return "l_orderkey long, l_linenumber int, l_returnflag string, l_discount double", rows


@pytest.mark.parametrize("name", ["candidate_report", "frontend_rows", "sheet_export"])
def test_points_on_a_half_cent(spark, tmp_path, name):
    got, want = held(spark, tmp_path, name, lineitem=lines())
    assert got == want and len(got) == 980


def test_a_score_on_the_verdicts_limit(spark, tmp_path):
    """1 - 0.55 is 0.45: suspect, not bad."""
    texts = ["skills and experience", "Education", None, "", "x" * 130 + " skills", "contact me at a@b.co", "(cid:7) skills of somebody, written down"]
    got, want = held(spark, tmp_path, "extract_documents", documents=("doc_id long, text string", list(enumerate(texts, 1))))
    assert got == want and "suspect" in {r[3] for r in got}


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


TEXTS = ["", None, "hand", "Ünï çöde \U0001f600\U0001f600 hand", "thing heat\nhand and mention\n\nches tion", "ab", "x" * 50 + "\n" + "hand " * 30, "eren eren\nthing\nthing heat heat\neren 12"]


def test_features_are_counted_within_their_row(spark, tmp_path):
    """Equal to the SQL, also for an id that comes twice; one shuffle, of counts."""
    got, want = held(spark, tmp_path, "hashing_vector", documents=("doc_id long, text string", [*enumerate(TEXTS), (4, "hand 12")]))
    assert got == want and want
    _, physical = plan(q.QUERIES["hashing_vector"](spark, str(tmp_path)))
    assert physical.count("Exchange hashpartitioning") == 1


def test_terms_move_once(spark, tmp_path):
    got, want = held(spark, tmp_path, "bm25_term_stats", documents=("doc_id long, text string", [*enumerate(TEXTS), (4, "hand 12")]))
    assert got == want and want
    _, physical = plan(q.QUERIES["bm25_term_stats"](spark, str(tmp_path)))
    assert physical.count("Exchange hashpartitioning") == 1


def test_fingerprints_are_made_once(spark, tmp_path):
    got, want = held(spark, tmp_path, "dup_components", documents=("doc_id long, text string", list(enumerate(TEXTS[2:] * 2))))
    assert got == want and want
    assert "ArrowEvalPython" not in plan(q.QUERIES["dup_components"](spark, str(tmp_path)))[0]


def test_fusion_joins_nothing(spark, tmp_path):
    got, want = held(spark, tmp_path, "hybrid_fusion_topk", documents=("doc_id long, text string", list(enumerate(TEXTS * 3))))
    assert got == want and want
    assert "Join" not in plan(q.QUERIES["hybrid_fusion_topk"](spark, str(tmp_path)))[0]


def test_a_long_paragraph_is_joined_once(spark, tmp_path):
    """Lines by the thousand in one paragraph; the fold holds numbers, not the text that grows."""
    text = "\n".join(f"line {i} of a long paragraph" for i in range(3000))
    got, want = held(spark, tmp_path, "extract_documents", documents=("doc_id long, text string", [(1, text), (2, "a\n\nb"), (7, "c")]))
    assert got == want
