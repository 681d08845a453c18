import io
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpuscle.functions import vectors
from corpuscle.operators import candidates, dedup, evaluation, extraction, judge, layout, ordering, report, scoring, skills
from corpuscle.sources import files, pages
from corpuscle.streaming import jobs


def scored(spark, depths, importances, required=None, years=None):
    rows = [(1, f"s{i}", imp, d) for i, (d, imp) in enumerate(zip(depths, importances))]
    b = scoring.buckets(spark.createDataFrame(rows, "doc_id int, skill string, importance string, depth string"), ["doc_id"])
    return scoring.score(b, F.lit(required).cast("double"), F.lit(years).cast("double")).first()


def test_scores(spark):
    m, p = "mandatory", "preferred"
    assert round(scored(spark, ["strong"] * 3, [m, m, p]).score, 6) == 100
    r = scored(spark, ["strong", "none", "used"], [m, m, p])
    assert r.m_earned == 35.0 and round(r.score, 6) == round(r.m_earned + r.p_earned, 6) == 59.0
    assert round(scored(spark, ["strong", "strong"], [m, m]).score, 6) == 100
    assert round(scored(spark, ["strong"] * 3, [m, m, p], 5.0, 2.0).score, 6) == 91
    assert round(scored(spark, ["strong"] * 3, [m, m, p], 5.0, 4.6).score, 6) == 100
    assert round(scored(spark, ["strong"] * 3, [m, m, p], 0.0, 1.0).score, 6) == 100
    assert round(scored(spark, ["strong"] * 3, [m, m, p], 5.0, None).score, 6) == 100


def test_rank(spark):
    d = spark.createDataFrame([("b", 20.0, 0), ("a", 90.0, 3), ("c", 55.0, 1), ("d", 55.0, 2)], "path string, score double, shown int")
    got = scoring.rank(d, ["score", "shown"]).orderBy("rank").collect()
    assert [r.path for r in got] == ["a", "d", "c", "b"] and [r.near_tie for r in got] == [False, False, True, False]


def test_rule_judge(spark):
    rows = [(1, "Python", 1, "skills", "Python, SQL"), (1, "Python", 2, "experience", "Wrote python for 3 teams"), (1, "Go", 1, "skills", "Go"), (1, "Rust", 1, "skills", "none here")]
    got = {r.skill: r.depth for r in judge.judge_by_rule(spark.createDataFrame(rows, "doc_id int, skill string, k int, section string, chunk string")).collect()}
    assert got == {"Python": "strong", "Go": "mentioned", "Rust": "none"}


def test_model_judge_failure_is_a_row(spark):
    p = spark.createDataFrame([(1, "x")], "doc_id int, prompt string")

    def broken(prompts):
        raise RuntimeError("no network")

    assert judge.judge_by_model(p, broken).first().answer is None
    assert judge.judge_by_model(p, lambda prompts: [s.upper() for s in prompts]).first().answer == "X"


def test_distinct_skills(spark):
    got = spark.sql("select array(named_struct('name', 'A', 'category', null, 'alternatives', array('B', 'a')), named_struct('name', 'b', 'category', null, 'alternatives', null), named_struct('name', 'C', 'category', 'x', 'alternatives', null)) as i").select(skills.distinct_skills(F.col("i").cast("array<struct<name:string,category:string,alternatives:array<string>>>")).alias("k")).first().k
    assert [(x["name"], x["alternatives"]) for x in got] == [("A", ["B"]), ("C", [])]


def test_padded_alternatives(spark):
    kind = "array<struct<name:string,category:string,alternatives:array<string>>>"
    got = spark.sql("select array(named_struct('name', ' A ', 'category', null, 'alternatives', array(' B ', ' A ', '0x', '1'))) as i").select(skills.distinct_skills(F.col("i").cast(kind)).alias("k")).first().k
    assert [(x["name"], x["alternatives"]) for x in got] == [("A", ["B", "0x", "1"])]


def test_requirements_by_rule(spark):
    text = "\n Senior Data Engineer \nPython, C++ and CI/CD; 5+ years. Gopher is no go-to.\nNice to have: Kafka, python, Docker"
    got = skills.requirements_by_rule(spark.createDataFrame([(1, text), (2, None)], "jd_id int, text string")).orderBy("jd_id").collect()
    assert got[0].role_title == "Senior Data Engineer" and got[0].min_years == 5 and got[0].mandatory == ["Python", "Go", "C++", "CI/CD"] and got[0].preferred == ["Kafka", "Docker"]
    assert got[1].mandatory == [] and got[1].role_title == "Role"


def test_running_over_partitions(spark):
    d = spark.range(1000).selectExpr("id", "(id * 7919) % 1000 as x", "id % 3 as v").repartition(7)
    got = ordering.running(d, [F.desc("x")], "v", "before", last="id").orderBy(F.desc("x")).collect()
    total, last = 0, None
    for r in got:
        assert (r.before, r["_last"]) == (total, last)
        total, last = total + r.v, r.id
    assert "SinglePartition" not in ordering.running(d, ["x"])._jdf.queryExecution().executedPlan().toString()
    assert ordering.running(d.limit(0), ["x"]).count() == 0


def test_columns_of_a_page(spark):
    """Wide blocks and such that reach into the gutter are full width; the gutter is widened first."""
    box = [(1, 40.0, 0.0, 425.0), (2, 40.0, 20.0, 190.0), (3, 330.0, 20.0, 540.0), (4, 40.0, 40.0, 200.0), (5, 205.0, 60.0, 325.0), (6, 340.0, 80.0, 500.0), (7, 45.0, 90.0, 150.0)]
    b = spark.createDataFrame([(1, i, x0, y, x1, y + 10) for i, x0, y, x1 in box], "page int, block_id int, x0 double, y0 double, x1 double, y1 double")
    g = spark.createDataFrame([(1, 250.0, 300.0)], "page int, x0 double, x1 double")
    got = {r.block_id: (r.col, r.ord) for r in layout.reading_order(b, g, ["page"]).collect()}
    assert got == {1: (-1, 0), 2: (0, 1), 4: (0, 2), 3: (1, 3), 5: (-1, 4), 7: (0, 5), 6: (1, 6)}
    alone = layout.reading_order(b, g.limit(0), ["page"]).orderBy("ord").collect()
    assert [r.block_id for r in alone] == [1, 2, 3, 4, 5, 6, 7] and {r.col for r in alone} == {-1}


def test_lines_grow_with_their_words(spark):
    """Four words, each a little lower than the one before: one line, as its centre moves along."""
    rows = [(1, 1, i, 30.0 * i, 5.0 * i, 30.0 * i + 20, 5.0 * i + 10) for i in range(4)] + [(1, 1, 9, 0.0, 80.0, 10.0, 80.2)]
    w = spark.createDataFrame(rows, "doc_id int, page int, word_id int, x0 double, y0 double, x1 double, y1 double")
    assert {r.word_id: r.line for r in layout.cluster_lines(w).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 9: 1}


def test_words_to_line_blocks(spark):
    raw = [(1, 1, 0, "Name", "95", 40, 0, 100, 10), (1, 1, 1, "", "99", 0, 0, 1, 1), (1, 1, 2, "Left", "90", 40, 30, 60, 10), (1, 1, 3, "Right", "80", 320, 30, 60, 10), (1, 1, 4, "blur", "12", 40, 60, 60, 10), (1, 1, 5, "odd", "n/a", 40, 60, 60, 10), (1, 1, 6, "side", "70", 105, 30, 40, 10)]
    words = layout.read_words(spark.createDataFrame(raw, "doc_id int, page int, word_id int, text string, conf string, left int, top int, width int, height int"), 1.0)
    g = spark.createDataFrame([(1, 1, 200.0, 300.0)], "doc_id int, page int, x0 double, x1 double")
    got = sorted((r.y0, r.col, r.text, r.confidence) for r in layout.line_blocks(words, g).collect())
    assert got == [(0.0, -1, "Name", 95.0), (30.0, 0, "Left side", 80.0), (30.0, 1, "Right", 80.0)]
    t = spark.createDataFrame([(1, 0, 90.0, 300), (1, 1, 99.0, 400), (2, 0, 60.0, 100), (2, 1, 80.0, 100), (2, 2, 80.0, 100)], "doc_id int, nth int, mean_confidence double, n_words int")
    t = t.withColumn("score", layout.attempt_score(F.col("mean_confidence"), F.col("n_words")))
    assert sorted((r.doc_id, r.nth) for r in layout.best_attempts(t, ["doc_id"], "nth").collect()) == [(1, 0), (2, 1)]


def test_pages_by_a_plugged_reader(spark):
    def reader(content):
        """A reader of a made-up format: pages apart by form feeds."""
        if content.startswith(b"locked"):
            raise ValueError("PDF is password-protected")
        parts = content.decode().split("\f")
        for p in parts:
            spans = [{"block": i, "text": t, "x0": 40.0, "y0": 20.0 * i, "x1": 300.0, "y1": 20.0 * i + 10, "size": 10.0, "bold": False} for i, t in enumerate(p.split("|")) if p]
            yield {"n_pages": len(parts), "width": 595.0, "height": 842.0, "images": 0 if p else 1, "spans": spans, "tables": [{"x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0, "rows": [["a", ""], ["", None], ["b", "c"]]}], "links": ["https://a.b", "https://a.b"]}

    many = "\f".join(f"page {i}" for i in range(20)).encode()
    f = spark.createDataFrame([("a.pdf", bytearray(b"Jane Roe|EXPERIENCE|Built 2019 - 2021\f")), ("b.pdf", bytearray(b"locked")), ("c.pdf", bytearray(many))], "path string, content binary")
    got = pages.read_pages(f, reader).cache()
    assert got.groupBy("path").count().orderBy("path").collect() == [("a.pdf", 2), ("b.pdf", 1), ("c.pdf", 12)]
    assert got.where("path = 'b.pdf'").first().error == "ValueError: PDF is password-protected"
    notes = {r.path: r.warnings for r in pages.page_warnings(got).collect()}
    assert notes["a.pdf"] == ["page 2: no text layer but images present — scanned page"] and notes["c.pdf"][0].startswith("document has 20 pages; processing first 12")
    t = got.where("path = 'a.pdf' and page = 1").select(pages.whole_tables(F.col("tables")).alias("t")).first().t
    assert [list(r) for r in t[0].rows] == [["a", ""], ["b", "c"]]
    assert got.where("path = 'a.pdf' and page = 1").select(pages.table_text(F.col("tables")[0]["rows"]).alias("t")).first().t == "a | \n | \nb | c"
    assert pages.document_links(got).where("path = 'a.pdf'").first().links == ["https://a.b"]
    # and on to documents
    spans = got.where("error is null").select(F.col("path").alias("doc_id"), "page", F.inline("spans")).withColumn("nth", F.lit(0)).withColumn("line", F.lit(0))
    blocks = pages.span_blocks(spans, ["doc_id", "page"]).withColumnRenamed("block", "block_id")
    of = got.select(F.col("path").alias("doc_id"), "page", F.when(F.col("error").isNull(), "native").alias("method"), F.lit(None).cast("double").alias("ocr_confidence"), "error")
    links = pages.document_links(got).withColumnRenamed("path", "doc_id")
    docs, sections = extraction.extract(blocks, of, links=links)
    by = {r.doc_id: r for r in docs.collect()}
    assert by["a.pdf"].text == "Jane Roe\n\nEXPERIENCE\nBuilt 2019 - 2021\n\nhttps://a.b" and by["a.pdf"].ok and by["a.pdf"].method == "native" and by["a.pdf"].n_pages == 2
    assert not by["b.pdf"].ok and by["b.pdf"].method == "none" and by["b.pdf"].confidence == 0 and by["b.pdf"].error
    assert [(r.section, r.body) for r in sections.where("doc_id = 'a.pdf'").orderBy("pos").collect()] == [("header", "Jane Roe"), ("experience", "Built 2019 - 2021")]
    # screened as one job
    asked = spark.createDataFrame([(0, "Built", "mandatory", "built"), (1, "Rust", "preferred", "rust")], "pos int, skill string, importance string, q_text string")
    ranked, judged, bad = candidates.screen(docs.withColumn("path", F.concat(F.lit("in/"), "doc_id")), sections, asked, F.lit("2026-07-01").cast("date"), "Engineer", 5.0)
    top = ranked.orderBy("rank").first()
    # half of the chunks name no skill; the one that does is in experience with digits: strong
    assert top.path == "in/a.pdf" and top.score == round(70 * 0.85 + 15 * (2.9 / 5), 1) and top.matched_skills == ["Built"]
    assert top.summary == "Moderate match for Engineer. 1/1 required skills demonstrated (1 strongly). 0/1 preferred demonstrated. 2.9 years experience (below the 5-year bar)."
    assert "2.9 years experience (5 required)" in top.missing_or_weak and top.explanation.startswith("Score 68/100 for a.pdf:\n  - Mandatory skills: 60 of 60 — 1 demonstrated")
    assert [(r.file, r.error) for r in bad.collect()] == [("b.pdf", "ValueError: PDF is password-protected")]
    job = candidates.run_job("j1", ranked, bad, 3).first()
    assert (job.completed, job.failed, job.percent, job.leader) == (2, 1, 100, "in/a.pdf")
    shown = candidates.frontend(ranked, judged, sections).where("rank = 1").first()
    assert shown.name == "Jane Roe" and shown.experienceYears == "2.9 Yrs" and shown.strengths[0].startswith("Built — ") and shown.avatarUrl.startswith("data:image/svg+xml;base64,")
    with pytest.raises(ValueError):
        candidates.screen(docs.withColumn("path", F.col("doc_id")), sections, asked.limit(0), F.current_date())


def test_stored_results_and_labels(spark, tmp_path):
    d = spark.createDataFrame([("x/a b.pdf", 1, 90.0), ("y/a b.pdf", 2, 40.0), ("z/c.pdf", 3, 10.0)], "path string, rank long, score double")
    bad = spark.createDataFrame([("broken.pdf", "empty")], "file string, error string")
    names = {r.path: r.eval_name for r in files.store_results(d, str(tmp_path / "out"), "Senior Data Engineer", unreadable=bad, seconds=1.234).collect()}
    assert names == {"x/a b.pdf": "sr-data-eng_b_eval", "y/a b.pdf": "sr-data-eng_b_eval-2", "z/c.pdf": "sr-data-eng_c_eval"}
    assert spark.read.json(str(tmp_path / "out/sr-data-eng")).count() == 3
    summary = spark.read.json(str(tmp_path / "out/sr-data-eng_ranking")).first()
    assert summary.generated_seconds == 1.23 and [x.rank for x in summary.shortlist] == [1, 2, 3] and summary.unreadable[0].file == "broken.pdf"
    (tmp_path / "labels.json").write_text('{"grades": {"a b": 4, "c": 0}, "thresholds": {"spearman": 0.8}}')
    grades, limits = files.load_labels(spark, str(tmp_path / "labels.json"))
    assert {(r.name, r.grade) for r in grades.collect()} == {("a b", 4), ("c", 0)} and limits == {"spearman": 0.8}
    m = evaluation.evaluate(d, grades)
    assert m.first().n_labelled == 3 and m.first().separation == 30.0 and m.first().n_inversions == 0
    assert evaluation.verdict(m, limits | {"absent": 1.0}).first().passed
    with pytest.raises(ValueError):
        evaluation.evaluate(d, grades.where("name = 'c'"))
    with pytest.raises(ValueError):
        files.load_ranking(spark, str(tmp_path / "labels.json"))
    assert files.scan(spark, str(tmp_path / "absent")).count() == 0
    up = spark.createDataFrame([(f"{i}.pdf", 10 if i else 20 << 20, i) for i in range(6)] + [("x.exe", 1, 9)], "name string, size int, ord int")
    assert {r.ord: r.error for r in files.accept_uploads(up, most_files=4).collect()} == {0: "too large", 1: None, 2: None, 3: None, 4: "too many files", 5: "too many files", 9: "unsupported type"}
    assert report.new_uploads(up, up.where("ord < 3")).count() == 4


def test_job_text_and_stored_documents(spark, tmp_path):
    (tmp_path / "jd.txt").write_text("Engineer\nPython")
    assert files.read_job(spark, str(tmp_path / "jd.txt")).first().text == "Engineer\nPython"
    assert files.read_job(spark, "Engineer, Python").first().text == "Engineer, Python"
    d = spark.createDataFrame([("a.pdf", "text", True), ("b.pdf", "", False)], "path string, text string, ok boolean")
    files.store_documents(d, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/json")).count() == 2 and spark.read.parquet(str(tmp_path / "out/text")).count() == 1


def test_duplicates_nearest_first(spark):
    long = " ".join(f"word{i}" for i in range(400))
    rows = [(1, long, True), (2, long, True), (3, long.upper() + "!", True), (4, long + " tail", True), (5, "other words are here", True), (6, long, False)]
    got = [tuple(r) for r in dedup.duplicates(spark.createDataFrame(rows, "doc_id long, text string, ok boolean")).collect()]
    assert got[:2] == [(1, 2, 0), (1, 3, 0)] and all(d <= 3 for *_, d in got) and not any(6 in r[:2] or 5 in r[:2] for r in got)


def test_folded_copies_are_read(spark, tmp_path):
    (tmp_path / "x_ranking.json").write_text('{"job": "j", "shortlist": [{"path": "a.pdf", "rank": 1, "score": 50.0}], "duplicates_folded": [{"path": "b.pdf", "score": 50.0, "duplicate_of": "a.pdf"}]}')
    got = {r.path: (r["rank"], r.duplicate_of) for r in files.read_rankings(spark, str(tmp_path), folded=True).collect()}
    assert got == {"a.pdf": (1, None), "b.pdf": (None, "a.pdf")} and files.load_ranking(spark, str(tmp_path)).count() == 1


def test_grades_are_few(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "MOST_GRADES", 3)
    d = spark.range(9).selectExpr("id as name", "double(id) as score", "double(id % 4) as grade")
    with pytest.raises(ValueError):
        evaluation.kendall(d)


def test_embedder_plug(spark):
    d = spark.createDataFrame([("ab",), (None,), ("abcd",)], "t string")
    got = [r.vector for r in vectors.embedded(d, "t", lambda texts: [[float(len(t)), 0.0] for t in texts], batch=2).collect()]
    assert got == [[1.0, 0.0], [0.0, 0.0], [1.0, 0.0]]


DOCUMENT = """<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"><w:body>
<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:rPr><w:sz w:val="28"/></w:rPr><w:t>Jane</w:t><w:tab/><w:t>Roe</w:t></w:r>
<w:r><mc:AlternateContent><mc:Choice><w:txbxContent><w:p><w:r><w:t>Boxed</w:t></w:r></w:p></w:txbxContent></mc:Choice><mc:Fallback><w:txbxContent><w:p><w:r><w:t>Boxed</w:t></w:r></w:p></w:txbxContent></mc:Fallback></mc:AlternateContent></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>"""
RELS = '<Relationships xmlns="x"><Relationship Type="http://y/hyperlink" Target="https://a.b"/><Relationship Type="http://y/hyperlink" Target="https://a.b"/></Relationships>'


def docx():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", DOCUMENT)
        z.writestr("word/_rels/document.xml.rels", RELS)
    return out.getvalue()


def test_docx(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/A.DOCX").write_bytes(docx())
    (tmp_path / "bad.docx").write_bytes(b"PK\x03\x04")
    (tmp_path / "note.txt").write_bytes(b"x")
    found = files.typed(files.scan(spark, str(tmp_path)))
    kinds = {r.path.rsplit("/", 1)[1]: r.format for r in found.collect()}
    assert kinds == {"A.DOCX": "docx", "bad.docx": "unknown"}
    blocks = files.docx_blocks(found).orderBy("path", "ord").collect()
    good = [b for b in blocks if b.error is None]
    assert [b.text for b in good] == ["Jane\tRoe", "Boxed", "a | b", "c"] and good[0].bold and good[0].font_size == 14
    assert good[0].links == ["https://a.b"] and [b.in_table for b in good] == [False, False, True, True]
    assert len([b for b in blocks if b.error]) == 1
    assert files.docx_parts(docx())[1] == [[["a", "b"], ["c", ""]]]


def test_rankings_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("x/b.pdf", 2, 40.0), ("a.pdf", 1, 90.0)], "path string, rank long, score double").withColumn("components", F.expr("array(named_struct('label', 'Mandatory skills', 'earned', score, 'possible', 100D, 'detail', ''))"))
    files.write_ranking(d, str(tmp_path / "out"), "job")
    part = next((tmp_path / "out").glob("*.json"))
    (tmp_path / "j_ranking.json").write_bytes(part.read_bytes())
    rows = report.export_rows(files.read_rankings(spark, str(tmp_path / "j_ranking.json"))).collect()
    assert [(r["rank"], r.file, r.mandatory) for r in rows] == [(1, "a.pdf", 90.0), (2, "b.pdf", 40.0)]


def test_names(spark):
    d = spark.createDataFrame([(1, "a.pdf"), (2, "A.pdf"), (3, "b"), (4, "a.pdf")], "i int, f string")
    assert [r.unique_name for r in files.unique_names(d, "f", "i").orderBy("i").collect()] == ["a.pdf", "A-2.pdf", "b", "a-3.pdf"]
    t = spark.createDataFrame([(1, "x" * 40), (2, "X" * 40), (3, "a/b")], "i int, t string")
    assert [r.title for r in files.sheet_title(t, "t", "i").orderBy("i").collect()] == ["x" * 31, "X" * 29 + "-2", "a-b"]


def test_merge_paragraphs_and_lines(spark):
    rows = [(1, 1, i, 0, t, x, y, x + 100, y + 10, s, False, h) for i, (t, x, y, s, h) in enumerate([("Head", 40.0, 0.0, 14.0, True), ("one", 40.0, 20.0, 10.0, False), ("two", 45.0, 32.0, 10.0, False), ("far", 40.0, 90.0, 10.0, False), ("right", 80.0, 101.0, 10.0, False)])]
    d = spark.createDataFrame(rows, "doc_id int, page int, ord int, col int, text string, x0 double, y0 double, x1 double, y1 double, font_size double, in_table boolean, is_heading boolean")
    assert [r.text for r in layout.merge_paragraphs(d).orderBy("ord").collect()] == ["Head", "one\ntwo", "far", "right"]
    w = spark.createDataFrame([(1, 1, i, t, x, y, x + 10, y + 10) for i, (t, x, y) in enumerate([("a", 0.0, 0.0), ("b", 20.0, 2.0), ("c", 0.0, 20.0)])], "doc_id int, page int, word_id int, text string, x0 double, y0 double, x1 double, y1 double")
    assert [r.line for r in layout.cluster_lines(w).orderBy("word_id").collect()] == [0, 0, 1]


def test_fold_duplicates(spark):
    d = spark.createDataFrame([(1, 90.0), (2, 80.0), (3, 70.0)], "doc_id int, score double")
    reps = spark.createDataFrame([(1, 1), (3, 1)], "doc_id int, rep int")
    got = {r.doc_id: (r.duplicate_of, r.duplicates) for r in dedup.fold_duplicates(d, reps).collect()}
    assert got == {1: (None, [3]), 2: (None, None), 3: (1, None)}


def test_identity(spark):
    got = spark.createDataFrame([("JANE ROE\nData Engineer\na@b.co",), (None,)], "h string").select(report.identity(F.col("h"), F.lit("john_doe.pdf")).alias("i")).collect()
    assert (got[0].i["name"], got[0].i["role"]) == ("Jane Roe", "Data Engineer") and got[1].i["name"] == "John Doe"


def test_windows_as_stream(spark, tmp_path):
    ts = pd.to_datetime(["2024-01-01 00:10", "2024-01-01 00:50", "2024-01-01 01:10", "2024-01-02 05:00"])
    e = spark.createDataFrame(pd.DataFrame({"event_id": [1, 2, 3, 4], "ts": ts, "user_id": [1, 1, 1, 2], "event_type": "a", "value": 1.0}))
    e.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = jobs.tumbling(s, late="1 hour").writeStream.format("memory").queryName("tumbled").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("tumbled").collect()) == [1, 2]
    assert sorted(r.n for r in jobs.sessions(e, 3600).collect()) == [1, 3]


def test_entry_imports_without_the_optional_package():
    import subprocess
    import sys

    code = "import sys; sys.modules['corpuscle.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op')]"
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/tests/", 1)[0]).returncode == 0
