import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from corpuscle.functions import quality as Q
from corpuscle.functions import text as T
from corpuscle.operators import dedup, experience


def today():
    return F.lit(date(2026, 7, 1))


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "months"),
    [("Engineer 2021 - 2024", 47), ("Jan 2019 – Mar 2022", 38), ("Engineer 03/2018 - 11/2021", 44), ("Analyst 2015 to 2019", 59), ("Intern 2017—2018", 23), ("2030 - 2035", None), ("2024 - 2019", None), ("B.Tech, NIT Trichy, 2018", None), ("", None)],
)
def test_date_ranges(spark, text, months):
    got = one(spark, experience.date_ranges(F.col("t"), today()), t=text)
    assert [r["end"] - r["start"] for r in got] == ([] if months is None else [months])


def test_experience_sections(spark):
    rows = [
        (1, "experience", "A 2019 - 2023\nB 2021 - 2023"), (2, "experience", "2015 - 2016, 2022 - 2023"), (3, "education", "2014 - 2018"), (3, "experience", "2022 - 2023"),
        (4, "summary", "7+ years of experience"), (5, "summary", "30 years old"), (6, "experience", "Sep 2025 - Present"), (7, "summary", None),
    ]
    got = {r.doc_id: r for r in experience.estimate(spark.createDataFrame(rows, "doc_id int, section string, body string"), today()).collect()}
    assert [None if got[i].years is None else round(got[i].years, 1) for i in range(1, 8)] == [4.9, 3.8, 1.9, 7.0, None, 0.8, None]
    assert got[4].method == "claimed" and got[5].method == "none" and got[7].warnings == ["no dates or stated experience found — years could not be determined"]


def plain_chunks(body, most=320, least=80):
    merged = []
    for p in (x.strip() for x in re.split(r"\n\s*\n", body)):
        if not p:
            continue
        if merged and len(merged[-1]) < least:
            merged[-1] += "\n" + p
        else:
            merged.append(p)
    out = []
    for p in merged:
        if len(p) <= most:
            out.append(p)
            continue
        have = []
        for s in re.split(r"(?<=[.!?])\s+", p):
            if have and len(have[-1]) + 1 + len(s) <= most:
                have[-1] += " " + s
            elif s:
                have.append(s)
        out += have
    return out


def test_chunks(spark):
    for body in ("", "one\n\ntwo", "short\n \n" + "x" * 100 + "\n\nlast", "A sentence here. " * 60, "y" * 900, "Line.\nOther! Third? " * 30 + "\n\nEnd."):
        assert one(spark, T.chunks(F.col("t")), t=body) == plain_chunks(body)


def test_text(spark):
    assert one(spark, T.tokens(F.col("t")), t="C++ and Node.js on k8s.") == ["c++", "and", "node.js", "on", "k8s."]
    assert one(spark, T.skill_key(F.col("t")), t="PyTorch (or: TensorFlow)") == "pytorch"
    assert one(spark, T.slug(F.col("t")), t="Senior Software Engineer, Data Platform (Remote)") == "sr-sw-eng-data"
    assert one(spark, T.slug(F.col("t")), t="the") == "the" and one(spark, T.slug(F.col("t")), t="!") == "untitled"
    assert one(spark, T.stem(F.col("t")), t="a\\b/x.y.pdf") == "x.y"
    assert one(spark, T.json_object(F.col("t")), t='```json\nsee {"a": {"b": 1}} ok\n```') == '{"a": {"b": 1}}'
    assert one(spark, T.json_object(F.col("t")), t="none") is None
    hay = "Led the migration of nine services to Kubernetes in 2021."
    for quote, want in (("", True), ("nine services", True), ("Led the migration of nine services and more", True), ("ten services", False), ("migration of nine lives", False)):
        assert one(spark, T.grounded(F.col("q"), F.col("h")), q=quote, h=hay) is want


def test_ends_are_stripped_whole(spark):
    """Blanks of any kind go, and nothing but blanks, at whatever place in a list."""
    padded = "  00 padded head 0 \nnext"
    assert one(spark, T.first_line(F.col("t")), t=padded) == "00 padded head 0"
    assert one(spark, T.first_line(F.col("t")), t="\n \t\n\u2003 1st Engineer 1\u00a0\r\nx") == "1st Engineer 1"
    assert one(spark, T.strip(F.col("t")), t="\x1f\u0085 a b \u2028") == "a b"
    body = "  first para 0  \n\n\t1 second 1 " + "x" * 90 + "\n\n  2 third 2\t"
    assert one(spark, T.chunks(F.col("t")), t=body) == plain_chunks(body)
    for x, want in ((5.0, "5"), (2.5, "2.5"), (0.0, "0"), (100.0, "100"), (1234.5, "1234.5"), (0.1, "0.1")):
        assert spark.range(1).select(T.g(F.lit(x)).alias("g")).first().g == want


def test_quality(spark):
    good = "Experience: " + "We built reliable systems for many people every day. " * 20
    spaced = "S O F T W A R E E N G I N E E R W O R K " * 12
    d = spark.createDataFrame([(1, good), (2, spaced), (3, "  "), (4, None), (5, "(cid:1)(cid:2) short")], "doc_id int, text string")
    got = {r.doc_id: r for r in Q.signals(d).collect()}
    assert got[1].verdict == "good" and got[3].verdict == got[4].verdict == "empty" and got[3].q_score == 0
    assert got[2].p_single == 0.45 and got[2].verdict == "bad" and got[5].verdict == "bad"


def test_fingerprints(spark):
    d = spark.createDataFrame([(1, "Hello,  World!"), (2, "hello world"), (3, ""), (4, None), (5, "other words here now")], "doc_id int, text string")
    fp = {r.doc_id: r.fp for r in dedup.simhash(d).collect()}
    assert fp[1] == fp[2] != fp[5] and fp[3] == fp[4] == 0
    x = d.select("doc_id", dedup.exact_fingerprint(F.col("text")).alias("f")).collect()
    assert x[0].f == x[1].f and len(x[0].f) == 32
    assert one(spark, dedup.hamming(F.col("a"), F.col("b")), a="00ff", b="00fe") == 1
    assert one(spark, dedup.hamming(F.col("a"), F.col("b")), a="zz", b="00fe") == 64


def test_near_pairs_are_complete(spark):
    import itertools
    import random

    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(20)]
    values = list({b ^ sum(1 << i for i in rng.sample(range(64), k)) for b in base for k in (0, 1, 2, 3, 4) for _ in range(4)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    d = spark.createDataFrame(list(enumerate(signed)) + [(10_000, signed[0])], "doc_id long, fp long")
    got = {(r.a, r.b, r.d) for r in dedup.near_pairs(d).collect()}
    want = {(i, j, n) for i, j in itertools.combinations(range(len(values)), 2) if (n := (values[i] ^ values[j]).bit_count()) <= 3}
    assert got == want
    labels = {r.doc_id: r.rep for r in dedup.classes(dedup.near_pairs(d), d.select("doc_id").where("doc_id < 10000")).collect()}
    for a, b, _ in want:
        assert labels[a] == labels[b]
