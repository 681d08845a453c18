"""What is shown: summaries, bands, identity lines, export rows, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import text as T

#: Lower limits of the histogram's bands.
HISTOGRAM = ((90, "90-100%"), (80, "80-89%"), (70, "70-79%"))


def summarise(ranked: DataFrame, name: str = "name", score: str = "score") -> DataFrame:
    """One row: number, top score, mean (unrounded), the leader, and the four bands' counts."""
    s = F.round(score)
    bands = {"n_90": s >= 90, "n_80": (s >= 80) & (s < 90), "n_70": (s >= 70) & (s < 80), "n_low": s < 70}
    counts = [F.count_if(c).cast("long").alias(n) for n, c in bands.items()]
    return ranked.agg(F.count("*").alias("total"), F.coalesce(F.max(s), F.lit(0.0)).alias("top"), F.coalesce(F.avg(s), F.lit(0.0)).alias("mean"), F.min_by(name, "rank").alias("leader"), *counts)


def workbook_summary(rows: DataFrame, by: str, score: str, name: str, duplicate: Column) -> DataFrame:
    """Per job: candidates, duplicates, top, median, how many reach 70, how many have 0, the best."""
    own = ~duplicate
    s = F.when(own, F.col(score))
    return rows.groupBy(by).agg(F.count_if(own).alias("candidates"), F.count_if(duplicate).alias("duplicates"), F.max(s).alias("top"), F.median(s).alias("median_score"), F.count_if(s >= 70).alias("n_70"), F.count_if(s == 0).alias("n_zero"), F.max_by(F.when(own, F.col(name)), F.when(own, F.struct(F.col(score), F.col(name)))).alias("best"))


def export_rows(rankings: DataFrame) -> DataFrame:
    """Rows of ``read_rankings`` with a column for each component's points; ranks first, nulls last."""
    part = lambda label: F.get(F.filter("components", lambda c: c["label"] == label), F.lit(0))
    cols = [F.col("job"), F.col("rank"), T.basename(F.col("path")).alias("file"), F.col("score")]
    for label, out in (("Mandatory skills", "mandatory"), ("Preferred skills", "preferred"), ("Years of experience", "experience")):
        cols += [part(label)["earned"].alias(out), part(label)["possible"].alias(f"{out}_of")]
    cols += [F.array_join("matched_skills", ", ").alias("matched"), F.array_join("missing_or_weak", ", ").alias("missing"), F.array_join("flags", "; ").alias("flags"), F.col("summary")]
    return rankings.select(*cols).orderBy("job", F.asc_nulls_last("rank"))


def top_printed(ranked: DataFrame, n: int) -> DataFrame:
    """The first n; rows without a rank (folded copies) are always kept."""
    return ranked.where((F.col("rank") <= n) | F.col("rank").isNull())


#: Fixed value: a phone number in the header.
HEADER_PHONE = r"(?:\+\d{1,3}[\s-]?)?\d{5}[\s-]?\d{5}|\d{3}[\s-]?\d{3}[\s-]?\d{4}"


def contacts(docs: DataFrame, text_col: str = "text", header_col: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, email, phone): the first e-mail address of the whole text, the first phone number of
    the header (the text if there is none); empty without one, and for a null text."""
    whole, header = (F.coalesce(F.col(c), F.lit("")) for c in (text_col, header_col or text_col))
    return docs.select(F.col(id_col).alias("doc_id"), F.regexp_extract(whole, T.EMAIL, 0).alias("email"), T.strip(F.regexp_extract(header, HEADER_PHONE, 0)).alias("phone"))


def identity(header: Column, fallback: Column) -> Column:
    """struct<name, role> from the first three lines that are no contact lines: a short, mostly
    alphabetic line of two to five words is the name, the next one the role; else the file name."""
    lines = F.slice(F.filter(F.transform(F.split(F.coalesce(header, F.lit("")), "\n"), lambda x: T.strip(x)), lambda x: x != ""), 1, 3)
    lines = F.filter(lines, lambda x: ~(x.rlike(T.EMAIL) | (x.contains("|") & x.rlike("\\d"))))
    words = lambda x: F.size(F.split(x, "\\s+"))
    is_name = lambda x: words(x).between(2, 5) & (F.length(F.regexp_replace(x, "[^\\p{L}\\s]", "")) / F.length(x) > 0.85)
    start = F.struct(F.lit("").alias("name"), F.lit("").alias("role"))

    def step(acc: Column, x: Column) -> Column:
        name = F.when((F.upper(x) == x) & (F.lower(x) != x), F.initcap(F.lower(x))).otherwise(x)
        take_name = (acc["name"] == "") & is_name(x)
        take_role = (acc["name"] != "") & (acc["role"] == "") & (F.length(x) < 80)
        return F.struct(F.when(take_name, name).otherwise(acc["name"]).alias("name"), F.when(take_role, x).otherwise(acc["role"]).alias("role"))

    found = F.aggregate(lines, start, step)
    plain = F.initcap(F.trim(F.regexp_replace(F.regexp_replace(fallback, "[_-]+", " "), "\\.(pdf|docx)$", "")))
    return F.struct(F.when(found["name"] != "", found["name"]).otherwise(plain).alias("name"), found["role"].alias("role"))


def hue(name: Column) -> Column:
    """Colour of a name's avatar: its characters' code points, summed, modulo 360."""
    # four bytes a code point, big-endian
    points = F.hex(F.encode(name, "UTF-32"))
    each = F.transform(F.regexp_extract_all(points, F.lit("[0-9A-F]{8}"), F.lit(0)), lambda h: F.conv(h, 16, 10).cast("long"))
    return (F.aggregate(each, F.lit(0).cast("long"), lambda s, c: s + c) % 360).cast("int")


def avatar(name: Column) -> Column:
    """An image of the initials as a data URI, so that no picture is fetched from anywhere."""
    #: fixed value: the image's form
    form = '<svg xmlns="http://www.w3.org/2000/svg" width="96" height="96"><rect width="96" height="96" rx="48" fill="hsl(%d,45%%,32%%)"/><text x="48" y="62" font-family="Arial,sans-serif" font-size="36" font-weight="600" fill="#e2e8f0" text-anchor="middle">%s</text></svg>'
    svg = F.format_string(form, hue(name), initials(name))
    return F.concat(F.lit("data:image/svg+xml;base64,"), F.regexp_replace(F.base64(F.encode(svg, "UTF-8")), "[\r\n]", ""))


def initials(name: Column) -> Column:
    words = F.slice(F.filter(F.split(name, "\\s+"), lambda w: w != ""), 1, 2)
    out = F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))
    return F.when(out == "", "?").otherwise(out)


def ui_filter(rows: DataFrame, needle: str = "", status: str = "ALL") -> DataFrame:
    """rows: (name, role, skills, status). Substring of name, role or a skill, and the status."""
    n = needle.lower()
    hit = F.lower("name").contains(n) | F.lower("role").contains(n) | F.exists("skills", lambda s: F.lower(s).contains(n))
    return rows.where(hit & (F.lit(True) if status == "ALL" else F.col("status") == status))


def skill_line(skills: Column) -> Column:
    """skills: array<struct<name, alternatives>>: "A or B, C"; nameless ones are left out."""
    one = F.transform(skills, lambda s: F.array_join(F.concat(F.array(F.coalesce(s["name"], F.lit(""))), F.coalesce(s["alternatives"], F.array().cast("array<string>"))), " or "))
    return F.array_join(F.filter(one, lambda x: x != ""), ", ")


#: The columns of an exported sheet.
SHEET = ("Resume", "JD", "Score", "Rank", "Matched Skills", "Missing Skills", "Mandatory Skills", "Preferred Skills", "Assessment", "Explanation", "Summary", "Experience", "Flags", "Extraction Conf.")


def sheet_rows(ranked: DataFrame, assessments: DataFrame, role: Column) -> DataFrame:
    """ranked: of ``candidates.score_candidates`` with rank (null for folded copies). SHEET, in the
    order of the ranks, those without one last."""
    part = lambda label: F.get(F.filter("components", lambda c: c["label"] == label), F.lit(0))
    tenth = lambda x: F.format_string("%.1f", T.nearest(x, 1))
    bucket = lambda label: F.coalesce(F.concat(tenth(part(label)["earned"]), F.lit(" / "), tenth(part(label)["possible"]), F.lit("\n"), part(label)["detail"]), F.lit(""))
    said = F.concat(F.col("skill"), F.lit(" — "), F.col("depth"), F.when(F.coalesce("evidence", F.lit("")) != "", F.concat(F.lit(': "'), F.substring("evidence", 1, 90), F.lit('"'))).otherwise(""))
    a = assessments.groupBy(F.col("doc_id").alias("_a")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", said.alias("t")))), lambda x: x["t"]), "\n").alias("assessment"))
    years = F.coalesce(F.concat(T.g(F.col("years")), F.lit(" yrs ("), F.coalesce("method", F.lit("")), F.lit(")")), F.lit(""))
    cols = [T.basename(F.col("path")), role, F.col("score"), F.col("rank"), F.array_join("matched_skills", ", "), F.array_join("missing_or_weak", ", "), bucket("Mandatory skills"), bucket("Preferred skills"), F.coalesce("assessment", F.lit("")), F.col("explanation"), F.col("summary"), years, F.array_join("flags", "\n"), F.col("extraction_confidence")]
    rows = ranked.join(a, F.col("doc_id") == F.col("_a"), "left")
    return rows.select(*[c.alias(n) for c, n in zip(cols, SHEET)]).orderBy(F.asc_nulls_last("Rank"))


def throughput(done: Column, seconds: Column) -> Column:
    """Files a minute, at least one second counted."""
    return F.round(done * 60 / F.greatest(seconds, F.lit(1.0)), 0).cast("int")


def new_uploads(chosen: DataFrame, there: DataFrame) -> DataFrame:
    """(name, size) of ``chosen`` that ``there`` lacks; a file is told by name and size."""
    return chosen.join(there.select("name", "size").distinct(), ["name", "size"], "left_anti")
