"""One candidate from assessments to a report, and the screening of many as one plan.

assessments: (doc_id, pos, skill, importance, depth, evidence, section, confidence).
requirements: (role_title, min_years), one row a job, joined in by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.text import basename, g, nearest, stem

from corpuscle.streaming.jobs import progress

from . import experience, judge, report, retrieval, scoring
from .ordering import bounded, settled

#: Labels of the score's components.
LABELS = ("Mandatory skills", "Preferred skills", "Years of experience")


def _text(x: Column) -> Column:
    return x.cast("string")


def whole(x: Column) -> Column:
    """A number without decimals, halves to the even neighbour."""
    return nearest(x, 0).cast("long").cast("string")


def two(x: Column) -> Column:
    return nearest(x, 2)


def bucket_detail(n: Column, shown: Column, listed: Column, missing: Column) -> Column:
    said = F.concat(_text(shown), F.lit(" demonstrated, "), _text(listed), F.lit(" listed-only, "), _text(missing), F.lit(" missing of "), _text(n))
    return F.when(n == 0, "no skills in this bucket").otherwise(said)


def experience_detail(years: Column, required: Column, method: Column) -> Column:
    enough = F.concat(g(years), F.lit(" years, meets the "), g(required), F.lit("-year minimum"))
    short = F.concat(g(years), F.lit(" of "), g(required), F.lit(" years required"))
    own = F.when(method == "claimed", " (self-reported, no dated roles to verify against)").otherwise("")
    return F.concat(F.when(years + scoring.TOLERANCE >= required, enough).otherwise(short), own)


def summary(role: Column, score: Column, m_n: Column, m_shown: Column, m_strong: Column, p_n: Column, p_shown: Column, years: Column, required: Column, missing: Column) -> Column:
    """The summary sentence; ``missing``: names of the mandatory skills that are not there. Fixed
    wording."""
    stated = F.coalesce(required, F.lit(0.0)) > 0
    parts = [
        F.concat(scoring.verdict(score), F.when(F.coalesce(role, F.lit("")) != "", F.concat(F.lit(" for "), role)).otherwise(""), F.lit(".")),
        F.when(m_n > 0, F.concat(_text(m_shown), F.lit("/"), _text(m_n), F.lit(" required skills demonstrated"), F.when(m_strong > 0, F.concat(F.lit(" ("), _text(m_strong), F.lit(" strongly)"))).otherwise(""), F.lit("."))),
        F.when(p_n > 0, F.concat(_text(p_shown), F.lit("/"), _text(p_n), F.lit(" preferred demonstrated."))),
        F.when(years.isNotNull() & stated, F.concat(g(years), F.lit(" years experience ("), F.when(years + scoring.TOLERANCE >= required, "meets").otherwise("below"), F.lit(" the "), g(required), F.lit("-year bar)."))).when(years.isNotNull(), F.concat(g(years), F.lit(" years experience."))),
        F.when(F.size(missing) > 0, F.concat(F.lit("Missing: "), F.array_join(missing, ", "), F.lit("."))),
    ]
    return F.array_join(F.array_compact(F.array(*parts)), " ")


def explanation(name: Column, score: Column, components: Column, flags: Column) -> Column:
    """Why this score: a line for it, one for each component, one for the flags."""
    line = lambda c: F.concat(F.lit("  - "), c["label"], F.lit(": "), whole(c["earned"]), F.lit(" of "), whole(c["possible"]), F.when(c["detail"] != "", F.concat(F.lit(" — "), c["detail"])).otherwise(""))
    head = F.concat(F.lit("Score "), whole(score), F.lit("/100 for "), name, F.lit(":"))
    tail = F.when(F.size(flags) > 0, F.concat(F.lit("  flags: "), F.array_join(flags, "; ")))
    return F.array_join(F.array_compact(F.concat(F.array(head), F.transform(components, line), F.array(tail))), "\n")


def score_candidates(assessments: DataFrame, people: DataFrame) -> DataFrame:
    """people: (doc_id, path, extraction_confidence, role_title, min_years, years, method, warnings).
    One row per person: path, score (one decimal), summary, matched_skills, missing_or_weak,
    components, flags, explanation, extraction_confidence, years, method, n_shown, n_strong. Years
    enter with one decimal; people without assessments have no row."""
    b = scoring.buckets(assessments, ["doc_id"])
    x = scoring.explain(assessments, ["doc_id"]).withColumnRenamed("doc_id", "_x")
    p = people.withColumnRenamed("doc_id", "_p").withColumn("years", F.round("years", 1))
    d = b.join(x, F.col("doc_id") == F.col("_x")).join(p, F.col("doc_id") == F.col("_p")).drop("_x", "_p")
    years, required = F.col("years"), F.col("min_years")
    stated = F.coalesce(required, F.lit(0.0)) > 0
    d = scoring.score(d, required, years)
    use = stated & years.isNotNull()
    parts = [
        F.struct(F.lit(LABELS[0]).alias("label"), two(F.col("m_earned")).alias("earned"), two(F.col("m_possible")).alias("possible"), bucket_detail(F.col("m_n"), F.col("m_shown"), F.col("m_listed"), F.col("m_missing")).alias("detail")),
        F.struct(F.lit(LABELS[1]).alias("label"), two(F.col("p_earned")).alias("earned"), two(F.col("p_possible")).alias("possible"), bucket_detail(F.col("p_n"), F.col("p_shown"), F.col("p_listed"), F.col("p_missing")).alias("detail")),
        F.when(use, F.struct(F.lit(LABELS[2]).alias("label"), two(F.col("e_earned")).alias("earned"), F.lit(scoring.EXPERIENCE).alias("possible"), experience_detail(years, required, F.col("method")).alias("detail"))),
    ]
    d = d.withColumn("components", F.array_compact(F.array(*parts)))
    d = d.withColumn("score", nearest(F.aggregate("components", F.lit(0.0), lambda s, c: s + c["earned"]), 1))
    short = use & (years + scoring.TOLERANCE < required)
    weak = F.concat("missing_or_weak", F.when(short, F.array(F.concat(g(years), F.lit(" years experience ("), g(required), F.lit(" required)")))).otherwise(F.array().cast("array<string>")))
    low = F.col("extraction_confidence") < scoring.LOW_EXTRACTION
    skill_flags = lambda start: F.filter("flags", lambda f: f.startswith(start))
    flags = F.concat(
        skill_flags("missing required"),
        F.array_compact(F.array(F.when(stated & years.isNull(), F.concat(F.lit("JD requires "), g(required), F.lit("+ years but no dates could be read from the resume — experience not scored, review manually"))))),
        F.when(years.isNotNull(), F.coalesce("warnings", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")),
        F.array_compact(F.array(F.when(low, F.concat(F.lit("low extraction confidence ("), F.format_number(nearest(F.col("extraction_confidence"), 2), 2), F.lit(") — recommend manual review of the source resume"))))),
        skill_flags("low-confidence"),
    )
    d = d.withColumn("missing_or_weak", weak).withColumn("flags", flags)
    said = summary(F.col("role_title"), F.col("score"), F.col("m_n"), F.col("m_shown"), F.col("m_strong"), F.col("p_n"), F.col("p_shown"), years, required, F.col("missing"))
    d = d.withColumn("summary", said).withColumn("explanation", explanation(basename(F.col("path")), F.col("score"), F.col("components"), F.col("flags")))
    return d.select("doc_id", "path", "score", "summary", F.col("matched").alias("matched_skills"), "missing_or_weak", "components", "flags", "explanation", "extraction_confidence", "years", "method", "n_shown", "n_strong")


def frontend(scored: DataFrame, assessments: DataFrame, sections: DataFrame) -> DataFrame:
    """scored: of ``score_candidates`` with rank. The rows that a user interface shows: id, name,
    currentRole, matchScore, skills, experienceYears, status, summary, strengths, gaps, fileName,
    avatarUrl, email, phone, rank, explanation, flags, extractionConfidence."""
    shown = assessments.where(F.col("depth").isin("used", "strong"))
    strong = shown.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "skill", "evidence"))), 1, 4).alias("a"))
    strong = strong.select(F.col("doc_id").alias("_a"), F.transform("a", lambda x: F.when(F.coalesce(x["evidence"], F.lit("")) != "", F.concat(x["skill"], F.lit(" — "), F.substring(x["evidence"], 1, 110))).otherwise(x["skill"])).alias("strengths"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda x: x["body"]), "\n")
    who = sections.groupBy("doc_id").agg(body.alias("whole"), F.max(F.when(F.col("section") == "header", F.col("body"))).alias("header"))
    who = who.join(report.contacts(who, "whole", "header").withColumnRenamed("doc_id", "_c"), F.col("doc_id") == F.col("_c")).drop("_c", "whole").withColumnRenamed("doc_id", "_w")
    d = scored.join(strong, F.col("doc_id") == F.col("_a"), "left").join(who, F.col("doc_id") == F.col("_w"), "left")
    file = basename(F.col("path"))
    d = d.withColumn("_who", report.identity(F.col("header"), file))
    d = d.withColumn("name", F.when(F.col("_who.name") != "", F.col("_who.name")).otherwise(file))
    nothing = F.array(F.lit("No skill was demonstrated in context; matches are keyword-level only."))
    gaps = F.when(F.size("missing_or_weak") > 0, F.slice("missing_or_weak", 1, 5)).otherwise(F.array(F.lit("No significant gaps identified.")))
    empty = lambda c: F.coalesce(c, F.lit(""))
    return d.select(
        "doc_id", stem(F.col("path")).alias("id"), "name", F.when(empty(F.col("_who.role")) != "", F.col("_who.role")).otherwise("—").alias("currentRole"), nearest(F.col("score"), 0).cast("int").alias("matchScore"),
        F.transform(F.slice("matched_skills", 1, 6), lambda s: F.upper(s)).alias("skills"), F.when(F.col("years").isNotNull(), F.concat(g(F.col("years")), F.lit(" Yrs"))).otherwise("Not stated").alias("experienceYears"), scoring.status(F.col("score")).alias("status"), "summary",
        F.coalesce("strengths", nothing).alias("strengths"), gaps.alias("gaps"), file.alias("fileName"), report.avatar(F.col("name")).alias("avatarUrl"), empty(F.col("email")).alias("email"), empty(F.col("phone")).alias("phone"),
        "rank", "explanation", "flags", nearest(F.col("extraction_confidence"), 3).alias("extractionConfidence"),
    )


def ranking_rows(shown: DataFrame) -> DataFrame:
    """Rows of ``frontend`` back in the form of a ranking: what a download of the view exports."""
    years = F.when(F.col("experienceYears") != "Not stated", F.split("experienceYears", " ")[0].try_cast("double"))
    return shown.select(F.col("fileName").alias("path"), "rank", F.col("matchScore").cast("double").alias("score"), "summary", "explanation", F.col("skills").alias("matched_skills"), F.col("gaps").alias("missing_or_weak"), "flags", F.col("extractionConfidence").alias("extraction_confidence"), years.alias("years"), F.when(years.isNotNull(), "date-ranges").alias("method"))


def assess(sections: DataFrame, skills: DataFrame, top_k: int = 3) -> tuple[DataFrame, DataFrame]:
    """sections: (doc_id, pos, section, body); skills: (pos, skill, importance, q_text), one job's.
    (assessments, evidence): the best chunks per document and skill, and the depth that the rule
    reads from them; every document with sections has every skill."""
    chunks = retrieval.section_chunks(sections)
    fused = retrieval.fuse(chunks, bounded(retrieval.query_terms(skills)), skills)
    best = retrieval.top_chunks(fused, "fused", top_k).join(chunks, ["doc_id", "chunk_id"])
    found = judge.judge_by_rule(best.select("doc_id", "skill", "k", "section", "chunk")).withColumnRenamed("skill", "_s").withColumnRenamed("doc_id", "_d")
    grid = sections.select("doc_id").distinct().crossJoin(bounded(skills.select("pos", "skill", "importance")))  # the table of judgements itself
    a = grid.join(found, (F.col("doc_id") == F.col("_d")) & (F.col("skill") == F.col("_s")), "left").drop("_d", "_s")
    quote = best.where(F.lower("chunk").contains(F.lower("skill"))).groupBy(F.col("doc_id").alias("_d"), F.col("skill").alias("_s")).agg(F.min_by(F.struct("chunk", "section"), "k").alias("q"))
    a = a.join(quote, (F.col("doc_id") == F.col("_d")) & (F.col("skill") == F.col("_s")), "left")
    at = F.expr("locate(lower(skill), lower(q.chunk))")
    near = F.trim(F.expr("substring(q.chunk, greatest(1, locate(lower(skill), lower(q.chunk)) - 30), 40 + least(30, locate(lower(skill), lower(q.chunk)) - 1))"))
    depth = F.coalesce("depth", F.lit("none"))
    return a.select("doc_id", "pos", "skill", "importance", depth.alias("depth"), F.when((depth != "none") & (at > 0), near).otherwise("").alias("evidence"), F.col("q.section").alias("section"), F.lit(0.9).alias("confidence")), best


def screen(documents: DataFrame, sections: DataFrame, skills: DataFrame, today: Column, role: str = "", min_years: float | None = None, top_k: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ranked, assessments, unreadable) of one job over extracted documents (of ``extraction``,
    with path). ValueError if the job has no skills. ranked: of ``score_candidates`` with rank, gap
    and near_tie, the order by score, skills shown and strongly shown, extraction confidence, path.
    unreadable: (file, error) of documents that can't be used; one without text says so."""
    if skills.isEmpty():
        raise ValueError("no requirements could be read from the job description")
    # each is read several times: what they come from is done once
    documents = settled(documents)
    good = documents.where("ok")
    kept = settled(sections.join(good.select(F.col("doc_id").alias("_g")), F.col("doc_id") == F.col("_g"), "left_semi"))
    years = experience.estimate(kept, today)
    assessments = settled(assess(kept, skills, top_k)[0])
    people = good.select(F.col("doc_id").alias("_i"), "path", F.col("confidence").alias("extraction_confidence")).join(years, F.col("_i") == F.col("doc_id"))
    people = people.select("doc_id", "path", "extraction_confidence", F.lit(role).alias("role_title"), F.lit(min_years).cast("double").alias("min_years"), "years", "method", "warnings")
    scored = score_candidates(assessments, people)
    ranked = scoring.rank(scored, ["score", "n_shown", "n_strong", "extraction_confidence"], tie="path")
    near = F.concat(F.lit("within 2 pts of #"), _text(F.col("rank") - 1), F.lit(" ("), whole(F.col("score") + F.col("gap")), F.lit(") — order is close, review both"))
    ranked = ranked.withColumn("flags", F.when(F.col("near_tie"), F.concat("flags", F.array(near))).otherwise(F.col("flags")))
    ranked = ranked.withColumn("explanation", explanation(basename(F.col("path")), F.col("score"), F.col("components"), F.col("flags")))
    bad = documents.where("not ok").select(basename(F.col("path")).alias("file"), F.coalesce("error", F.lit("no readable text")).alias("error"))
    return ranked, assessments, bad


def run_job(job_id: str, ranked: DataFrame, unreadable: DataFrame, total: int) -> DataFrame:
    """One row of a finished job: job_id, total, completed, failed, percent, leader, top_score."""
    done = ranked.agg(F.count("*").alias("completed"), F.max_by("path", F.struct("score", -F.col("rank"))).alias("leader"), F.max("score").alias("top_score"))
    lost = unreadable.agg(F.count("*").alias("failed"))
    d = done.crossJoin(lost)  # one row each
    return d.select(F.lit(job_id).alias("job_id"), F.lit(total).cast("long").alias("total"), "completed", "failed", progress((F.col("completed") + F.col("failed")).cast("double"), F.lit(float(total))).alias("percent"), "leader", "top_score")
