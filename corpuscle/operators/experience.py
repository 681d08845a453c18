"""Years of experience from dated ranges and claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscle.functions.text import g

#: The forms of months, separators, the present and years, and of claims.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*"
_YEAR = r"(?:19[7-9]\d|20[0-4]\d)"
_SEP = r"\s*(?:-|–|—|~|to|until|through)\s*"
_NOW = r"(?:present|current(?:ly)?|now|ongoing|to\s*date|date)"
RANGE = rf"(?i)({_MONTH}|\d{{1,2}})?[\s./,-]*({_YEAR}){_SEP}(?:({_NOW})|(?:({_MONTH}|\d{{1,2}})?[\s./,-]*({_YEAR})))"
CLAIM = r"(?i)(\d{1,2}(?:\.\d)?)\s*\+?\s*(?:years?|yrs?)\b(?![^.]*\bold\b)"
SECTIONS = ("experience", "projects")


def month_number(token: Column) -> Column:
    """1-12 of a month's name or number; null of anything else."""
    number = F.when(token.rlike("^\\d+$"), token.try_cast("int"))
    out = F.when(number.between(1, 12), number)
    for i, m in enumerate(MONTHS):
        out = F.when(F.lower(token).startswith(m), i + 1).otherwise(out)
    return out


def date_ranges(text: Column, today: Column) -> Column:
    """array<struct<start, end, is_current, raw>> of months (year * 12 + month) in a text.

    A range without start month begins in January, one without end month ends in December;
    reversed ranges and such that end after next month are dropped. ``today`` is a date."""
    now = F.year(today) * 12 + F.month(today)
    group = lambda i: F.regexp_extract_all(text, F.lit(RANGE), F.lit(i))
    zipped = F.arrays_zip(*[group(i).alias(n) for i, n in enumerate(("raw", "sm", "sy", "p", "em", "ey"))])
    month = lambda c, otherwise: F.coalesce(month_number(c), F.lit(otherwise))

    def one(x: Column) -> Column:
        current = x["p"] != ""
        start = x["sy"].cast("int") * 12 + month(x["sm"], 1)
        end = F.when(current, now).otherwise(x["ey"].try_cast("int") * 12 + month(x["em"], 12))
        return F.struct(start.alias("start"), end.alias("end"), current.alias("is_current"), F.trim(x["raw"]).alias("raw"))

    return F.filter(F.transform(zipped, one), lambda r: (r["end"] >= r["start"]) & (r["end"] <= now + 1))


def claims(text: Column) -> Column:
    """Greatest number of years that a text claims; null without one."""
    return F.array_max(F.transform(F.regexp_extract_all(text, F.lit(CLAIM), F.lit(1)), lambda x: x.cast("double")))


def union_months(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """keys, months, n_islands: length of the union of intervals per key; touching ones join."""
    w = W.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    s = spans.withColumn("_new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    s = s.withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    islands = s.groupBy(*keys, "_island").agg(F.min(start).alias("_a"), F.max(end).alias("_b"))
    return islands.groupBy(*keys).agg(F.sum(F.col("_b") - F.col("_a")).cast("long").alias("months"), F.count("*").alias("n_islands"))


def estimate(sections: DataFrame, today: Column) -> DataFrame:
    """sections: (doc_id, section, body). One row per document: months, years (not rounded; null
    if nothing was found), method, claimed_years, evidence (the first 6 ranges: experience before
    projects, in the order of the text), warnings (their wording is fixed)."""
    part = sections.where(F.col("section").isin(*SECTIONS)).select("doc_id", (F.col("section") != SECTIONS[0]).alias("_later"), F.posexplode(date_ranges(F.col("body"), today)).alias("_place", "_r"))
    scanned = part.select("doc_id", "_later", "_place", "_r.*")
    months = union_months(scanned, ["doc_id"])
    # in the order of the sections and of the text
    first = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("_later", "_place", "start", "end", "raw"))), 1, 6), lambda x: x["raw"])
    raws = scanned.groupBy("doc_id").agg(first.alias("evidence"))
    claimed = sections.groupBy("doc_id").agg(F.max(claims(F.col("body"))).alias("claimed_years"))
    out = claimed.join(months, "doc_id", "left").join(raws, "doc_id", "left")
    dated = F.col("months") / 12.0
    years = F.coalesce(dated, F.col("claimed_years"))
    method = F.when(F.col("months").isNotNull(), "date-ranges").when(F.col("claimed_years").isNotNull(), "claimed").otherwise("none")
    notes = F.array_compact(F.array(
        F.when(F.col("claimed_years") - F.round(dated, 1) >= 2.0, F.concat(F.lit("resume claims "), g(F.col("claimed_years")), F.lit(" years but dated roles total "), g(F.round(dated, 1)), F.lit(" — verify manually"))),
        F.when(F.col("months").isNull() & F.col("claimed_years").isNotNull(), F.concat(F.lit("no dated roles found — using the resume's own claim of "), g(F.col("claimed_years")), F.lit(" years, which is unverified"))),
        F.when(years.isNull(), F.lit("no dates or stated experience found — years could not be determined")),
        F.when(years > 50, F.concat(F.lit("implausible total ("), g(F.round(years, 1)), F.lit(" years) — likely a misparsed date"))),
    ))
    return out.select("doc_id", "months", years.alias("years"), method.alias("method"), "claimed_years", "evidence", notes.alias("warnings"))
