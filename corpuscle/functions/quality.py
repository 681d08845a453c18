"""Quality signals of an extracted text: six penalties, a score and a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import EMAIL, PHONE, URL

#: Substrings that mark a résumé's sections.
HINTS = (
    "experience", "education", "skills", "projects", "summary", "objective",
    "certification", "employment", "work history", "achievements", "profile",
    "internship", "publications", "languages", "awards", "contact",
)
#: Artefacts of a broken font encoding; words; vowels.
GARBAGE = "\\(cid:\\d+\\)|[\\x{FFFD}\\x{E000}-\\x{F8FF}]"
WORD = "[A-Za-z][A-Za-z'\\x{2019}\\-]*"
VOWEL = "[aeiouyAEIOUY]"


def signals(docs: DataFrame, text_col: str = "text", pages: Column | int = 1) -> DataFrame:
    """Adds the measures, the penalties (p_*), q_score and verdict to ``docs``."""
    t = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "^\\s+|\\s+$", "")
    d = docs.withColumn("_t", t).withColumn("_w", F.regexp_extract_all("_t", F.lit(f"({WORD})"), F.lit(1)))
    n = F.size("_w")
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    d = d.withColumns(
        {
            "chars": F.length("_t").cast("long"),
            "non_space": F.length(F.regexp_replace("_t", "\\s", "")).cast("long"),
            "n_words": n.cast("long"),
            "garbage": (F.length("_t") - F.length(F.regexp_replace("_t", GARBAGE, ""))).cast("long"),
            "alpha": F.regexp_count("_t", F.lit("\\p{L}")).cast("long"),
            "singles": F.size(F.filter("_w", lambda w: F.length(w) == 1)).cast("long"),
            "plausible": F.size(F.filter("_w", lambda w: ((F.length(w) <= 2) | w.rlike(VOWEL)) & (F.length(w) <= 22))).cast("long"),
            "hints": sum((F.lower("_t").contains(h).cast("long") for h in HINTS), F.lit(0).cast("long")),
            "contact": F.col("_t").rlike(EMAIL) | F.col("_t").rlike(PHONE) | F.col("_t").rlike(URL),
        }
    )
    per_page = F.col("chars") / (F.greatest(F.lit(1), pages) if isinstance(pages, Column) else max(1, pages))
    many = F.col("n_words") >= 20
    alpha, single, likely = share(F.col("alpha"), F.col("non_space")), share(F.col("singles"), F.col("n_words")), share(F.col("plausible"), F.col("n_words"))
    none = (F.col("hints") == 0) & ~F.col("contact")
    d = d.withColumns(
        {
            "p_density": F.when(per_page < 120, 0.55).when(per_page < 400, 0.25).otherwise(0.0),
            "p_garbage": F.least(F.lit(0.6), share(F.col("garbage"), F.col("chars")) * 6.0),
            "p_alpha": F.when(alpha < 0.45, 0.35).when(alpha < 0.6, 0.12).otherwise(0.0),
            "p_single": F.when(many & (single > 0.4), 0.45).when(many & (single > 0.25), 0.18).otherwise(0.0),
            "p_plausible": F.when(many & (likely < 0.7), 0.4).when(many & (likely < 0.85), 0.15).otherwise(0.0),
            "p_landmarks": F.when(none & (F.col("chars") > 400), 0.2).when(none, 0.08).otherwise(0.0),
        }
    )
    total = F.lit(1.0) - F.col("p_density") - F.col("p_garbage") - F.col("p_alpha") - F.col("p_single") - F.col("p_plausible") - F.col("p_landmarks")
    empty = F.col("chars") == 0
    # six places, so that 1 - 0.55 reaches the limit of 0.45
    d = d.withColumn("q_score", F.when(empty, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 6)))
    return d.withColumn("verdict", verdict(F.col("q_score"), empty)).drop("_t", "_w")


def verdict(score: Column, empty: Column) -> Column:
    return F.when(empty, "empty").when(score >= 0.75, "good").when(score >= 0.45, "suspect").otherwise("bad")


def take_ocr(native: Column, ocr: Column, margin: float = 0.05) -> Column:
    """Is the second reading better by more than the margin?"""
    return ocr > native + margin


def need_ocr(verdict_col: Column, image_only: Column) -> Column:
    """Pages whose native text is empty, bad or suspect are read again."""
    return image_only | verdict_col.isin("empty", "bad", "suspect")


def confidence(quality: Column, mean_ocr: Column) -> Column:
    """Document confidence; OCR confidence (0-100) weighs in if any page was read so."""
    both = F.when(mean_ocr.isNull(), quality).otherwise(0.6 * quality + 0.4 * mean_ocr / 100)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), both)), 3)
