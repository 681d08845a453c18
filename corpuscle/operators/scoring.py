"""Scores from depth labels, and the ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordering import running

#: Weight of each depth; points of each bucket; limits of flags.
DEPTH = {"none": 0.0, "mentioned": 0.4, "used": 0.8, "strong": 1.0}
MANDATORY, PREFERRED, EXPERIENCE = 70.0, 30.0, 15.0
LOW_EXTRACTION, LOW_JUDGEMENT, TOLERANCE = 0.6, 0.45, 0.5


def depth_weight(depth: Column) -> Column:
    out = F.lit(0.0)
    for name, w in DEPTH.items():
        out = F.when(depth == name, w).otherwise(out)
    return out


def status(score: Column) -> Column:
    """Fit bands of the presentation."""
    return F.when(score >= 80, "STRONG MATCH").when(score >= 60, "GOOD MATCH").when(score >= 40, "MODERATE").when(score >= 20, "WEAK MATCH").otherwise("LOW MATCH")


def verdict(score: Column) -> Column:
    """First words of the summary."""
    return F.when(score >= 75, "Strong match").when(score >= 55, "Moderate match").when(score >= 30, "Weak match").otherwise("Poor match")


def experience_credit(years: Column, required: Column, tolerance: float = TOLERANCE) -> Column:
    """Linear up to the requirement, flat beyond, full within the tolerance."""
    return F.when(years + tolerance >= required, 1.0).otherwise(F.greatest(F.lit(0.0), F.coalesce(F.try_divide(years, required), F.lit(1.0))))


def buckets(assessments: DataFrame, keys: list[str]) -> DataFrame:
    """assessments: keys, skill, importance, depth. One row per candidate with the buckets' sums."""
    mand, pref = F.col("importance") == "mandatory", F.col("importance") == "preferred"
    w = depth_weight(F.col("depth"))
    shown = F.col("depth").isin("used", "strong")
    count = lambda c: F.count_if(c).cast("long")
    return assessments.groupBy(*keys).agg(
        F.sum(F.when(mand, w)).alias("m_sum"), count(mand).alias("m_n"), count(mand & shown).alias("m_shown"), count(mand & (F.col("depth") == "mentioned")).alias("m_listed"), count(mand & (F.col("depth") == "none")).alias("m_missing"), count(mand & (F.col("depth") == "strong")).alias("m_strong"),
        F.sum(F.when(pref, w)).alias("p_sum"), count(pref).alias("p_n"), count(pref & shown).alias("p_shown"), count(pref & (F.col("depth") == "mentioned")).alias("p_listed"), count(pref & (F.col("depth") == "none")).alias("p_missing"), count(shown).alias("n_shown"), count(F.col("depth") == "strong").alias("n_strong"),
    )


def score(rows: DataFrame, required: Column | None = None, years: Column | None = None) -> DataFrame:
    """Adds m_earned, p_earned, e_earned and score (not rounded) to the result of ``buckets``.

    The experience bucket exists only if years are required (0 is not) and known; its weight is
    taken from the skills' in proportion. An empty skill bucket's weight goes to the other."""
    required = F.lit(None).cast("double") if required is None else required
    years = F.lit(None).cast("double") if years is None else years
    use = F.coalesce((required > 0) & years.isNotNull(), F.lit(False))
    # multiplied first and divided last: points that end on a half cent must not fall below it
    left = F.when(use, 100.0 - EXPERIENCE).otherwise(100.0)
    m = F.when((F.col("p_n") == 0) & (F.col("m_n") > 0), MANDATORY + PREFERRED).when((F.col("m_n") == 0) & (F.col("p_n") > 0), 0.0).otherwise(MANDATORY)
    p = F.when((F.col("p_n") == 0) & (F.col("m_n") > 0), 0.0).when((F.col("m_n") == 0) & (F.col("p_n") > 0), MANDATORY + PREFERRED).otherwise(PREFERRED)
    part = lambda s, n, w: F.coalesce(F.try_divide(F.col(s), F.col(n)), F.lit(0.0)) * w * left / 100
    e = F.when(use, experience_credit(years, required) * EXPERIENCE).otherwise(0.0)
    out = rows.withColumns({"m_possible": m * left / 100, "p_possible": p * left / 100, "m_earned": part("m_sum", "m_n", m), "p_earned": part("p_sum", "p_n", p), "e_earned": e})
    return out.withColumn("score", F.col("m_earned") + F.col("p_earned") + F.col("e_earned"))


def explain(assessments: DataFrame, keys: list[str]) -> DataFrame:
    """matched, missing_or_weak, missing (mandatory) and the flags of skills, in the order of the
    skills (pos). The flags' wording is fixed."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "skill", "importance", "depth", "confidence")))
    a = assessments.groupBy(*keys).agg(ordered.alias("a"))
    names = lambda keep: F.transform(F.filter("a", keep), lambda x: x["skill"])
    none, mand = (lambda x: x["depth"] == "none"), (lambda x: x["importance"] == "mandatory")
    missing = F.transform(names(none), lambda s: F.concat(s, F.lit(" (missing)")))
    listed = F.transform(names(lambda x: mand(x) & (x["depth"] == "mentioned")), lambda s: F.concat(s, F.lit(" (listed only, not demonstrated)")))
    lost = names(lambda x: mand(x) & none(x))
    unsure = names(lambda x: x["confidence"].isNotNull() & (x["confidence"] < LOW_JUDGEMENT) & ~none(x))
    flag = lambda label, arr: F.when(F.size(arr) > 0, F.concat(F.lit(label), F.array_join(arr, ", ")))
    flags = F.array_compact(F.array(flag("missing required skill(s): ", lost), flag("low-confidence judgement(s): ", unsure)))
    return a.select(*keys, names(lambda x: x["depth"] != "none").alias("matched"), F.concat(missing, listed).alias("missing_or_weak"), lost.alias("missing"), flags.alias("flags"))


def rank(scores: DataFrame, by: list[str], margin: float = 2.0, partition: list[str] | None = None, tie: str = "path") -> DataFrame:
    """Adds rank (columns ``by`` descending, then ``tie``), gap to the one before, and near_tie. A
    rank over the whole table is taken over range partitions, not in one task."""
    order = [*[F.desc(c) for c in by], tie]
    if not partition:
        r = running(scores, order, out="_before", last=by[0])
        r = r.withColumn("rank", F.col("_before") + 1).withColumn("gap", F.col("_last") - F.col(by[0])).drop("_before", "_last")
        return r.withColumn("near_tie", F.coalesce(F.col("gap") < margin, F.lit(False)))
    w = W.partitionBy(*partition).orderBy(*order)
    before = F.lag(by[0]).over(w)
    return scores.withColumn("rank", F.row_number().over(w).cast("long")).withColumn("gap", before - F.col(by[0])).withColumn("near_tie", F.coalesce(F.col("gap") < margin, F.lit(False)))
