"""Depth labels: the deterministic rule, model answers, grounding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.text import grounded, json_object, quote_form, skill_key

from .ordering import settled

#: Quotes up to so many characters in all are sent to every task.
QUOTES_BYTES = 16 << 20

DEPTHS = ("none", "mentioned", "used", "strong")
ANSWER = "struct<assessments:array<struct<skill:string,depth:string,evidence:string,section:string,confidence:string>>>"


def rule_depth(section: Column, body: Column) -> Column:
    """Depth that an excerpt naming the skill shows: in experience or projects strong with a
    digit, else used; elsewhere mentioned."""
    return F.when(body.isNull(), "none").when(section.isin("experience", "projects"), F.when(body.rlike("[0-9]"), "strong").otherwise("used")).otherwise("mentioned")


def judge_by_rule(evidence: DataFrame) -> DataFrame:
    """evidence: (doc_id, skill, k, section, chunk). (doc_id, skill, depth): the first excerpt
    that shows the skill in use decides, else one that names it."""
    named = evidence.where(F.lower("chunk").contains(F.lower("skill")))
    d = named.withColumn("depth", rule_depth(F.col("section"), F.col("chunk")))
    shown = d["depth"].isin("used", "strong")
    best = d.groupBy("doc_id", "skill").agg(F.min_by("depth", F.struct((~shown).alias("later"), "k")).alias("depth"))
    return evidence.select("doc_id", "skill").distinct().join(best, ["doc_id", "skill"], "left").fillna("none", ["depth"])


def judge_by_model(prompts: DataFrame, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """prompts: (doc_id, prompt). Adds answer by a pluggable model, called with a batch of prompts.
    A failing call gives null answers, not a failed job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                b["answer"] = model(list(b["prompt"]))
            except Exception:  # the model is not ours: its failure is a row's, not the job's
                b["answer"] = None
            yield b

    return prompts.mapInPandas(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in prompts.schema)}, answer string")


def prompt(role: Column, skills: Column, excerpts: Column) -> Column:
    """skills: array<struct<skill, importance>>; excerpts: array<struct<section, chunk>>."""
    asked = F.transform(skills, lambda s: F.concat(F.lit("- "), s["skill"], F.lit(" ("), s["importance"], F.lit(")")))
    shown = F.transform(excerpts, lambda e: F.concat(F.lit("["), e["section"], F.lit("] "), e["chunk"]))
    return F.concat_ws("\n", F.concat(F.lit("Role: "), role), F.lit("Skills:"), F.array_join(asked, "\n"), F.lit("Excerpts:"), F.array_join(shown, "\n"))


def parse_answers(answers: DataFrame) -> DataFrame:
    """(doc_id, answer) -> (doc_id, idx, skill, depth, evidence, section, confidence, key)."""
    parsed = F.from_json(json_object(F.col("answer")), ANSWER)
    items = answers.select("doc_id", F.posexplode(parsed["assessments"]).alias("idx", "x")).select("doc_id", "idx", "x.*")
    return items.where("skill is not null").withColumn("key", skill_key(F.col("skill")))


def match_answers(skills: DataFrame, answers: DataFrame) -> DataFrame:
    """skills: (doc_id, skill, importance, alternatives, excerpts); answers of ``parse_answers``.

    A skill takes the answer whose key equals the first of its forms that has one: the name, each
    alternative, "A or B", "A/B", "A (or: B)"; of answers with one key the last. Without an
    answer the depth is none. An unknown depth is none; confidence is kept within 0..1; a quote
    that the excerpts lack is marked and its confidence reduced."""
    both = lambda sep: F.when(F.size("alternatives") > 0, F.concat_ws(sep, F.array("skill"), F.col("alternatives")))
    forms = F.array_compact(F.concat(F.array("skill"), F.coalesce("alternatives", F.array().cast("array<string>")), F.array(both(" or "), both("/"))))
    asked = skills.select("doc_id", "skill", F.posexplode(forms).alias("nth", "form")).withColumn("key", skill_key(F.col("form")))
    last = answers.groupBy("doc_id", "key").agg(F.max_by(F.struct("depth", "evidence", "section", "confidence"), "idx").alias("a"))
    chosen = asked.join(last, ["doc_id", "key"]).groupBy("doc_id", "skill").agg(F.min_by("a", "nth").alias("a"))
    out = skills.join(chosen, ["doc_id", "skill"], "left")
    depth = F.lower(F.coalesce(F.col("a.depth"), F.lit("none")))
    depth = F.when(depth.isin(*DEPTHS), depth).otherwise("none")
    quote = F.trim(F.coalesce(F.col("a.evidence"), F.lit("")))
    number = F.col("a.confidence").try_cast("double")
    sure = F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))
    loose = (depth != "none") & ~grounded(quote, F.col("excerpts"))
    reduced = F.when(F.coalesce(sure, F.lit(0.0)) == 0, 0.5).otherwise(sure) * 0.4
    marked = F.when(quote == "", "[unverified]").otherwise(F.concat(F.lit("[unverified] "), quote))
    return out.select("doc_id", "skill", "importance", depth.alias("depth"), F.when(loose, marked).otherwise(quote).alias("evidence"), F.nullif(F.col("a.section"), F.lit("")).alias("section"), F.when(loose, reduced).otherwise(sure).alias("confidence"), F.col("a").isNull().alias("omitted"))


def grounded_pairs(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """docs: (doc_id, text); quotes: (item_id, quote). (doc_id, item_id, whole): which quotes are
    grounded in which documents, and whether as a whole, as ``grounded`` has it.

    A grounded quote's second to fifth words stand in the text as they are (its first may end a
    word, its sixth begin one). Documents meet a quote on the longest of these, which is mostly
    the rarest, and then the rule is applied. Quotes of three to five words meet them on the
    longest word between their first and last; those of one or two, which may stand within words,
    are held against every document; an empty one is grounded in all. Null texts and quotes have
    no pair."""
    b = quotes.select("item_id", quote_form(F.col("quote")).alias("q")).where("q is not null").withColumn("w", F.split("q", " "))
    b = b.withColumn("inner", F.slice("w", F.lit(2), F.greatest(F.least(F.size("w") - 2, F.lit(4)), F.lit(0))))
    seed = F.array_max(F.transform("inner", lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    b = b.withColumn("seed", seed).select("item_id", "q", "seed")
    n = b.agg(F.sum(F.length("q") + 64)).first()[0] or 0
    b = settled(b)
    held = F.broadcast(b) if n <= QUOTES_BYTES else b
    # the form is made once; rows have a number of their own, copies of an id are not one key
    d = settled(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", quote_form(F.col("text")).alias("hay")).where("hay is not null"))
    at = d.select("row", F.explode(F.array_distinct(F.split("hay", " "))).alias("seed")).join(held.where("seed is not null"), "seed").select(F.col("row").alias("_row"), "item_id", "q")
    found = d.join(at, F.col("row") == F.col("_row")).select("doc_id", "item_id", "hay", "q")
    few = b.where("seed is null")
    if not few.isEmpty():
        found = found.unionAll(d.join(F.broadcast(few) if n <= QUOTES_BYTES else few, F.col("hay").contains(F.col("q"))).select("doc_id", "item_id", "hay", "q"))
    part = F.array_join(F.slice(F.split("q", " "), 1, 6), " ")
    holds = F.col("hay").contains(F.col("q"))
    return found.where(holds | ((F.size(F.split("q", " ")) > 3) & F.col("hay").contains(part))).select("doc_id", "item_id", holds.alias("whole"))
