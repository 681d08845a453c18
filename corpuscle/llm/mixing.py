"""Mixing sources to target weights by capped water-filling.

Targets: every source gets its weight's share of all words, at most ``max_epochs`` times its
own words; what a capped source leaves is shared by weight among the others until none is
above its cap. In order of cap/weight this is one pass: the sources before the first one whose
cap lies above the level are capped. Repetitions: a rate r = target/words makes floor(r) whole
repetitions of each document and one more of a seeded part of them: documents stand in the
order of a seeded hash, those before the cut are taken once more, the one at the cut by as
many words as are still missing or, where documents are to stay whole, once more if that is
nearer. The cut is found over hash bins, so that no source meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, staged

BIN = 2_000
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], max_epochs: float = 3.0) -> DataFrame:
    """sizes: (source, source_size). Adds weight (cycling over ``weights`` in code-point order of
    the sources, null last) and target. One row per source, so that the two ordered windows
    read as many rows as there are sources. A source without words has target 0."""
    nth = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(nth, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    every = W.partitionBy(F.lit(1))
    upto = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(every)).withColumn("mass", F.sum("weight").over(every))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / (F.col("mass") - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))))
    # the level that holds: at the first source whose cap is above it; beyond it nothing is capped
    s = s.withColumn("open", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(every))
    target = F.when(F.col("open").isNull() | (F.col("ratio") <= F.col("open.level")), F.col("cap")).otherwise(F.col("weight") * F.col("open.level"))
    return s.select("source", "source_size", "weight", target.alias("target"))


def mix_table(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: float = 3.0, seed: int = 17, whole_documents: bool = False, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, whole (full repetitions), part
    (words of one more), taken = whole*size + part, and ``_k`` (the text's md5).

    Null texts have size 0 and are never taken; a null source is a source of its own. The order
    depends on seed, id and text alone, so reruns agree; rows equal in both are interchangeable.
    Each source's taken words are its target rounded, or with ``whole_documents`` at most half the
    size of one document off; no document is taken more than ``max_epochs`` times. Texts of any
    length are counted whole; other columns are ignored, whatever their names. An empty table
    gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.md5(F.col(text_col)).alias("_k"))
    rows = staged(rows.withColumn("u", F.xxhash64(F.lit(seed), "doc_id", "_k")), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    goal = targets(sizes.select("source", "source_size"), weights, max_epochs).join(sizes.select(F.col("source").alias("_s"), "docs"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    goal = goal.withColumn("goal", F.round("target").cast("long")).withColumn("whole", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("goal") / F.col("source_size")), F.lit(int(max_epochs)))).otherwise(0).cast("long"))
    goal = staged(goal.withColumn("rest", F.col("goal") - F.col("whole") * F.col("source_size")).withColumn("bins", F.ceil(F.col("docs") / BIN).cast("long")), "mix-goal")
    rows = rows.join(goal.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # bins in the order of the hash: its top 31 bits times the number of bins, which stays below 2^32
    rows = rows.withColumn("bin", F.shiftright(F.shiftrightunsigned("u", 33) * F.col("bins"), 31))
    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bins = bins.select(F.col("source").alias("_s"), F.col("bin").alias("_b"), before.alias("ahead"))
    rows = rows.join(bins, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bin") == F.col("_b"))).drop("_s", "_b")
    here = W.partitionBy("source", "bin").orderBy(F.shiftrightunsigned("u", 33), "u", "doc_id", "_k").rowsBetween(W.unboundedPreceding, -1)
    ahead = F.col("ahead") + F.coalesce(F.sum("size").over(here), F.lit(0))
    part = F.greatest(F.least(F.col("size"), F.col("rest") - ahead), F.lit(0))
    if whole_documents:
        part = F.when(2 * part > F.col("size"), F.col("size")).otherwise(F.lit(0).cast("long"))
    return rows.withColumn("part", part).select("doc_id", "source", "size", "source_size", "target", "whole", "part", (F.col("whole") * F.col("size") + F.col("part")).alias("taken"), "_k")


def mix(docs: DataFrame, copy_col: str = "copy_no", **options) -> DataFrame:
    """The mixed corpus: the columns of ``docs`` for every repetition, and ``copy_col`` from 1 (with
    underscores before it if there is such a column already). A repetition in part keeps the
    leading words of the text up to the missing count with the white space before each; with
    ``whole_documents`` all repetitions are whole.

    Other columns are carried along, whatever their names; null texts and texts without words are
    never taken; rows that repeat others are rows of their own. An empty table gives an empty
    result.
    """
    id_col, text_col, source_col = (options.get(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source")))
    plan = mix_table(docs, **options)
    own = {n: fresh(f"_mix_{n}", docs) for n in ("id", "key", "source", "n", "shares", "share", "p_id", "p_key", "p_source")}
    copy_col = fresh(copy_col, docs)
    plan = plan.groupBy(F.col("doc_id").alias(own["p_id"]), F.col("_k").alias(own["p_key"]), F.col("source").alias(own["p_source"])).agg(F.sort_array(F.collect_list(F.struct("whole", "part", "size"))).alias(own["shares"]))
    left = docs.withColumns({own["id"]: F.col(id_col), own["key"]: F.md5(F.col(text_col)), own["source"]: F.col(source_col)})
    # rows equal in id, source and text are interchangeable: the k-th of them takes the k-th share
    left = left.withColumn(own["n"], F.row_number().over(W.partitionBy(own["id"], own["key"], own["source"]).orderBy(F.lit(0))))
    both = left.join(plan, F.col(own["id"]).eqNullSafe(F.col(own["p_id"])) & F.col(own["key"]).eqNullSafe(F.col(own["p_key"])) & F.col(own["source"]).eqNullSafe(F.col(own["p_source"])))
    both = both.withColumn(own["share"], F.get(own["shares"], F.col(own["n"]) - 1))
    share = F.col(own["share"])
    copies = (share["whole"] + (share["part"] > 0).cast("int")).cast("int")
    both = both.where(copies > 0).withColumn(copy_col, F.explode(F.sequence(F.lit(1), copies)))
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(f"[\\x20\\x09-\\x0D]*{WORD}"), F.lit(0)), 1, share["part"].cast("int")), "")
    partial = (F.col(copy_col) > share["whole"]) & (share["part"] < share["size"])
    return both.withColumn(text_col, F.when(partial, cut).otherwise(F.col(text_col))).select(*docs.columns, copy_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_table(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")

