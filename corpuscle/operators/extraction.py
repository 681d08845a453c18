"""From blocks on pages to documents: order, paragraphs, sections, quality, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import quality as Q
from corpuscle.functions.text import strip

from . import dedup, layout
from .ordering import settled


def blocks_to_text(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, text): paragraphs that are not blank, in order, with a blank line between them."""
    t = strip(F.coalesce("text", F.lit("")))
    kept = paragraphs.select("doc_id", "ord", t.alias("t")).where("t != ''")
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "t"))), lambda x: x["t"]), "\n\n").alias("text"))


def method_of(pages: DataFrame) -> DataFrame:
    """pages: (doc_id, method of native, ocr, native+ocr-picked or docx). (doc_id, method): both
    kinds of reading in one document, or in one page, is native+ocr-picked."""
    ocr, native = F.bool_or(F.col("method").isin("ocr", "native+ocr-picked")), F.bool_or(F.col("method").isin("native", "native+ocr-picked"))
    m = F.when(F.bool_or(F.col("method") == "docx"), "docx").when(ocr & native, "native+ocr-picked").when(ocr, "ocr").when(native, "native").otherwise("none")
    return pages.groupBy("doc_id").agg(m.alias("method"))


def usable(error: Column, text: Column) -> Column:
    """No error and a text that is not blank."""
    return error.isNull() & (strip(F.coalesce(text, F.lit(""))) != "")


def extract(blocks: DataFrame, pages: DataFrame, width: float = 595.0, links: DataFrame | None = None, tables: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, sections) of any number of documents.

    blocks: (doc_id, page, block_id, text, x0, y0, x1, y1, font_size, bold). pages: (doc_id, page,
    method, ocr_confidence, error); a document that could not be read has one page row with its
    error and no blocks. documents: doc_id, text, n_blocks, n_pages, n_columns (the most
    of a page), method, q_score, verdict, exact_fingerprint, near_fingerprint, confidence, ok,
    error; links, where given, are added to the text after fingerprints and quality are taken. sections: doc_id, pos, section, body.
    """
    keys = ["doc_id", "page"]
    placed = layout.reading_order(blocks, layout.gutters(blocks, width, keys), keys, width=width)
    placed = layout.in_tables(placed, tables, keys) if tables is not None else placed.withColumn("in_table", F.lit(False))
    first = F.split(F.coalesce("text", F.lit("")), "\n")[0]
    head = layout.heading(first, F.lit(None).cast("double"), F.lit(None).cast("double"), F.col("bold")).isNotNull()
    # one order over the pages of a document
    order = (F.col("page") * 1_000_000 + F.col("ord")).cast("long")
    # what follows reads the paragraphs several times
    merged = settled(layout.merge_paragraphs(placed.select("doc_id", "page", order.alias("ord"), "col", "text", "x0", "y0", "x1", "y1", "font_size", "in_table", head.alias("is_heading"), "bold")))
    sections = layout.sections(merged)
    of = pages.groupBy("doc_id").agg(F.count("page").alias("n_pages"), F.avg("ocr_confidence").alias("mean_ocr"), F.max("error").alias("error"))
    count = merged.groupBy(F.col("doc_id").alias("_n")).agg(F.count("*").alias("n_blocks"), F.when(F.max("col") > 0, 2).otherwise(1).alias("n_columns"))
    text = blocks_to_text(merged).withColumnRenamed("doc_id", "_t")
    d = of.join(count, F.col("doc_id") == F.col("_n"), "left").join(text, F.col("doc_id") == F.col("_t"), "left").drop("_n", "_t")
    d = d.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("n_blocks", F.coalesce("n_blocks", F.lit(0))).withColumn("n_columns", F.coalesce("n_columns", F.lit(0)))
    d = Q.signals(d, pages=F.greatest(F.lit(1), F.col("n_pages")))
    prints = dedup.simhash(d).select(F.col("doc_id").alias("_p"), dedup.hex16(F.col("fp")).alias("near_fingerprint"))
    d = d.join(prints, F.col("doc_id") == F.col("_p")).join(method_of(pages).withColumnRenamed("doc_id", "_m"), F.col("doc_id") == F.col("_m"))
    ok = usable(F.col("error"), F.col("text"))
    sure = F.when(ok, Q.confidence(F.col("q_score"), F.col("mean_ocr"))).otherwise(0.0)
    exact = dedup.exact_fingerprint(F.col("text"))
    out = d.select("doc_id", "text", "n_blocks", "n_pages", "n_columns", "method", "q_score", "verdict", exact.alias("exact_fingerprint"), "near_fingerprint", sure.alias("confidence"), ok.alias("ok"), "error")
    if links is not None:
        named = links.select(F.col("doc_id").alias("_l"), "links")
        tail = F.when(F.size("links") > 0, F.concat(F.lit("\n\n"), F.array_join("links", "\n"))).otherwise("")
        out = out.join(named, F.col("doc_id") == F.col("_l"), "left").withColumn("text", F.concat("text", F.coalesce(tail, F.lit("")))).drop("_l", "links")
    return out, sections
