"""Chunks, BM25 over postings, hybrid fusion and the best chunks per skill."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from corpuscle.functions import text as T
from corpuscle.functions.vectors import BUCKETS, blocks_of, bucket_counts, hashed

K1, B = 1.5, 0.75
_WORD = re.compile(T.TOKEN)


def line_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk_id, chunk) of the lines of a text that are not blank."""
    lines = F.filter(F.split(F.col(text_col), "\n"), lambda x: F.trim(x) != "")
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(lines).alias("chunk_id", "chunk"))


def section_chunks(sections: DataFrame, most: int = 320, least: int = 80) -> DataFrame:
    """sections: (doc_id, pos, section, body) -> (doc_id, chunk_id, section, chunk), ids in the order of the sections."""
    each = sections.select("doc_id", "pos", "section", F.posexplode(T.chunks(F.col("body"), most, least)).alias("i", "chunk"))
    order = W.partitionBy("doc_id").orderBy("pos", "i")
    return each.select("doc_id", (F.row_number().over(order) - 1).alias("chunk_id"), "section", "chunk")


def query_text(name, aliases, alternatives):
    """Search terms of a skill: alternatives are among the aliases too and count twice."""
    return F.concat_ws(" ", F.array(name), aliases, alternatives)


def parts(df: DataFrame, mb: int = 8) -> int:
    """Partitions of about ``mb`` MB of what ``df`` reads, as its files say; the session's at least."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (mb << 20))), 10_000)


def term_stats(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, term, tf, dl, n_chunks, avg_dl, df) of every term of every chunk. Terms are
    counted by document, chunk and term; a document's chunks are the corpus that df and the mean
    length refer to."""
    # texts move once, by document, into as many parts as keep a part's terms in memory; what follows needs no other order
    own = chunks.select("doc_id", "chunk_id", "chunk").repartition(parts(chunks), "doc_id")
    of = W.partitionBy("doc_id")
    sized = own.select("doc_id", "chunk_id", T.tokens(F.col("chunk")).alias("w")).withColumn("dl", F.size("w"))
    sized = sized.withColumns({"n_chunks": F.count("*").over(of), "avg_dl": F.avg("dl").over(of)})
    tf = sized.select("doc_id", "chunk_id", "dl", "n_chunks", "avg_dl", F.explode("w").alias("term")).groupBy("doc_id", "chunk_id", "dl", "n_chunks", "avg_dl", "term").agg(F.count("*").alias("tf"))
    df = F.count("*").over(W.partitionBy("doc_id", "term"))
    return tf.withColumn("df", df).select("doc_id", "chunk_id", "term", "tf", "dl", "n_chunks", "avg_dl", "df")


def bm25(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """queries: (skill, term, times). (doc_id, chunk_id, skill, bm25) of chunks with a query term.

    Only query terms are exploded into postings; a chunk's length is that of all its tokens."""
    words = T.tokens(F.col("chunk"))
    sized = chunks.select("doc_id", "chunk_id", words.alias("w")).withColumn("dl", F.size("w"))
    doc = sized.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.avg("dl").alias("avg_dl"))
    wanted = queries.select("term").distinct()
    tf = sized.select("doc_id", "chunk_id", "dl", F.explode("w").alias("term")).join(wanted, "term", "left_semi").groupBy("doc_id", "chunk_id", "dl", "term").agg(F.count("*").alias("tf"))
    postings = tf.withColumn("df", F.count("*").over(W.partitionBy("doc_id", "term"))).join(doc, "doc_id")
    idf = F.log(1 + (F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("times") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    return postings.join(queries, "term").groupBy("doc_id", "chunk_id", "skill").agg(F.sum(part).alias("bm25"))


def minmax(col: str, *keys: str):
    """Scaled to 0..1 within the keys; all 0 if all are equal."""
    w = W.partitionBy(*keys)
    lo, hi = F.min(col).over(w), F.max(col).over(w)
    return F.when(hi > lo, (F.col(col) - lo) / (hi - lo)).otherwise(0.0)


def _scores(texts: list[str], doc: np.ndarray, chunk: np.ndarray, terms: dict[str, int], times: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bm25, semantic) of each chunk with each skill, for whole documents in a row, their chunks
    in order. times: terms by skills; vectors: buckets by skills. What shares document and number
    is one chunk to both scores."""
    new = np.append(True, (doc[1:] != doc[:-1]) | (chunk[1:] != chunk[:-1])) if len(doc) else np.zeros(0, bool)
    unit, first = np.cumsum(new) - 1, np.flatnonzero(new)
    n = np.add.reduceat(bucket_counts(texts), first)
    norm = np.sqrt((n * n).sum(1).astype(float))
    unit_n = n / np.where(norm == 0, 1.0, norm)[:, None]
    semantic = np.zeros((len(first), times.shape[1]))
    for b in np.flatnonzero(vectors.any(1)):
        semantic += unit_n[:, b, None] * vectors[b]
    size, hits = np.empty(len(texts), np.int64), []
    for i, t in enumerate(texts):
        words = _WORD.findall(t)
        size[i] = len(words)
        hits += [(unit[i], size[i], terms[w], doc[i]) for w in words if w in terms]
    bm = np.zeros((len(first), times.shape[1]))
    if hits:
        found, tf = np.unique(np.array(hits, np.int64), axis=0, return_counts=True)
        u, dl, term, d = found.T
        n_chunks = np.bincount(doc)
        mean = np.bincount(doc, size) / np.maximum(n_chunks, 1)
        place = d * len(terms) + term
        df = np.bincount(place)[place]
        idf = np.array([math.log(1 + x) for x in (n_chunks[d] - df + 0.5) / (df + 0.5)])
        for s in range(times.shape[1]):
            of = times[term, s]
            bm[:, s] = np.bincount(u, of * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean[d])), len(first))
    return bm[unit], semantic[unit]


def fuse(chunks: DataFrame, queries: DataFrame, skills: DataFrame, w_bm25: float = 0.5, w_semantic: float = 0.5) -> DataFrame:
    """skills: (skill, q_text), one job's. Every chunk with every skill of its document: bm25,
    semantic (cosine of hashed vectors) and their fusion. The grid of skills and chunks is what is
    asked for: each skill scales over all chunks of the document.

    A document's chunks are brought together once and scored there, so that neither postings nor
    features are rows of a table."""
    names = [r["skill"] for r in skills.select("skill").collect()]  # the job's list
    of = {s: i for i, s in enumerate(dict.fromkeys(names))}
    asked = queries.select("skill", "term", "times").where(F.col("skill").isin(*of)).collect()
    terms = {t: i for i, t in enumerate(sorted({r["term"] for r in asked}))}
    times, vectors = np.zeros((len(terms), len(of))), np.zeros((BUCKETS, len(of)))
    for r in asked:
        times[terms[r["term"]], of[r["skill"]]] += r["times"]
    for r in hashed(skills, "q_text", "skill").where(F.col("skill").isin(*of)).collect():
        vectors[r["bucket"], of[r["skill"]]] = r["w"]
    at = [of[s] for s in names]
    kinds = {f.name: f.dataType for f in chunks.schema}
    docs = chunks.select("doc_id", F.struct("chunk_id", F.lower("chunk").alias("chunk")).alias("c")).groupBy("doc_id").agg(F.sort_array(F.collect_list("c")).alias("c"))

    def scaled(x: np.ndarray, doc: np.ndarray, first: np.ndarray) -> np.ndarray:
        lo, hi = np.minimum.reduceat(x, first)[doc], np.maximum.reduceat(x, first)[doc]
        return np.where(hi > lo, (x - lo) / np.where(hi > lo, hi - lo, 1.0), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            sizes = [sum(map(len, pc.struct_field(x.values, "chunk").to_pylist())) for x in lists]
            for lo, hi in blocks_of(sizes, 1 << 20, 1024):
                held = lists.slice(lo, hi - lo)
                long = np.asarray(pc.list_value_length(held))
                flat = held.flatten()
                doc = np.repeat(np.arange(hi - lo), long)
                number, texts = pc.struct_field(flat, "chunk_id"), pc.struct_field(flat, "chunk").to_pylist()
                bm, semantic = _scores(texts, doc, np.asarray(number), terms, times, vectors)
                first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                fused = w_bm25 * scaled(bm, doc, first) + w_semantic * scaled(semantic, doc, first)
                rows = np.repeat(np.arange(len(doc)), len(names))
                cols = [ids.slice(lo, hi - lo).take(pa.array(doc[rows])), number.take(pa.array(rows)), pa.array(names * len(doc), pa.string())]
                yield pa.RecordBatch.from_arrays([*cols, *[pa.array(x[:, at].ravel()) for x in (bm, semantic, fused)]], names=["doc_id", "chunk_id", "skill", "bm25", "semantic", "fused"])

    out = StructType([StructField("doc_id", kinds["doc_id"]), StructField("chunk_id", kinds["chunk_id"]), StructField("skill", StringType()), *[StructField(c, DoubleType()) for c in ("bm25", "semantic", "fused")]])
    return docs.mapInArrow(run, out)


def top_chunks(scored: DataFrame, score: str, k: int = 3, least: float = 0.0) -> DataFrame:
    """The k best chunks per document and skill, then those above ``least``. Ties by chunk."""
    w = W.partitionBy("doc_id", "skill").orderBy(F.desc(score), "chunk_id")
    return scored.withColumn("k", F.row_number().over(w)).where(F.col("k") <= k).where(F.col(score) > least)


def query_terms(skills: DataFrame) -> DataFrame:
    """(skill, q_text) -> (skill, term, times)."""
    return skills.select("skill", F.explode(T.tokens(F.col("q_text"))).alias("term")).groupBy("skill", "term").agg(F.count("*").alias("times"))
