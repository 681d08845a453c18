"""Vectors as arrays of doubles, and the feature-hashing embedder."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .text import TOKEN


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Length one; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: x / F.when(n == 0, 1.0).otherwise(n))


#: Buckets of feature hashing, and how many words' buckets a worker keeps.
BUCKETS, KEPT_WORDS = 256, 1 << 17
_WORD = re.compile(TOKEN)
_words: dict[str, int] = {}
#: Bucket of three ASCII characters, 7 bits each; -1 where none was asked for yet.
_grams = np.full(1 << 21, -1, np.int16)


def _bucket(feature: str) -> int:
    return hashlib.md5(feature.encode("utf-8", "surrogatepass")).digest()[-1]


def _gram_buckets(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Buckets of trigrams given by their code points."""
    out = np.empty(len(a), np.int64)
    plain = (a | b | c) < 128
    at = (a << 14 | b << 7 | c)[plain]
    found = _grams[at]
    if (found < 0).any():
        for x in np.unique(at[found < 0]).tolist():
            _grams[x] = _bucket(chr(x >> 14) + chr(x >> 7 & 127) + chr(x & 127))
        found = _grams[at]
    out[plain] = found
    if not plain.all():
        keys, nth = np.unique((a << 42 | b << 21 | c)[~plain], return_inverse=True)
        m = (1 << 21) - 1
        out[~plain] = np.array([_bucket(chr(x >> 42) + chr(x >> 21 & m) + chr(x & m)) for x in keys.tolist()])[nth]
    return out


def bucket_counts(texts: list[str]) -> np.ndarray:
    """Rows of how often each bucket is hit by the features, tokens and character trigrams, of
    lower-cased texts. A feature's bucket is the last byte of its MD5."""
    row = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    inside = np.flatnonzero(row[:-2] == row[2:])
    hits = [row[inside] * BUCKETS + _gram_buckets(c[inside], c[inside + 1], c[inside + 2])]
    words, at = [], []
    for i, t in enumerate(texts):
        found = _WORD.findall(t)
        words += found
        at.append(len(found))
    if len(_words) > KEPT_WORDS:
        _words.clear()
    for w in {*words} - _words.keys():
        _words[w] = _bucket(w)
    hits.append(np.repeat(np.arange(len(texts)), at) * BUCKETS + np.fromiter(map(_words.__getitem__, words), np.int64, len(words)))
    return np.bincount(np.concatenate(hits), minlength=len(texts) * BUCKETS).reshape(-1, BUCKETS)


def blocks_of(sizes: Sequence[int], most: int = 1 << 20, rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` characters together, or of one row."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and (total + n > most or i - lo >= rows):
            yield lo, i
            lo, total = i, 0
        total += n
    if len(sizes):
        yield lo, len(sizes)


def _counted(texts: pd.Series) -> pd.Series:
    t = ["" if x is None else x for x in texts]
    return pd.Series([n for lo, hi in blocks_of([len(x) for x in t]) for n in bucket_counts(t[lo:hi]).astype(np.int32)])


def hashed(df: DataFrame, text_col: str, *keys: str) -> DataFrame:
    """Sparse unit vectors: (keys, bucket, w) over the features of ``bucket_counts``. Each text is
    counted within its row; one row of counts a text is shuffled, not its features."""
    n = F.pandas_udf(_counted, "array<int>")(F.lower(F.col(text_col)))
    each = df.where(F.col(text_col).isNotNull()).select(*keys, n.alias("n")).groupBy(*keys).agg(F.collect_list("n").alias("a"))
    wide = lambda x: F.transform(x, lambda v: v.cast("long"))
    total = F.when(F.size("a") == 1, wide(F.col("a")[0])).otherwise(F.aggregate(F.slice("a", F.lit(2), F.size("a")), wide(F.col("a")[0]), lambda s, x: F.zip_with(s, x, lambda p, q: p + q)))
    each = each.select(*keys, total.alias("n"))
    # the norm is taken in the array's own expression: beside the generator it would be taken for each bucket
    w = F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x * x, lambda s: F.transform("n", lambda x: x / F.sqrt(F.greatest(s, F.lit(1).cast("long")))))
    return each.select(*keys, F.posexplode(w).alias("bucket", "w")).where("w > 0")


def embedded(df: DataFrame, text_col: str, model: Callable[[list[str]], list[list[float]]], batch: int = 128, out: str = "vector") -> DataFrame:
    """Adds ``out``: unit vectors of a pluggable model, called on the executors with at most ``batch``
    texts at a time. Null texts are embedded as empty ones; what the model raises fails the job,
    as a score without vectors would be another score."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = part.fillna("").tolist()
            yield pd.Series([v for lo in range(0, len(texts), batch) for v in model(texts[lo : lo + batch])])

    return df.withColumn(out, F.pandas_udf(run, "array<double>")(F.col(text_col))).withColumn(out, unit(F.col(out)))


def nearest(queries: DataFrame, rows: DataFrame, id_col: str, vector_col: str, k: int, block: int = 2048) -> DataFrame:
    """(query_id, k, vec_id, sim): of a stated query set the k rows with the greatest dot product
    (rounded to six places; ties by id), the query's own row left out. Both sides meet in blocks
    of about ``block`` vectors, and each pair of blocks gives k rows a query, so that what is
    shuffled grows with the blocks and not with the pairs. Null vectors meet nothing."""
    kind = dict(rows.dtypes)[id_col]

    def packed(df: DataFrame, name: str, n: int) -> DataFrame:
        of = df.where(F.col(vector_col).isNotNull()).select(F.pmod(F.xxhash64(id_col), F.lit(max(1, -(-n // block)))).alias(name), F.col(id_col).alias("i"), F.col(vector_col).cast("array<double>").alias("v"))
        return of.groupBy(name).agg(F.collect_list("i").alias(f"{name}_ids"), F.flatten(F.collect_list("v")).alias(f"{name}_all"))

    left, right = packed(queries, "q", queries.count()), packed(rows, "r", rows.count())

    def best(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for q_ids, q_all, r_ids, r_all in zip(part["q_ids"], part["q_all"], part["r_ids"], part["r_all"]):
                q, r = (np.asarray(x, float).reshape(len(i), -1) for x, i in ((q_all, q_ids), (r_all, r_ids)))
                ids = np.asarray(r_ids)
                sims = np.round(q @ r.T, 6)
                sims[np.asarray(q_ids)[:, None] == ids[None, :]] = -np.inf
                out = []
                for i, s in zip(q_ids, sims):
                    at = np.lexsort((ids, -s))[:k]
                    out.append(pd.DataFrame({"query_id": i, "vec_id": ids[at], "sim": s[at]}))
                yield pd.concat(out)

    met = left.join(right, F.lit(True)).select("q_ids", "q_all", "r_ids", "r_all")  # blocks of the stated queries with blocks of all rows
    met = met.mapInPandas(best, f"query_id {kind}, vec_id {kind}, sim double").where(~F.col("sim").isin(float("-inf")))
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id"))
    return met.withColumn("k", nth.cast("long")).where(F.col("k") <= k).select("query_id", "k", "vec_id", "sim")
