"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic function of its words
(hashed into a fixed number of weights); the document's is the noisy-or of its sentences':
1 - prod(1 - p). Only document labels are known: the weights are fitted to them through the
noisy-or, on at most ``per_class`` labelled documents of each class, chosen by a hash of the
id and weighted such that the classes keep their shares of all labels. In scoring, a sentence counts
by what its words add to the probability of one without evidence, so that the number of harmless
sentences makes no document toxic. All documents are scored whole, and the sentences whose own probability passes the
threshold are located.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, fresh
from .wordhash import NOT_ALNUM, Words, words

BITS = 17
_STOP = np.zeros(256, np.int64)
_STOP[[ord(c) for c in ".!?\n"]] = 1


def bags(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, first, row): three hashed features of each word in the rows of a matrix (the
    word, its first 4 and its first 5 bytes); where each sentence's words begin; each sentence's
    row. A sentence ends at . ! ? or a line's end, and with the text."""
    down = np.uint64(64 - BITS)
    features = np.stack([(h >> down).astype(np.int64) for h in (w.hash, w.lead(4), w.lead(5))])
    row = w.row_of
    stops = np.concatenate([[0], np.cumsum(_STOP[w.data])])[w.start]
    new = np.ones(len(row), bool)
    new[1:] = (stops[1:] != stops[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return features, first, row[first]


def presence(features: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sentence, feature) without repeats: a feature counts once a sentence."""
    sentence = np.repeat(np.arange(len(first)), np.diff(np.append(first, features.shape[1])))
    pair = np.unique((sentence << BITS | features).ravel())
    return pair >> BITS, pair & ((1 << BITS) - 1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(texts: pa.Array, labels: np.ndarray, weight: np.ndarray | None = None, steps: int = 200, rate: float = 0.1, decay: float = 1e-5, least_docs: int = 4, least_z: float = 4.0) -> np.ndarray:
    """Weights, the bias last, by Adam on the noisy-or likelihood. A feature has a weight only if
    ``least_docs`` documents have it and its share of toxic documents differs from that of
    others by ``least_z`` standard errors. ``weight``: of each document, 1 on average."""
    weight = np.ones(len(labels)) if weight is None else weight
    size, n, y = 1 << BITS, len(labels), labels.astype(float)
    x, m, v = np.concatenate([np.zeros(size), [-5.0]]), np.zeros(size + 1), np.zeros(size + 1)
    # the texts are read twice: only places of features that have a weight are ever held together
    docs, toxic = np.zeros(size), np.zeros(size)
    for w in words(texts, NOT_ALNUM):
        pair = np.unique(bags(w)[0] * w.rows + w.row_of)
        docs += np.bincount(pair // w.rows, minlength=size)
        toxic += np.bincount(pair // w.rows, y[w.first + pair % w.rows], size)
    if not docs.any() or y.min() == y.max():
        return x
    share = docs / n
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / y.sum() + 1 / (n - y.sum())))
    z = (toxic / y.sum() - (docs - toxic) / (n - y.sum())) / error
    keep = (docs >= least_docs) & (np.abs(z) >= least_z)
    f, s, d, n_s = [], [], [], 0
    for w in words(texts, NOT_ALNUM):
        features, first, row = bags(w)
        if len(first):
            sentence, feature = presence(features, first)
            kept = keep[feature]
            f.append(feature[kept])
            s.append(n_s + sentence[kept])
            d.append(row + w.first)
            n_s += len(first)
    f, s, d = map(np.concatenate, (f, s, d))
    for t in range(1, steps + 1):
        p = sigmoid(np.bincount(s, x[f], n_s) + x[-1])
        clean = np.bincount(d, np.log1p(-np.minimum(p, 1 - 1e-12)), n)  # log of the product of 1 - p
        pull = np.where(y > 0, -np.exp(clean) / np.maximum(-np.expm1(clean), 1e-9), 1.0)
        gz = (weight * pull)[d] * p / n
        g = np.append(np.bincount(f, gz[s], size), gz.sum()) + decay * np.append(x[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x


def train(docs: DataFrame, labels: DataFrame, per_class: int = 3000, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Weights fitted on labelled documents outside the held-out fold (crc32(id) mod 3 = 1), at most
    ``per_class`` of each class, each class weighted by its share of all such labels.

    A document with several labels is toxic if one says so; null labels and ids don't count. Of
    rows with one id the smallest text counts; null texts are empty. Without labels of both
    classes, or without documents, the weights are 0. Other columns are never read."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("toxic")).where(fold_of("_id", 3) != 1)
    order = F.xxhash64("_id", F.lit(11))
    chosen = [known.where(side).orderBy(order, "_id").limit(per_class) for side in ("toxic = 1", "toxic != 1")]
    chosen = F.broadcast(chosen[0].unionAll(chosen[1]))  # 2 * per_class rows of two numbers at most
    found = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = found.join(chosen, F.col("id") == F.col("_id")).groupBy("_id").agg(F.min("text").alias("text"), (F.max("toxic") == 1).cast("int").alias("y"))
    every = known.agg(F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0)), F.count("*")).first()
    shares = (every[1] - every[0], every[0])

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("_id")
        y = t.column("y").to_numpy()
        have = np.bincount(y, minlength=2)
        weight = np.array([shares[k] / max(have[k], 1) for k in (0, 1)])[y]
        return pa.table({"w": [fit(t.column("text").combine_chunks(), y, weight / max(weight.mean(), 1e-12))]})

    got = sample.withColumn("_all", F.col("y") * 0).groupBy("_all").applyInArrow(run, "w array<double>").collect()
    return np.array(got[0]["w"]) if got else fit(pa.array([], pa.string()), np.zeros(0))


def score(docs: DataFrame, weights: np.ndarray, threshold: float = 0.7, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with score, predicted (score >= threshold) and sentences: start and end (UTF-8
    bytes, of the words) and score of those that pass the threshold by themselves.

    A null text, or one without words, has score 0. Repeated rows are scored each, texts of any
    length whole; an empty table gives an empty result. Other columns are carried along, whatever
    their names; the new ones are the last three, their names start with ``prefix``, and with
    underscores before it where there is such a column already.
    """
    held = docs.sparkSession.sparkContext.broadcast(weights)
    added = [fresh(f"{prefix}{n}", docs) for n in ("score", "predicted", "sentences")]
    names = docs.columns
    at = names.index(text_col)
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = held.value
        none = sigmoid(x[-1:])[0]
        for b in batches:
            out = np.zeros(b.num_rows)
            rows: list[list] = [[] for _ in range(b.num_rows)]
            for w in words(b.column(at), NOT_ALNUM):
                features, first, row = bags(w)
                if not len(first):
                    continue
                feature = features.ravel()
                hot = np.flatnonzero(x[feature])  # most words have no weight
                sentence = np.repeat(np.arange(len(first)), np.diff(np.append(first, features.shape[1])))
                pair = np.unique(np.tile(sentence, 3)[hot] << BITS | feature[hot])
                p = sigmoid(np.bincount(pair >> BITS, x[pair & ((1 << BITS) - 1)], len(first)) + x[-1])
                p = np.maximum(p - none, 0) / (1 - none)
                out[w.first : w.first + w.rows] = -np.expm1(np.bincount(row, np.log1p(-np.minimum(p, 1 - 1e-12)), w.rows))
                last = np.append(first[1:], features.shape[1]) - 1
                for i in np.flatnonzero(p >= threshold):
                    r = row[i]
                    rows[w.first + r].append({"start": int(w.start[first[i]] - w.row_bytes[r]), "end": int(w.end[last[i]] - w.row_bytes[r]), "score": float(p[i])})
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out), pa.array((out >= threshold).astype(np.int32)), pa.array(rows, spans)], names=[*names, *added])

    kinds = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names)
    return docs.mapInArrow(run, f"{kinds}, `{added[0]}` double, `{added[1]}` int, `{added[2]}` array<struct<start:bigint,end:bigint,score:double>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    weights = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs.select("doc_id", "text"), weights)
    return out.select("doc_id", F.coalesce(fold_of("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted", "sentences")
