"""Exact and near fingerprints, near pairs by banding, and classes."""

from __future__ import annotations

import hashlib
import re
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.text import plain

from .ordering import settled

#: Six blocks of the 64 bits; at most 3 flipped bits leave three blocks as they were.
BLOCKS = (11, 11, 11, 11, 10, 10)
_SPACE = re.compile(b" ")


def exact_fingerprint(text: Column) -> Column:
    return F.substring(F.sha2(plain(text), 256), 1, 32)


def hex16(x: Column) -> Column:
    return F.lower(F.lpad(F.hex(x), 16, "0"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hex strings; 64 if one of them is not hex."""
    good = lambda c: c.rlike("^[0-9a-fA-F]{1,16}$")
    number = lambda c: F.conv(F.when(good(c), c), 16, -10).cast("long")
    return F.coalesce(F.bit_count(number(a).bitwiseXOR(number(b))), F.lit(64))


def _fingerprints(plain_texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> int:
        b = (text or "").encode()
        if not b:
            return 0
        # words are one space apart, so three of them are a part of the text
        ends = [m.start() for m in _SPACE.finditer(b)]
        starts, ends = [0, *[e + 1 for e in ends]], [*ends, len(b)]
        low = b"".join([hashlib.md5(b[i:j]).digest()[8:] for i, j in (zip(starts, ends[2:]) if len(ends) >= 3 else zip(starts, ends))])
        n = len(low) // 8
        ones = np.zeros(64, np.int64)
        for lo in range(0, len(low), 1 << 16):
            ones += np.unpackbits(np.frombuffer(low[lo : lo + (1 << 16)], np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)

    return plain_texts.map(one)


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): 64-bit SimHash over three-token shingles (fewer than three: the tokens; no
    token: 0), each hashed by the low half of its MD5. The bits of a text are summed up within
    its row, on Arrow batches: as rows of a table, every shingle would be shuffled."""
    of = F.pandas_udf(_fingerprints, "long")
    return docs.select(F.col(id_col).alias("doc_id"), of(plain(F.coalesce(F.col(text_col), F.lit("")))).alias("fp"))


def near_pairs(prints: DataFrame, distance: int = 3) -> DataFrame:
    """prints: (doc_id, fp). Pairs of different fingerprints at most ``distance`` (3 or less)
    bits apart, each by its smallest document: (a, b, d). Equal fingerprints are one node.

    Three of six blocks must agree: 20 keys of about 32 bits, so that buckets stay small at any
    size of the corpus; each pair is compared once for each key that it shares."""
    if distance > 3:
        raise ValueError("six blocks find up to three differing bits")
    # fingerprints come from whole texts: they are made once for both sides
    nodes = settled(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    at, masks = 0, []
    for width in BLOCKS:
        masks.append(((1 << width) - 1) << at)
        at += width
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = [F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(sum(masks[i] for i in c))).cast("long")).alias("v")) for k, c in enumerate(combinations(range(6), 3))]
    banded = nodes.withColumn("key", F.explode(F.array(*keys))).select("doc_id", "fp", "key.t", "key.v")
    other = banded.select(F.col("doc_id").alias("other"), F.col("fp").alias("fp2"), "t", "v")
    d = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2")))
    pairs = banded.join(other, ["t", "v"]).where((F.col("doc_id") < F.col("other")) & (d <= distance))
    return pairs.select(F.col("doc_id").alias("a"), F.col("other").alias("b"), d.cast("int").alias("d")).distinct()


def duplicates(docs: DataFrame, distance: int = 3) -> DataFrame:
    """docs: (doc_id, text, ok). (a, b, d) of documents that could be read, nearest pairs first:
    equal texts (d 0), each with the smallest document of its text, and texts whose fingerprints
    are at most ``distance`` bits apart, each by its smallest document."""
    good = docs.where("ok").select("doc_id", "text")
    prints = simhash(good).join(good.select(F.col("doc_id").alias("_i"), exact_fingerprint(F.col("text")).alias("exact")), F.col("doc_id") == F.col("_i")).drop("_i")
    first = prints.groupBy(F.col("exact").alias("_e")).agg(F.min("doc_id").alias("a"))
    same = prints.join(first, F.col("exact") == F.col("_e")).where("doc_id != a").select("a", F.col("doc_id").alias("b"), F.lit(0).alias("d"))
    # texts that differ with one fingerprint: each text's smallest document with that of the fingerprint
    texts = prints.join(first, F.col("exact") == F.col("_e")).where("doc_id = a").select("doc_id", "fp")
    least = texts.groupBy(F.col("fp").alias("_f")).agg(F.min("doc_id").alias("a"))
    alike = texts.join(least, F.col("fp") == F.col("_f")).where("doc_id != a").select("a", F.col("doc_id").alias("b"), F.lit(0).alias("d"))
    return same.unionAll(alike).unionAll(near_pairs(texts, distance)).orderBy("d", "a", "b")


def classes(pairs: DataFrame, nodes: DataFrame, ) -> DataFrame:
    """nodes: (doc_id). (doc_id, rep): the smallest document reachable over pairs (a, b), by
    minimum labels that also jump to their label's label, checkpointed each round."""
    edges = settled(pairs.select("a", "b").unionAll(pairs.select("b", "a")).toDF("a", "b"))
    labels = settled(nodes.select("doc_id", F.col("doc_id").alias("rep")).distinct())
    while True:
        seen = edges.join(labels, edges["b"] == labels["doc_id"]).groupBy("a").agg(F.min("rep").alias("m"))
        new = labels.join(seen, labels["doc_id"] == seen["a"], "left").select("doc_id", "rep", F.least("rep", F.coalesce("m", "rep")).alias("m"))
        jump = labels.select(F.col("doc_id").alias("j"), F.col("rep").alias("jr"))
        new = settled(new.join(jump, F.col("m") == F.col("j"), "left").select("doc_id", "rep", F.least("m", F.coalesce("jr", "m")).alias("m")))
        changed = new.where("m != rep").limit(1).count()
        labels = new.select("doc_id", F.col("m").alias("rep"))
        if not changed:
            return labels


def fold_duplicates(ranked: DataFrame, reps: DataFrame) -> DataFrame:
    """Suppressed copies point to their representative, which lists them."""
    r = ranked.join(reps, "doc_id", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    copies = r.where("rep != doc_id").groupBy("rep").agg(F.array_sort(F.collect_list("doc_id")).alias("duplicates")).withColumnRenamed("rep", "_rep")
    r = r.join(copies, F.col("doc_id") == F.col("_rep"), "left").drop("_rep")
    return r.withColumn("duplicate_of", F.when(F.col("rep") != F.col("doc_id"), F.col("rep"))).drop("rep")
