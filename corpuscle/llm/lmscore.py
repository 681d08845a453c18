"""Language-model scoring by context-tree weighting, beside a unigram base score.

The model predicts a text's UTF-8 bytes and then its end, each as eight binary decisions; the end,
and what stands before a text, is a byte that UTF-8 never has, so that the probabilities of all
texts sum to one at most. Every decision has a context tree of its own: the root knows the bits
decided so far, a node at depth d also the last d bytes, DEPTH at most. Each node keeps a Krichevsky-Trofimov estimate of its counts; bottom-up
its weighted probability is half its own estimate and half the product of its children's, and a
prediction mixes the estimates of all depths along the path by the posterior weights this gives
(Willems et al. 1995). A decision that training never saw after a context is predicted as after
the longest part of it where it was seen. All training documents are counted.

The tree grows with the corpus and is never in one place. Texts are cut into blocks of about
BLOCK bytes; each block's distinct codes (context and byte) are a written table, and so are
their sums over all blocks. Codes whose contexts end in the same two bytes meet in one task,
which weights that part of the tree bottom-up; sums by the last byte go to the driver (256
contexts at most), which weights the depths up to one and broadcasts them. The tasks then come
down to the probability of each code, which joins the blocks that have it.

The base score needs the count of every word. The FREQUENT most frequent words are broadcast;
other words meet their counts in a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import fold_of, staged
from .wordhash import pieces, raw, words

DEPTH = 4
#: Texts end with it and begin after it; no byte of UTF-8.
MARK = 0xFF
BLOCK = 32 << 20
#: Codes weighted in one task, about.
PART = 200_000
FREQUENT = 1 << 16


def marked(b: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets with MARK after each text."""
    return np.insert(b, o[1:], MARK), o + np.arange(len(o))


def _codes(b: np.ndarray, o: np.ndarray, depth: int = 2) -> np.ndarray:
    """Each byte with the ``depth`` before it in its text (MARK where there is none), as one number."""
    at = np.arange(len(b)) - np.repeat(o[:-1], np.diff(o))
    out = b.astype(np.int64)
    for k in range(1, depth + 1):
        before = np.full(len(b), MARK, np.int64)
        before[k:] = np.where(at[k:] >= k, b[:-k], MARK)
        out |= before << 8 * k
    return out


def _add(have: tuple[np.ndarray, np.ndarray], keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        keys, counts = np.unique(keys, return_counts=True)
    keys, counts = np.concatenate([have[0], keys]), np.concatenate([have[1], counts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


def in_blocks(docs: DataFrame) -> DataFrame:
    """Adds ``block``: rows that follow each other, about BLOCK bytes of text. To be staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, before = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            size = np.diff(raw(batch.column("text"))[1])
            since = before + np.cumsum(size) - size
            before += int(size.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first + since // BLOCK)], [*batch.schema.names, "block"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("block", LongType())]))


def count_codes(docs: DataFrame) -> DataFrame:
    """(block, code, n): the distinct codes of each block's texts, and how often they stand in
    its training texts. A block that two tasks read has rows from both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, have = -1, none

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(have[0]), at)), *map(pa.array, have)], ["block", "code", "n"])

        for batch in batches:
            data, offs = raw(batch.column(0))
            held, block = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), len(block)]
            for lo, hi in ((a + x, a + y) for a, b in zip(cuts, cuts[1:]) for x, y in pieces(offs[a : b + 1])):
                if block[lo] != at:
                    if len(have[0]):
                        yield out()
                    at, have = int(block[lo]), none
                bytes_, o = marked(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                codes, kept = _codes(bytes_, o, DEPTH), np.repeat(~held[lo:hi], np.diff(o))
                other = np.unique(codes[~kept])
                have = _add(_add(have, codes[kept]), other, np.zeros(len(other), np.int64))
        if len(have[0]):
            yield out()

    return docs.select("text", "held_out", "block").mapInArrow(run, "block long, code long, n long")


def count_words(texts: DataFrame) -> DataFrame:
    """(h, n) over all texts: how often each word, by its 64-bit hash, stands there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            have = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            parts = [np.unique(w.hash, return_counts=True) for w in words(batch.column(0))]
            if parts:
                have = _add(have, *(np.concatenate(x) for x in zip(*parts)))
            yield pa.RecordBatch.from_arrays([pa.array(have[0].astype(np.int64)), pa.array(have[1])], ["h", "n"])

    return texts.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def ln_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0: Stirling's series after moving x beyond 8."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift[low] += np.log(y[low])
        y[low] += 1
    i = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - i * (1 / 360 - i * (1 / 1260 - i / 1680))) / y - shift


def _path(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eight decisions of each code's byte: (context and node as one number, bit), 8 rows."""
    level = np.arange(8)[:, None]
    return code & ~255 | 1 << level | (code & 255) >> 8 - level, (code & 255) >> 7 - level & 1


def _shorter(key: np.ndarray, depth: int) -> np.ndarray:
    """Keys of the same decisions after the last ``depth`` bytes alone."""
    return (key >> 8 & (1 << 8 * depth) - 1) << 8 | key & 255


def _summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[new], *(np.add.reduceat(v[order], new) if len(new) else v for v in values)


class Level:
    """One depth of the tree: sorted keys (context and node), counts, and for all but the
    deepest the sum of ln weighted probability of the children."""

    def __init__(self, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None = None):
        self.key, self.zeros, self.ones = key, zeros, ones
        self.one = (ones + 0.5) / (zeros + ones + 1)
        own = ln_gamma(zeros + 0.5) + ln_gamma(ones + 0.5) - ln_gamma(zeros + ones + 1.0) - np.log(np.pi)
        self.stay = np.ones(len(key)) if below is None else 1 / (1 + np.exp(np.clip(below - own, -700, 700)))
        self.ln_w = own if below is None else np.logaddexp(own, below) + np.log(0.5)

    def up(self, depth: int) -> tuple[np.ndarray, ...]:
        """Keys, counts and sums for the level above, whose contexts have ``depth`` bytes."""
        return _summed(_shorter(self.key, depth), self.zeros, self.ones, self.ln_w)

    def mix(self, above: Level | None, depth: int) -> None:
        """p: of a one, where this is the deepest level that has the key; acc, rest: for the level below."""
        acc, rest = np.zeros(len(self.key)), np.ones(len(self.key))
        if above is not None:
            at = np.searchsorted(above.key, _shorter(self.key, depth - 1))
            acc, rest = above.acc[at], above.rest[at]
        self.p, self.acc, self.rest = acc + rest * self.one, acc + rest * self.stay * self.one, rest * (1 - self.stay)


def lower(code: np.ndarray, n: np.ndarray, depth: int = DEPTH) -> list[Level]:
    """Levels 2 to ``depth`` from the counts of whole subtrees, weighted bottom-up."""
    code, n = code[n > 0], n[n > 0]
    key, bit = _path(code)
    levels = [Level(*_summed(key.ravel(), (n * (1 - bit)).ravel(), (n * bit).ravel()))]
    for d in range(depth - 1, 1, -1):
        levels.insert(0, Level(*levels[0].up(d)))
    return levels


def upper(key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> list[Level]:
    """Levels 0 and 1 from the sums that ``lower`` gives for level 1, ready to come down."""
    levels = [Level(*_summed(key, zeros, ones, below))]
    levels.insert(0, Level(*levels[0].up(0)))
    for d, level in enumerate(levels):
        level.mix(levels[d - 1] if d else None, d)
    return levels


def probabilities(code: np.ndarray, n: np.ndarray, top: list[Level], depth: int = DEPTH) -> np.ndarray:
    """Log10 probability of each code's byte after its context; all counts of its subtree are here."""
    levels = [*top, *lower(code, n, depth)]
    for d in range(2, depth + 1):
        levels[d].mix(levels[d - 1], d)
    key, bit = (x.ravel() for x in _path(code))
    p, left = np.full(len(key), 0.5), np.arange(len(key))
    for d in range(depth, -1, -1):
        level, want = levels[d], _shorter(key[left], d)
        if len(level.key):
            at = np.minimum(np.searchsorted(level.key, want), len(level.key) - 1)
            seen = level.key[at] == want
            p[left[seen]] = level.p[at[seen]]
            left = left[~seen]
    return np.log10(np.where(bit == 1, p, 1 - p)).reshape(8, -1).sum(0)


def score_codes(codes: DataFrame) -> DataFrame:
    """(code, lp) from (code, n): log10 probabilities by the tree of all codes with n > 0."""
    spark = codes.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-codes.count() // PART))
    # subtrees by the last two bytes of the context
    codes = codes.select("code", "n").repartition(parts, F.shiftright("code", 8).bitwiseAND(F.lit((1 << 16) - 1)))

    def whole(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        return tuple(np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in lower(*whole(batches))[0].up(1)], ["key", "zeros", "ones", "below"])

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n = whole(batches)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(probabilities(code, n, top.value))], ["code", "lp"])

    sums = codes.mapInArrow(climb, "key long, zeros long, ones long, below double").groupBy("key").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below")))
    sums = sums.toPandas()  # 255 decisions after 256 contexts at most
    top = spark.sparkContext.broadcast(upper(*(sums[c].to_numpy(t) for c, t in (("key", np.int64), ("zeros", np.int64), ("ones", np.int64), ("below", np.float64)))))
    return codes.mapInArrow(descend, "code long, lp double")


def score_documents(docs: DataFrame, folds: int = 5, held_fold: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score (log10 probability of the text's bytes and its end by the context tree), bits_per_byte
    (of score, over the bytes and the end).

    Trained on the documents whose crc32(id as text) mod ``folds`` is not ``held_fold``; a null
    id has no fold and is trained on. Null texts count as empty: one token (the end), and the end
    alone is scored. Repeated rows count as often as they stand there. Without training documents
    every byte has probability 1/256. Texts of any length are scored whole; other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    held_out = F.coalesce(fold_of("doc_id", folds) == held_fold, F.lit(False))
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # rows have a number of their own: copies of one text are not one key
    docs = docs.withColumn("held_out", held_out).withColumn("row", F.monotonically_increasing_id())
    docs = staged(in_blocks(docs), "lm-texts")
    train = docs.where("not held_out")
    found = staged(count_codes(docs), "lm-codes")
    codes = staged(found.groupBy("code").agg(F.sum("n").alias("n")), "lm-contexts")
    probs = found.select("block", "code").join(score_codes(codes), "code")
    vocabulary = staged(count_words(train), "lm-words")
    ends = train.count()
    total, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, distinct = total + ends, distinct + (ends > 0)
    top = vocabulary.orderBy(F.desc("n"), "h").limit(FREQUENT).toPandas().sort_values("h")
    held = spark.sparkContext.broadcast((top["h"].to_numpy(np.int64), top["n"].to_numpy(np.int64)))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rare_type = pa.struct([("h", pa.int64()), ("k", pa.int32())])
    norm = float(np.log10(total + 0.5 * (distinct + 1)))
    end = float(np.log10(ends + 0.5)) - norm

    def run(block: pa.Table, own: pa.Table) -> pa.Table:
        names, counts = held.value
        logs = np.log10(counts + 0.5)
        code, lp_of = own["code"].to_numpy(), own["lp"].to_numpy()
        order = np.argsort(code)
        code, lp_of = code[order], lp_of[order]
        out = []
        for batch in block.select(["doc_id", "held_out", "row", "text"]).to_batches():
            texts = batch.column(3)
            n_words, known, base, score, size, rare, rare_n = ([] for _ in range(7))
            for w in words(texts):
                n = np.diff(w.offsets)
                row, h = w.row_of, w.hash.astype(np.int64)
                at = np.minimum(np.searchsorted(names, h), max(len(names) - 1, 0))
                common = names[at] == h if len(names) else np.zeros(len(h), bool)
                n_words.append(n)
                known.append(np.bincount(row[common], minlength=w.rows))
                base.append(np.bincount(row[common], logs[at[common]], w.rows))
                data, at_row = marked(w.data, w.row_bytes)
                lp = lp_of[np.searchsorted(code, _codes(data, at_row, DEPTH))]
                total = np.concatenate([[0], np.cumsum(lp)])
                score.append(total[at_row[1:]] - total[at_row[:-1]])
                size.append(np.diff(at_row))
                # other words, each once a row with its count
                h, r = h[~common], row[~common]
                order = np.lexsort((h, r))
                h, r = h[order], r[order]
                new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])])) if len(h) else np.zeros(0, np.int64)
                rare.append((h[new], np.diff(np.append(new, len(h))).astype(np.int32)))
                rare_n.append(np.bincount(r[new], minlength=w.rows))
            if not n_words:
                continue
            cat = np.concatenate
            offsets = pa.array(cat([[0], np.cumsum(cat(rare_n))]).astype(np.int32))
            rare = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(cat(x)) for x in zip(*rare)], fields=list(rare_type)))
            out.append(pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cat(n_words)), pa.array(cat(known)), pa.array(cat(base)), pa.array(cat(score)), pa.array(cat(size)), rare], ["doc_id", "held_out", "row", "n_words", "known", "base", "score", "size", "rare"]))
        return pa.Table.from_batches(out)

    schema = f"doc_id {id_type}, held_out boolean, row long, n_words long, known long, base double, score double, size long, rare array<struct<h:bigint,k:int>>"
    rows = staged(docs.groupBy("block").cogroup(probs.groupBy("block")).applyInArrow(run, schema), "lm-rows")
    met = rows.select("row", F.inline("rare")).join(vocabulary, "h", "left")
    met = met.groupBy(F.col("row").alias("_row")).agg(F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rest"), F.sum(F.when(F.col("n") > 0, F.col("k"))).alias("rest_known"))
    out = rows.drop("rare").join(met, F.col("row") == F.col("_row"), "left")
    base = F.col("base") + F.coalesce("rest", F.lit(0.0)) - F.lit(norm) * F.col("n_words") + F.lit(end)
    known = F.col("known") + F.coalesce("rest_known", F.lit(0)) + int(ends > 0)
    bits = -F.col("score") * float(np.log2(10)) / F.col("size")
    return out.select("doc_id", "held_out", (F.col("n_words") + 1).alias("n_tokens"), known.cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), "score", bits.alias("bits_per_byte"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
