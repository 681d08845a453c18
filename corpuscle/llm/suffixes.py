"""Repeated passages across documents by sparse suffix arrays.

A passage is a run of at least LENGTH words (A-Z as a-z) that stands in two different texts.
Only suffixes that start at minimiser positions are retained: the least of the hashes of K-word
runs in each window of WINDOW such runs. Every LENGTH-word run has its minimiser in its first
WINDOW places, and what follows there, at least PREFIX = LENGTH - WINDOW + 1 words, is the sort
key of that suffix: two bytes of each word's hash, one word after the other, which orders the
words as any alphabet would.

All retained suffixes are range-partitioned and sorted by key, and neighbours are compared: those
that agree on PREFIX words with a neighbour in another text go on. Ranges are cut by key and text,
so that a passage that a third of all documents share is sorted by many tasks; what stands at the
ends of a task is compared with the ends of the others. Suffixes with such a neighbour are
extended to the left and to the right: every LENGTH-word run that they are the minimiser of is
looked up, blocks of such runs that agree as a whole once for all texts that have them. The spans
are exactly the words inside runs that repeat in another text (up to collisions of hashes).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import content_key, staged
from .wordhash import Runs, words

LENGTH, WINDOW, K = 50, 25, 8
PREFIX = LENGTH - WINDOW + 1


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i : i + w]) for each i, by doubling."""
    have = 1
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if w > have else x


def retained(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Runs] | None:
    """(row, place, low, high, runs): the retained suffixes by place in the chunk's words; each is
    the minimiser of the LENGTH-word runs that start from low to high."""
    n = len(hashes)
    if n < LENGTH:
        return None
    runs = Runs(hashes)
    at = np.arange(n - K + 1)
    h = runs.of(at, at + K)
    bits = np.uint64(n.bit_length())
    # the place in the low bits: the least value tells where it is, the leftmost of equals
    least = _sliding_least(h >> bits << bits | at.astype(np.uint64), WINDOW)
    start = np.arange(len(least))
    row = np.searchsorted(offsets, start, "right") - 1
    good = start + LENGTH <= offsets[1:][np.minimum(row, len(offsets) - 2)]
    start, row, place = start[good], row[good], (least[good] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    if not len(start):
        return None
    new = np.flatnonzero(np.diff(place, prepend=-1) | np.diff(row, prepend=-1))
    return row[new], place[new], start[new], start[np.append(new[1:], len(start)) - 1], runs


def suffix_table(docs: DataFrame) -> DataFrame:
    """(key, node, low, high) of the retained suffixes of all texts; low and high count words of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes = b.column(0).to_numpy(zero_copy_only=False)
            for w in words(b.column(1)):
                if (got := retained(w.hash, w.offsets)) is None:
                    continue
                row, place, low, high, _ = got
                base = w.offsets[row]
                code = (w.hash >> np.uint64(48)).astype(">u2")
                key = np.lib.stride_tricks.sliding_window_view(code, PREFIX)[place].tobytes()
                keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * PREFIX), len(place), [None, pa.py_buffer(key)])
                yield pa.RecordBatch.from_arrays([keys.cast(pa.binary()), pa.array(nodes[w.first + row]), pa.array((low - base).astype(np.int32)), pa.array((high - base).astype(np.int32))], ["key", "node", "low", "high"])

    return docs.select("node", "text").mapInArrow(run, "key binary, node long, low int, high int")


#: Kinds of rows that a sorted task gives: a suffix with such a neighbour; one whose neighbour may
#: stand in another task; a text of the task's first or last key.
SHARED, OPEN, END = 0, 1, 2


def neighbours(table: DataFrame) -> DataFrame:
    """(node, low, high) of the suffixes whose key another text has too, from the sorted order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None  # the task's first key; the key that the rows so far end with
        shared = False  # whether that key has been met in two texts
        ends: list[int] = []  # its first and its latest text
        held: list[np.ndarray] = []  # its rows while it has been met in one text alone

        def rows(kind: int, key: bytes | None, r: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(r), kind, np.int32)), pa.array([key] * len(r), pa.binary()), pa.array(r[:, 0]), pa.array(r[:, 1].astype(np.int32)), pa.array(r[:, 2].astype(np.int32))], ["kind", "key", "node", "low", "high"])

        def close(at_end: bool) -> Iterator[pa.RecordBatch]:
            """The last key's rows are all there: at an end of the task others must be asked."""
            if last is not None and (at_end or last == first):
                yield rows(END, last, np.array([[ends[0], 0, 0], [ends[1], 0, 0]]))
                if not shared:
                    yield rows(OPEN, last, np.concatenate(held))

        for b in batches:
            if not b.num_rows:
                continue
            flat = b.column(0).cast(pa.binary(2 * PREFIX))
            k = np.frombuffer(flat.buffers()[1], np.uint8, 2 * PREFIX * len(flat), flat.offset * 2 * PREFIX).reshape(len(flat), -1)
            r = np.stack([b.column(i).to_numpy().astype(np.int64) for i in (1, 2, 3)], axis=1)
            cuts = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
            starts, stops = np.concatenate([[0], cuts]), np.append(cuts, len(k))
            several = r[starts, 0] != r[stops - 1, 0]
            # the first run may go on with the last key, the last one may go on in the next batch
            for i in sorted({0, len(starts) - 1}):
                key, part = k[starts[i]].tobytes(), r[starts[i] : stops[i]]
                if key != last:
                    yield from close(False)
                    first = key if first is None else first
                    last, shared, ends, held = key, False, [int(part[0, 0]), int(part[-1, 0])], []
                ends[1] = int(part[-1, 0])
                if not shared and ends[0] != ends[1]:
                    shared = True
                    if held:
                        yield rows(SHARED, None, np.concatenate(held))
                    held = []
                if shared:
                    yield rows(SHARED, None, part)
                else:
                    held.append(part)
                if i == 0 and len(starts) > 2:
                    inside = np.repeat(several[1:-1], (stops - starts)[1:-1])
                    found = r[stops[0] : starts[-1]][inside]
                    if len(found):
                        yield rows(SHARED, None, found)
        yield from close(True)

    order = ["key", "node", "low"]
    found = table.repartitionByRange("key", "node").sortWithinPartitions(*order).mapInArrow(run, "kind int, key binary, node long, low int, high int")
    found = staged(found, "suffix-neighbours")
    ends = found.where(F.col("kind") == END).groupBy(F.col("key").alias("_key")).agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a != b")
    met = found.where(F.col("kind") == OPEN).join(ends, F.col("key") == F.col("_key"), "left_semi")
    return found.where(F.col("kind") == SHARED).select("node", "low", "high").unionAll(met.select("node", "low", "high"))


def block_table(texts: DataFrame) -> DataFrame:
    """texts: (node, text, ranges of run starts). (block, node, low, runs): a fingerprint of all
    the words that a range of runs covers, and one of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, ranges = b.column(0).to_numpy(zero_copy_only=False), b.column(2)
            for w in words(b.column(1)):
                part = ranges.slice(w.first, w.rows)
                n = np.asarray(part.value_lengths().fill_null(0))
                flat = part.flatten()
                if not len(flat):
                    continue
                row = np.repeat(np.arange(w.rows), n)
                low, high = np.asarray(flat.field(0)).astype(np.int64), np.asarray(flat.field(1)).astype(np.int64)
                first, count = w.offsets[row] + low, high - low + 1
                runs = Runs(w.hash)
                ends = np.cumsum(count)
                each = np.repeat(first - (ends - count), count) + np.arange(ends[-1])
                hashes = runs.of(each, each + LENGTH).astype(np.int64)
                block = runs.of(first, first + count - 1 + LENGTH).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(nodes[w.first + row]), pa.array(low.astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(hashes))], ["block", "node", "low", "runs"])

    return texts.mapInArrow(run, "block long, node long, low int, runs array<long>")


def merged(row: np.ndarray, start: np.ndarray, end: np.ndarray, rows: int) -> pa.Array:
    """Of each row the union of its spans: structs of start and end, ascending and apart."""
    wide = int(end.max(initial=0)) + 1
    order = np.lexsort((start, row))
    start, reach = (row * wide + start)[order], np.maximum.accumulate((row * wide + end)[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]  # a row's numbers are all beyond those of the row before
    start, end = start[new], reach[np.append(new[1:], True)[: len(new)]]
    offsets = np.searchsorted(start, np.arange(rows + 1) * wide).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array((x % wide).astype(np.int32)) for x in (start, end)], ["start", "end"]))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document that shares a passage with another: doc_id, n_words, n_repeated
    (words inside repeated passages), spans (start, end in words, end exclusive, ascending and
    apart), later_spans (the same of those passages whose first text is another one: what
    dedup may cut), first_id (smallest id with an equal text).

    Equal texts of LENGTH words or more are repeated as a whole; the row with the smallest id is
    the first (of repeated ids each). Texts that are null, empty or shorter than LENGTH words have
    no row. "First" among different texts is by a hash of the text, the same on every run. A null
    id is kept; repeated rows each have theirs; texts of any length are read whole; other columns
    are ignored, whatever their names; an empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.where("text is not null").withColumn("node", F.conv(F.substring(F.md5("text"), 1, 16), 16, -10).cast("long"))
    ranges = neighbours(suffix_table(docs)).groupBy("node").agg(F.collect_set(F.struct("low", "high")).alias("ranges"))
    # one row stands for equal texts: that of the smallest id
    heads = docs.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    heads = staged(heads.join(ranges, "node", "left").where("ranges is not null or copies > 1"), "suffix-heads")
    need = heads.where("ranges is not null").select(F.col("node").alias("_node"), "first_id", "ranges")
    texts = docs.join(need, (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).select("node", "text", "ranges")
    blocks = staged(block_table(texts), "suffix-blocks")
    # each different block once; of each run the first and the last text that has it
    kinds = staged(blocks.groupBy("block").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.first("runs").alias("runs")), "suffix-kinds")
    each = kinds.select("block", "a", "b", F.posexplode("runs").alias("i", "run"))
    runs = each.groupBy("run").agg(F.min("a").alias("head"), F.max("b").alias("tail")).where("head != tail").select("run", "head")
    # a block's repeated runs as segments of consecutive places with the same first text
    found = each.select("block", "i", "run").join(runs, "run")
    found = found.withColumn("island", F.col("i") - F.row_number().over(W.partitionBy("block", "head").orderBy("i")))
    segments = found.groupBy("block", "head", "island").agg(F.min("i").alias("i0"), F.max("i").alias("i1"))
    segments = segments.groupBy("block").agg(F.collect_list(F.struct("i0", "i1", "head")).alias("segments"))
    spans = blocks.select("block", "node", "low").join(segments, "block").select("node", "low", F.inline("segments"))
    spans = spans.select("node", (F.col("low") + F.col("i0")).alias("start"), (F.col("low") + F.col("i1") + LENGTH).alias("end"), (F.col("head") != F.col("node")).alias("later"))
    spans = spans.groupBy("node").agg(F.collect_set(F.struct("start", "end", "later")).alias("s"))
    span = "array<struct<start:int,end:int>>"

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(1).flatten()
            row = np.repeat(np.arange(b.num_rows), np.asarray(b.column(1).value_lengths().fill_null(0)))
            start, end = (np.asarray(flat.field(i)).astype(np.int64) for i in (0, 1))
            late = flat.field(2).to_numpy(zero_copy_only=False).astype(bool)
            yield pa.RecordBatch.from_arrays([b.column(0), merged(row, start, end, b.num_rows), merged(row[late], start[late], end[late], b.num_rows)], ["node", "spans", "later_spans"])

    spans = spans.mapInArrow(merge, f"node long, spans {span}, later_spans {span}")
    found = heads.select("node", "first_id", "copies").join(spans, "node", "left").where("spans is not null or copies > 1").withColumnRenamed("node", "_node")
    n_words = F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")).cast("int")
    out = docs.select("doc_id", "node", n_words.alias("n_words")).where(f"n_words >= {LENGTH}").join(found, F.col("node") == F.col("_node"))
    all_of = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").alias("end"))).cast(span)
    copy = F.col("copies") > 1
    first = F.col("doc_id").eqNullSafe(F.col("first_id"))
    none = F.array().cast(span)
    out = out.withColumn("later_spans", F.when(copy & ~first, all_of).otherwise(F.coalesce("later_spans", none))).withColumn("spans", F.when(copy, all_of).otherwise(F.coalesce("spans", none)))
    repeated = F.aggregate("spans", F.lit(0), lambda n, x: n + x["end"] - x["start"])
    return out.select("doc_id", "n_words", repeated.alias("n_repeated"), "spans", "later_spans", "first_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans as text: start:end, comma-joined."""
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",").alias(c)
    out = repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_repeated", text("spans"), text("later_spans"), "first_id")


def _islands(flag: str, name: str) -> str:
    """Unions of overlapping or touching runs of LENGTH words that start at s."""
    return f"""{name} AS (SELECT doc_id, string_agg(a || ':' || b, ',' ORDER BY a) AS spans, sum(b - a)::INT AS n FROM (SELECT doc_id, min(s) AS a, max(s) + {LENGTH} AS b
  FROM (SELECT *, sum(far) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS island
    FROM (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= {LENGTH} THEN 0 ELSE 1 END AS far FROM hit WHERE {flag})) GROUP BY doc_id, island) GROUP BY doc_id)"""


#: Every run of LENGTH words is looked up among all documents' runs.
SQL = f"""
WITH d AS (SELECT doc_id, md5(text) AS m, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, w, ('0x' || substr(m, 1, 16))::UBIGINT AS u FROM d),
n AS (SELECT doc_id, w, CASE WHEN u >= 9223372036854775808::UBIGINT THEN (u::HUGEINT - 18446744073709551616::HUGEINT)::BIGINT ELSE u::BIGINT END AS node FROM k),
c AS (SELECT node, min(doc_id) AS first_id, count(*) AS copies FROM n GROUP BY node),
r AS (SELECT doc_id, node, s, md5(array_to_string(w[s + 1 : s + {LENGTH}], ' ')) AS h FROM (SELECT doc_id, node, w, unnest(range(0, len(w) - {LENGTH} + 1)) AS s FROM n WHERE len(w) >= {LENGTH})),
g AS (SELECT h, min(node) AS a FROM r GROUP BY h HAVING min(node) <> max(node)),
hit AS (SELECT r.doc_id, r.s, g.a <> r.node AS later FROM r JOIN g USING (h)),
{_islands("TRUE", "every")}, {_islands("later", "late")}
SELECT doc_id, len(w)::INT AS n_words, CASE WHEN copies > 1 THEN len(w)::INT ELSE every.n END AS n_repeated, CASE WHEN copies > 1 THEN '0:' || len(w) ELSE every.spans END AS spans,
  CASE WHEN copies > 1 AND doc_id <> first_id THEN '0:' || len(w) ELSE coalesce(late.spans, '') END AS later_spans, first_id
FROM n JOIN c USING (node) LEFT JOIN every USING (doc_id) LEFT JOIN late USING (doc_id) WHERE len(w) >= {LENGTH} AND (copies > 1 OR every.n > 0)
"""
