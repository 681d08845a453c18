"""MinHash near-dedup by improved consistent weighted sampling over TF-IDF shingles.

Shingles are runs of five words (A-Z as a-z; a text of fewer is one shingle). A shingle's weight
is its count in the text times the smoothed inverse document frequency 1 + ln((1 + n) / (1 + df)).
Documents are counted by families, so that copies don't lower the weight of what they share: each
document counts 1 / (size of the largest family it is in), a family being the documents with one
of FAMILIES plain min-hashes in common. Families of less than half of one in SHARE documents
count as single documents, and shingles that fewer than one in SHARE have count as having that
many: both tables are then bounded whatever the input (2 * SHARE * FAMILIES families, a count
sketch whose error is a fixed share of the documents), and the weights mean the same at any size.

Signatures: every text deals its shingles into BINS bins and draws one ICWS sample (Ioffe 2010)
from each; an empty bin borrows from the first filled one in a fixed order of its own. BANDS
bands of ROWS samples give the buckets, and BITS bits of every sample a sketch of 128 bytes.

Links: in each bucket one member, that which shares most buckets with most others, is compared
with all others; linked members are one component then. What is left are pairs in a bucket of
which one lies outside the component of the bucket's first member: they meet in one join. Both
times the sketches sort out pairs that are at least SIGMAS standard errors below the threshold,
before anything is emitted, and the exact weighted Jaccard similarity of whole texts decides
about the others. So no link between members of a bucket is dropped, a group of copies costs
comparisons in proportion to its size, and other pairs of a group are never rows of a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import components, content_key, staged
from .wordhash import mix, pieces, shingles, words

K = 5
BINS, BANDS, ROWS = 256, 20, 6
#: Bits of each sample in a sketch, kept as BITS planes of BINS bits; how much a sketch may err.
BITS, SIGMAS = 4, 4.0
PLANES = BINS // 64
FAMILIES, SHARE = 4, 1000
COUNTER_BITS, BLOCK_BITS = 19, 16
_TINY = 2.0**-53


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1) from 64 random bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * _TINY


def _seed(*n: int) -> np.uint64:
    return mix(np.array([sum((x + 1) << (20 * i) for i, x in enumerate(n))], np.uint64))[0]


def _draw(h: np.ndarray, w: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each weighted element: ln a, by whose minimum ICWS samples, and the sample's name."""
    a = mix(h ^ _seed(seed, 1))
    b = mix(a + _seed(seed, 2))
    c = mix(b + _seed(seed, 3))
    half = np.uint64(32)
    low = np.uint64(0xFFFFFFFF)
    f = lambda x: (x.astype(np.float64) + 0.5) * 2.0**-32
    r = -np.log(f(a >> half) * f(a & low))
    ln_c = np.log(-np.log(f(b >> half) * f(b & low)))
    beta = _unit(c)
    t = np.floor(np.log(w) / r + beta)
    return ln_c - r * (t - beta + 1.0), mix(h + t.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of each row without repeats: hash, row, count; by row."""
    key = mix(h ^ mix(row.astype(np.uint64) + np.uint64(1)))
    key, first, n = np.unique(key, return_index=True, return_counts=True)
    order = np.argsort(row[first], kind="stable")
    return h[first][order], row[first][order], n[order]


def _least_hashes(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """FAMILIES plain min-hashes of each row, as numbers that differ by hash function; 0 for rows
    without shingles."""
    out = np.zeros((rows, FAMILIES), np.uint64)
    if len(h):
        first = np.flatnonzero(np.diff(row, prepend=-1))
        for i in range(FAMILIES):
            out[row[first], i] = mix(np.minimum.reduceat(mix(h ^ _seed(7, i)), first) + np.uint64(i)) | np.uint64(1)
    return out


def families(docs: DataFrame) -> dict[int, int]:
    """Documents by min-hash, of those that more than one in 2 * SHARE documents have: as each
    document has FAMILIES min-hashes, there are at most 2 * SHARE * FAMILIES of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in words(b.column(0)):
                keys = _least_hashes(*shingles(w, K), w.rows)
                yield pa.RecordBatch.from_arrays([pa.array(keys[keys > 0].astype(np.int64))], ["key"])

    counts = staged(docs.select("text").mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")), "near-families")
    n = (counts.agg(F.sum("n")).first()[0] or 0) / FAMILIES
    return {r["key"]: r["n"] for r in counts.where(F.col("n") > n / (2 * SHARE)).collect()}


def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two counters of each shingle."""
    h = h >> np.uint64(16) << np.uint64(16)
    down = np.uint64(64 - COUNTER_BITS)
    return (h >> down).astype(np.int64), (mix(h ^ _seed(6)) >> down).astype(np.int64)


def document_frequencies(docs: DataFrame, sizes: dict[int, int]) -> tuple[np.ndarray, float]:
    """(counters, n): two rows of 2^COUNTER_BITS counters of documents by shingle, and the number
    of documents; each document counts one by the size of its largest family. Each task adds up
    its own; blocks of counters are added by Spark."""
    wide = 1 << BLOCK_BITS
    blocks = 2 << (COUNTER_BITS - BLOCK_BITS)
    known = np.array(sorted(sizes), np.int64)
    large = np.array([sizes[k] for k in sorted(sizes)], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((2, 1 << COUNTER_BITS)), 0.0
        for b in batches:
            for w in words(b.column(0)):
                h, row = shingles(w, K)
                keys = _least_hashes(h, row, w.rows)
                has = keys[:, 0] > 0
                size = np.ones(w.rows)
                if len(known):
                    k = keys.astype(np.int64)
                    at = np.minimum(np.searchsorted(known, k), len(known) - 1)
                    size = np.maximum(np.where(known[at] == k, large[at], 1.0).max(1), 1.0)
                n += (1 / size)[has].sum()
                for lo in range(0, w.rows, wide):
                    here = (row >= lo) & (row < lo + wide) if w.rows > wide else slice(None)
                    key = np.unique(h[here] >> np.uint64(16) << np.uint64(16) | (row[here] - lo).astype(np.uint64))
                    part = (1 / size)[(key & np.uint64(wide - 1)).astype(np.int64) + lo]
                    for t, slot in zip(total, _slots(key)):
                        t += np.bincount(slot, part, len(t))
        flat = total.ravel().astype(np.float32)
        data = [flat[i * wide : (i + 1) * wide].tobytes() for i in range(blocks)] + [np.array([n], np.float32).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(blocks + 1), pa.int32()), pa.array(data, pa.binary())], ["block", "data"])

    def add(t: pa.Table) -> pa.Table:
        s = sum(np.frombuffer(d.as_py(), np.float32).astype(np.float64) for d in t.column("data"))
        return pa.table({"block": t.column("block")[:1], "data": pa.array([s.astype(np.float32).tobytes()], pa.binary())})

    got = docs.select("text").mapInArrow(run, "block int, data binary").groupBy("block").applyInArrow(add, "block int, data binary").collect()
    got = {r["block"]: np.frombuffer(r["data"], np.float32) for r in got}
    if not got:
        return np.zeros((2, 1 << COUNTER_BITS), np.float32), 0.0
    return np.concatenate([got[i] for i in range(blocks)]).reshape(2, -1), float(got[blocks][0])


def idf(counters: np.ndarray, n: float) -> np.ndarray:
    """The factor that each counter stands for. What a counter has by chance, the mean of all, is
    taken off first; of a shingle's two counters the one with fewer documents holds."""
    df = counters - np.median(counters, 1, keepdims=True)
    return (1 + np.log((1 + n) / (1 + np.clip(df, n / SHARE, max(n, 1e-9))))).astype(np.float32)


def weighted(column: pa.Array, factor: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, shingle, row, weight) of each chunk of texts."""
    for w in words(column):
        h, row, n = distinct(*shingles(w, K))
        one, two = _slots(h)
        yield w.first, w.rows, h, row, n * np.maximum(factor[0][one], factor[1][two]).astype(np.float64)


def _least(ln_a: np.ndarray, name: np.ndarray, cell: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each cell (sorted): the name with the least ln a; the cells that have one."""
    start = np.flatnonzero(np.diff(cell, prepend=-1))
    low = np.minimum.reduceat(ln_a, start)
    is_low = ln_a == np.repeat(low, np.diff(np.append(start, len(cell))))
    out, has = np.zeros(cells, np.uint64), np.zeros(cells, bool)
    out[cell[is_low]] = name[is_low]
    has[cell[start]] = True
    return out, has


#: The order in which an empty bin looks for a filled one: its number, some bits of it flipped.
_FLIPS = np.argsort(mix(np.arange(1, BINS, dtype=np.uint64) + _seed(8))) + 1


def signatures(rows: int, h: np.ndarray, row: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which, buckets, sketch): the rows that have shingles, their BANDS buckets and sketches."""
    which, doc = np.unique(row, return_inverse=True)
    if not len(which):
        return which, np.zeros((0, BANDS), np.int64), np.zeros((0, BITS * PLANES), np.int64)
    cell = doc * BINS + (mix(h ^ _seed(5)) % np.uint64(BINS)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    name, has = _least(*(x[order] for x in _draw(h, w, 977)), cell[order], len(which) * BINS)
    full, empty = name.copy(), np.flatnonzero(~has)
    for flip in _FLIPS:
        if not len(empty):
            break
        other = empty ^ flip
        take = has[other]
        full[empty[take]] = mix(name[other[take]] + (empty[take] % BINS).astype(np.uint64))
        empty = empty[~take]
    full = full.reshape(-1, BINS)
    band = full[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
    key = np.zeros(band.shape[:2], np.uint64)
    for j in range(ROWS):
        key = mix(key * np.uint64(0x100000001B3) + band[:, :, j])
    key = mix(key + np.arange(BANDS, dtype=np.uint64))
    planes = [np.packbits((full >> np.uint64(63 - i) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64) for i in range(BITS)]
    return which, key.astype(np.int64), np.hstack(planes)


def may_link(a: str, b: str, threshold: float) -> Column:
    """Do two sketches agree as much as a similarity of ``threshold`` lets expect, SIGMAS standard
    errors off? A bin agrees if it has one sample, or by chance in all BITS bits."""
    chance = 2.0**-BITS
    agree = threshold + (1 - threshold) * chance
    least = BINS * agree - SIGMAS * (BINS * agree * (1 - agree)) ** 0.5
    same = [" | ".join(f"({a}[{p * PLANES + i}] ^ {b}[{p * PLANES + i}])" for p in range(BITS)) for i in range(PLANES)]
    return F.expr(" + ".join(f"bit_count(~({x}))" for x in same) + f" >= {least:.3f}")


def similarity(a: pa.Array, b: pa.Array, factor: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of a[i] and b[i]; 0 if one has no words."""
    n = len(a)
    sides = []
    for side in (a, b):
        parts = [(h, row + first, w) for first, _, h, row, w in weighted(side, factor)]
        h, row, w = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0))
        sides.append((mix(h ^ mix(row.astype(np.uint64) + np.uint64(1))), row, w))
    (ka, ra, wa), (kb, rb, wb) = sides
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    low = np.bincount(ra[ia], np.minimum(wa[ia], wb[ib]), n)
    high = np.bincount(ra, wa, n) + np.bincount(rb, wb, n) - low
    return np.divide(low, high, out=np.zeros(n), where=high > 0)


def verify(pairs: DataFrame, texts: DataFrame, held, threshold: float) -> DataFrame:
    """Of pairs (a, b), those of similarity ``threshold`` or more. texts: (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.asarray(pc.binary_length(batch.column(2)).fill_null(0)).astype(np.int64) + np.asarray(pc.binary_length(batch.column(3)).fill_null(0))
            for lo, hi in pieces(np.concatenate([[0], np.cumsum(size)])):
                t = batch.slice(lo, hi - lo)
                keep = pa.array(similarity(t.column(2), t.column(3), held.value) >= threshold)
                yield pa.RecordBatch.from_arrays([t.column(0).filter(keep), t.column(1).filter(keep)], ["a", "b"])

    one = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    two = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    return pairs.join(one, "b").join(two, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, class_rows, kept, node (16 bytes that stand
    for the text; null without words).

    A class is a connected component of links of weighted Jaccard similarity ``threshold`` or
    more; equal texts are one node. class_id is the smallest id of the class, class_rows its
    rows; kept is true for the row that has it (of rows that repeat that id in the class, for
    all). Texts that are null or have no word link to nothing: class_id is their own id. Null
    ids are left out of the smallest id, and never kept unless their class has no other. Texts of
    any length have one kind of signature and are compared whole; other columns are ignored,
    whatever their names; an empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.when(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.col(text_col)).alias("text"))
    docs = docs.withColumn("node", content_key("text"))
    spark = docs.sparkSession
    counters, n = document_frequencies(docs, families(docs))
    held = spark.sparkContext.broadcast(idf(counters, n))  # 2^(COUNTER_BITS + 1) numbers, whatever the input
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.int32()), pa.array(x.ravel()))
        for b in batches:
            for first, rows, h, row, w in weighted(b.column(2), held.value):
                which, bands, sketch = signatures(rows, h, row, w)
                at = pa.array(which + first)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), lists(bands), lists(sketch)], ["doc_id", "node", "bands", "sketch"])

    signed = docs.where("text is not null").select("doc_id", "node", "text").mapInArrow(run, f"doc_id {id_type}, node binary, bands array<long>, sketch array<long>")
    nodes = staged(signed.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "near-nodes")
    sketches = nodes.select("node", "sketch")
    member = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    member = staged(member.join(member.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket"), "near-members")
    # first in a bucket: what shares most buckets with most others, as the text that copies stem from does
    degree = member.groupBy("node").agg(F.sum("n").alias("degree"))
    hubs = member.join(degree, "node").groupBy("bucket").agg(F.max_by("node", F.struct("degree", "node")).alias("hub"))
    member = staged(member.select("bucket", "band", "node").join(hubs, "bucket"), "near-buckets")
    need = degree.join(nodes.select("node", "least"), "node").select(F.col("node").alias("_node"), "least")
    texts = docs.join(need, (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("least"))).select("node", "text").dropDuplicates(["node"])
    texts = staged(texts, "near-texts")
    pairs = member.where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    for side in "ab":
        pairs = pairs.join(sketches.select(F.col("node").alias(side), F.col("sketch").alias(f"sketch_{side}")), side)
    pairs = pairs.where(may_link("sketch_a", "sketch_b", threshold)).select("a", "b")
    links = staged(verify(pairs, texts, held, threshold), "near-links")
    comp = staged(components(links, name="near-cc"), "near-comp")
    # pairs of which one is outside the component of the bucket's hub
    at = member.join(comp.select("node", F.col("comp").alias("c")), "node", "left").withColumn("c", F.coalesce("c", "node"))
    at = at.join(comp.select(F.col("node").alias("hub"), F.col("comp").alias("hc")), "hub", "left").withColumn("out", F.col("c") != F.coalesce("hc", "hub"))
    at = staged(at.where("node != hub").select("bucket", "band", "node", "c", "out"), "near-at")
    left = at.where("out").select("bucket").distinct()
    at = at.join(left, "bucket", "left_semi").join(nodes.select("node", "sketch", "bands"), "node")
    x = at.where("out").select("bucket", F.col("node").alias("x"), F.col("c").alias("cx"), F.col("sketch").alias("sketch_x"), F.col("bands").alias("bands_x"))
    both = (x["cx"] != at["c"]) & (~at["out"] | (x["x"] < at["node"])) & may_link("sketch_x", "sketch", threshold)
    # a pair counts in the first of the buckets that it shares
    first = F.array_position(F.zip_with("bands_x", "bands", lambda s, t: s == t), True) == at["band"] + 1
    pairs = x.join(at, (x["bucket"] == at["bucket"]) & both & first).select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b"))
    # two that are outside in one bucket and not in another may still come twice
    pairs = staged(pairs.distinct(), "near-pairs")
    found = staged(verify(pairs, texts, held, threshold), "near-links")
    # components of components: only the new links count
    label = lambda side: comp.select(F.col("node").alias(side), F.col("comp").alias(f"c{side}"))
    over = found.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = components(over, name="near-cc").select(F.col("node").alias("comp"), F.col("comp").alias("now"))
    linked = nodes.select("node", "least", "copies").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    linked = linked.join(staged(joined, "near-comp"), "comp", "left").select("node", "least", "copies", F.coalesce("now", "comp").alias("comp"))
    classes = linked.groupBy("comp").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_rows"))
    classes = linked.join(classes, "comp").select(F.col("node").alias("_node"), "class_id", "class_rows")
    out = docs.select("doc_id", "node").join(classes, F.col("node") == F.col("_node"), "left")
    class_id = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce("class_rows", F.lit(1)).cast("long").alias("class_rows"), class_id.eqNullSafe(F.col("doc_id")).alias("kept"), "node")


def unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``docs`` for each class of near duplicates, that of the smallest id; columns as
    they are. Texts without words stay."""
    keep = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).where("kept and node is not null").select(F.col("doc_id").alias("_k_id"), F.col("node").alias("_k_node")).distinct()
    named = docs.withColumns({"_u_id": F.col(id_col), "_u_node": F.when(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), content_key(text_col))})
    kept = named.join(keep, F.col("_u_id").eqNullSafe(F.col("_k_id")) & (F.col("_u_node") == F.col("_k_node")))
    # rows that repeat both id and text: one of them
    kept = kept.withColumn("_u_n", F.row_number().over(W.partitionBy("_u_id", "_u_node").orderBy(F.lit(0)))).where("_u_n = 1")
    return kept.select(*docs.columns).unionAll(named.where("_u_node is null").select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("node")
