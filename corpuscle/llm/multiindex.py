"""Embedding near-dedup by an inverted multi-index.

Vectors of unit length are cut into halves, each half has a codebook of its own (k-means on a
bounded sample), and the pairs of nearest centroids form a grid of cells: the index holds every
vector in its cell. A query visits cells by multi-sequence traversal, in the order of how much
farther their two centroids are than the nearest ones (d1 + d2 over the two sorted lists), until
the target recall is reached: the stop is set on sample vectors with simulated neighbours at
exactly the threshold, the hardest case, such that ``recall`` of them are in a visited cell from
one side or the other. Candidates are then verified by their cosine in double precision.

The grid grows with the vectors, PER_CELL to a cell on average, as long as the sample has
PER_CENTROID vectors for each centroid; beyond that cells grow. Cells are split into blocks of
members and of queries of bounded size; a block pair counts links and keeps a spanning forest of
them, so that what is emitted grows with the vectors and not with the pairs of a large group.
Equal vectors are one node with a count. Vectors travel as the bytes they came as (floats stay
floats) and are brought to length one in double precision where they are compared.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, staged

SAMPLE, PER_CENTROID, PER_CELL = 32_768, 8, 48
MEMBERS, QUERIES = 1024, 2048


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    c = x[np.random.default_rng(1).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        n = np.bincount(near, minlength=k)
        for j in np.flatnonzero(n):
            c[j] = x[near == j].mean(0)
    return c


class Grid:
    """Two codebooks and the stop of the traversal."""

    def __init__(self, sample: np.ndarray, k: int, threshold: float, recall: float):
        self.half = max(1, sample.shape[1] // 2)
        self.books = [kmeans(sample[:, : self.half], k), kmeans(sample[:, self.half :], k)]
        rng = np.random.default_rng(2)
        x = sample[rng.integers(0, len(sample), 4000)]
        g = rng.normal(size=x.shape)
        g -= (g * x).sum(1, keepdims=True) * x
        g /= np.maximum(np.linalg.norm(g, axis=1, keepdims=True), 1e-12)
        y = threshold * x + np.sqrt(1 - threshold**2) * g
        self.stop = float(np.quantile(np.minimum(self.score(x, self.cell(y)), self.score(y, self.cell(x))), recall))

    def excess(self, x: np.ndarray) -> list[np.ndarray]:
        """For each half, by how much each centroid is farther (squared) than the nearest."""
        out = []
        for c, part in zip(self.books, (x[:, : self.half], x[:, self.half :])):
            d = (c**2).sum(1) - 2 * part @ c.T
            out.append(d - d.min(1, keepdims=True))
        return out

    def cell(self, x: np.ndarray) -> np.ndarray:
        a, b = (e.argmin(1) for e in self.excess(x))
        return a * len(self.books[1]) + b

    def score(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        a, b = self.excess(x)
        i, k = np.arange(len(x)), len(self.books[1])
        return a[i, cell // k] + b[i, cell % k]

    def visits(self, x: np.ndarray) -> Iterator[list[int]]:
        """Cells of each vector by multi-sequence traversal, nearest first, up to the stop."""
        k = len(self.books[1])
        for a, b in zip(*self.excess(x)):
            ia, ib = np.argsort(a), np.argsort(b)
            a, b, ia, ib = a[ia].tolist(), b[ib].tolist(), ia.tolist(), ib.tolist()
            heap, out = [(0.0, 0, 0)], []
            while heap:
                s, i, j = heapq.heappop(heap)
                if s > self.stop and out:
                    break
                out.append(ia[i] * k + ib[j])
                if i + 1 < len(a) and j == 0:
                    heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
                if j + 1 < len(b):
                    heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
            yield out


def _unit(column: pa.Array, wide: str) -> np.ndarray:
    """Vectors of length one in double precision from their bytes; a second component of 0 for those
    that have one alone, as the grid has two halves."""
    v = np.frombuffer(b"".join(column.to_pylist()), wide).reshape(len(column), -1).astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True, initial=np.finfo(float).tiny)
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), np.finfo(float).tiny)
    return np.hstack([v, np.zeros_like(v)]) if v.shape[1] == 1 else v


def search(nodes: DataFrame, grid: Grid, threshold: float, wide: str) -> DataFrame:
    """nodes: (node, copies, cell, v), ``wide`` the type of v's numbers. Rows (a, b, links): links
    that a task found for node a, counted with copies; b not null: an edge of the task's spanning
    forest."""
    spark = nodes.sparkSession
    held = spark.sparkContext.broadcast(grid)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                t = batch.slice(lo, 500)
                cells = list(held.value.visits(_unit(t.column(1), wide)))
                at = np.repeat(np.arange(len(t)), [len(c) for c in cells])
                flat = np.concatenate([np.array(c, np.int32) for c in cells]) if cells else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(flat), t.column(0).take(pa.array(at))], ["cell", "node"])

    # the traversal is done once; cells that nothing is in are left out
    filled = nodes.groupBy("cell").agg(F.count("*").alias("members"))
    asked = staged(nodes.select("node", "v").mapInArrow(visit, "cell int, node binary").join(filled.select("cell"), "cell", "left_semi"), "grid-asked")
    sizes = filled.join(asked.groupBy("cell").agg(F.count("*").alias("queries")), "cell")
    sizes = staged(sizes.select(F.col("cell").alias("_cell"), F.ceil(F.col("members") / MEMBERS).cast("int").alias("blocks"), F.ceil(F.col("queries") / QUERIES).cast("int").alias("parts")), "grid-sizes")
    # each block of members meets each part of the queries
    same = F.col("cell") == F.col("_cell")
    index = nodes.join(sizes, same).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    index = index.select("cell", "block", "part", "node", "copies", "v")
    asked = asked.join(sizes, same).withColumn("part", F.pmod(F.xxhash64("node", F.lit(5)), F.col("parts")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # named anew: both sides of the cogroup come from the same table
    again = nodes.select(F.col("node").alias("_node"), F.col("copies").alias("_copies"), F.col("v").alias("_v"))
    asked = asked.join(again, F.col("node") == F.col("_node")).select("cell", "block", "part", "node", F.col("_copies").alias("copies"), F.col("_v").alias("v"))
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("links", pa.int64())])

    def verify(members: pa.Table, queries: pa.Table) -> pa.Table:
        if not members.num_rows or not queries.num_rows:
            return schema.empty_table()
        g, k = held.value, len(held.value.books[1])
        cell = members.column("cell")[0].as_py()
        names = members.column("node").to_pylist(), queries.column("node").to_pylist()
        m, q = _unit(members.column("v"), wide), _unit(queries.column("v"), wide)
        cm, cq = np.asarray(members.column("copies")), np.asarray(queries.column("copies"))
        # a member whose own traversal comes to the query's cell finds the link there as well: the smaller name counts
        ea, eb = g.excess(m)
        own = g.cell(q)
        n_m, n_q = np.zeros(len(m), np.int64), np.zeros(len(q), np.int64)
        root: dict[bytes, bytes] = {}

        def find(x: bytes) -> bytes:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        edges = []
        for lo in range(0, len(q), 512):
            i, j = np.nonzero(q[lo : lo + 512] @ m.T >= threshold)
            for a, b in zip((i + lo).tolist(), j.tolist()):
                x, y = names[1][a], names[0][b]
                if x == y:
                    continue
                c = own[a]
                if x > y and (c == cell or ea[b, c // k] + eb[b, c % k] <= g.stop):
                    continue
                n_q[a] += cm[b]
                n_m[b] += cq[a]
                u, v = find(x), find(y)
                if u != v:
                    root[max(u, v)] = min(u, v)
                    edges.append((x, y))
        rows = [(names[1][a], None, int(n_q[a])) for a in np.flatnonzero(n_q)] + [(names[0][b], None, int(n_m[b])) for b in np.flatnonzero(n_m)] + [(x, y, 0) for x, y in edges]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 3, schema)], schema=schema)

    by = ["cell", "block", "part"]
    return index.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(verify, "a binary, b binary, links long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.995, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links (other rows of cosine ``threshold`` or more
    found), component_id (smallest id reachable by links, itself included), kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing;
    vectors of another length than the most common link among their own length only. Repeated
    rows are rows of their own that link with each other. A null id is never the smallest unless
    its component has no other. Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    narrow = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    wide = F.col(vector_col).cast("array<double>")
    # the greatest component; null if one is null, NaN if one is: both rule the vector out
    most = F.aggregate(wide, F.lit(0.0), lambda s, v: F.when(s.isNull() | v.isNull(), F.lit(None)).otherwise(F.greatest(s, F.abs(v))))
    fine = F.coalesce((F.size(wide) > 0) & ~F.isnan(most) & (most > 0) & (most < float("inf")), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.when(fine, F.col(vector_col) if narrow else wide).alias("x"))
    rows = rows.withColumn("node", F.unhex(F.md5(F.to_json(F.struct("x")).cast("binary")))).withColumn("node", F.when(F.col("x").isNotNull(), F.col("node")))
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("x").alias("x"))
    nodes = staged(nodes.withColumn("dim", F.size("x")), "grid-nodes")
    dims = [r["dim"] for r in nodes.groupBy("dim").count().orderBy("dim").collect()]  # one entry a vector length
    found = None
    for dim in dims:
        part = _search_dim(nodes.where(F.col("dim") == dim), threshold, recall, narrow)
        found = part if found is None else found.unionAll(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = staged(found, "grid-links")
    comp = components(found.where("b is not null").select("a", "b"), name="grid-cc")
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    linked = staged(nodes.select("node", "least", "copies").join(links, "node", "left").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "grid-linked")
    least = linked.groupBy("comp").agg(F.min("least").alias("component_id"))
    linked = linked.join(least, "comp").select(F.col("node").alias("_node"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "node").join(linked, F.col("node") == F.col("_node"), "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def _search_dim(nodes: DataFrame, threshold: float, recall: float, narrow: bool) -> DataFrame:
    wide = "float32" if narrow else "float64"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.asarray(b.column(1).flatten()).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in v], pa.binary()), b.column(2)], ["node", "v", "copies"])

    packed = staged(nodes.select("node", "x", "copies").mapInArrow(pack, "node binary, v binary, copies long"), "grid-packed")
    n = packed.count()
    # a bounded sample, those of the smallest hashes
    sample = packed.orderBy(F.xxhash64("node", F.lit(3)), "node").limit(SAMPLE).select("v").toPandas()
    sample = _unit(pa.array(sample["v"].tolist(), pa.binary()), wide)
    k = max(1, min(round((n / PER_CELL) ** 0.5), len(sample) // PER_CENTROID))
    grid = Grid(sample, k, threshold, recall)
    held = packed.sparkSession.sparkContext.broadcast(grid)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(held.value.cell(_unit(b.column(1), wide)).astype(np.int32)), b.column(1)], ["node", "copies", "cell", "v"])

    cells = staged(packed.mapInArrow(index, "node binary, copies long, cell int, v binary"), "grid-cells")
    return search(cells, grid, threshold, wide)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: By brute force over all pairs; the index is held to find the same.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN (SELECT a, count(*) AS n FROM p GROUP BY a) x ON x.a = vec_id LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) y ON y.a = vec_id
"""
