"""What the operators of this subpackage share: staged tables, small helpers, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, one of our own,
    in local mode only, where driver and executors are one process; elsewhere that is an error."""
    context = spark.sparkContext
    got = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if got:
        return got.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="corpuscle-")
    atexit.register(shutil.rmtree, own, True)
    context.setCheckpointDir(own)
    return context.getCheckpointDir().rstrip("/")


_staged: list[str] = []


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends there,
    and a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Removes what this process has staged so far, to be called when no result of it is read any
    more; the number of folders. Results are lazy, so that nothing is removed before."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = len(_staged)
    while _staged:
        path = jvm.org.apache.hadoop.fs.Path(_staged.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def content_key(text: str = "text") -> Column:
    """16 bytes that stand for a whole text; null for a null text."""
    return F.unhex(F.md5(F.col(text)))


def fresh(name: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has, in any case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fold_of(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def _contracted(edges: DataFrame) -> DataFrame:
    """(u, v), u > v: of each task's edges the forest that joins the same nodes, every node by
    its component's smallest one. A task holds its own edges only, by u."""
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}
        arrow = None
        for b in batches:
            arrow = b.schema.field(0).type
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ends = []
                for x in (u, v):
                    while root.setdefault(x, x) != x:
                        root[x] = x = root[root[x]]
                    ends.append(x)
                root[max(ends)] = min(ends)
        out = []
        for x in root:
            y = x
            while root[y] != y:
                y = root[y]
            if x != y:
                out.append((x, y))
        if arrow is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], arrow), pa.array([y for _, y in out], arrow)], ["u", "v"])

    return edges.select("u", "v").mapInArrow(run, f"u {kind}, v {kind}")


def components(edges: DataFrame, src: str = "a", dst: str = "b", name: str = "cc") -> DataFrame:
    """Connected components of an undirected edge table: ``(node, comp)``, comp the smallest node
    reachable. Each task contracts its own edges to a forest, then alternating large-star and
    small-star steps (Kiveris et al. 2014) join the forests; every step is a map-side combined
    minimum and one join, staged, so that no component meets in one task and the plan does not
    grow. Nodes without edges are absent; null ends are no nodes; an empty table gives an empty
    table.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u > v").distinct()
    e = staged(_contracted(e), name)
    was = state(e)
    while was[0]:
        near = both(e)
        least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
        large = near.join(least, F.col("u") == F.col("_u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large, name)
        least = large.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("_u")).select("u", "v", "m")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionAll(small.select("u", F.col("m").alias("v"))).distinct()
        e = staged(small, name)
        now = state(e)
        if now == was:
            break
        was = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
