"""Sharding by balanced label propagation.

Documents are linked when their texts are equal (they share a group). A start shard comes from
a hash; in every round each group looks at where its members are and they move to the shard
that has most of them among those with room, as far as its quota allows; once one is full the
next takes the rest, until no move is possible. The state is one row per (group, shard) with a
count, so a group that holds a third of all rows is at most ``shards`` rows. At last linked
documents keep their shard up to its exact quota, and all others fill the shards, so that row
counts differ by one at most (law ``rows``). All ranks are taken in salted runs with offsets
added, never over one key in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged

RUN = 50_000


def ranked(df: DataFrame, keys: list[str], order: list[str], out: str, rows: int) -> DataFrame:
    """Adds ``out``: 0-based rank within ``keys``, gapless, over runs of about RUN rows each:
    a rank within each salted run plus the rows of the runs before it."""
    runs = max(1, -(-rows // RUN))
    df = df.withColumn("_run", F.pmod(F.xxhash64(*order, F.lit(7)), F.lit(runs)).cast("int"))
    sizes = df.groupBy(*keys, "_run").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    ahead = sizes.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_run").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    within = F.row_number().over(W.partitionBy(*keys, "_run").orderBy(*order)) - 1
    same = F.col("_run") == F.col("_r")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.withColumn("_in", within).join(ahead, same).withColumn(out, (F.col("_in") + F.col("_ahead")).cast("long")).drop("_in", "_ahead", "_run", "_r", *[f"_{k}" for k in keys])


def propagate(cells: DataFrame, quotas: list[int], rounds: int | None = None) -> DataFrame:
    """cells: (g, shard, n) counts of linked documents. Each group's members move to the shard
    that has most of them among those with room, smallest cells first, each shard's room given
    out in a seeded order of groups and never beyond its quota. A move is made if the sum of
    n * n over the group's cells grows by it, so that rounds end: when nobody can move, or after
    ``rounds``."""
    was, t = None, 0
    while rounds is None or t < rounds:
        # as many rows as there are shards
        state = cells.groupBy("shard").agg(F.sum("n").alias("load"), F.count("*").alias("cells"), F.sum((F.col("n") * F.col("n")).cast("decimal(38,0)")).alias("squares")).collect()
        now = sum(r["squares"] for r in state)
        if now == was:
            break
        loads = {r["shard"]: r["load"] for r in state}
        room = {s: quota - loads.get(s, 0) for s, quota in enumerate(quotas) if quota > loads.get(s, 0)}
        if not room:
            break
        # a tie goes to the shard that a hash of group and shard prefers
        most = F.max(F.struct("n", F.xxhash64("g", "shard").alias("h"), "shard"))
        best = cells.where(F.col("shard").isin(*room)).groupBy("g").agg(most.alias("b")).select(F.col("g").alias("_g"), F.col("b.shard").alias("best"), F.col("b.n").alias("there"))
        wish = cells.join(best, F.col("g") == F.col("_g"), "left").drop("_g")
        asks = F.coalesce(F.col("best") != F.col("shard"), F.lit(False))
        runs = max(1, -(-sum(r["cells"] for r in state) // RUN))
        asked = wish.where(asks).withColumn("run", F.pmod(F.xxhash64("g", F.lit(t)), F.lit(runs)).cast("int"))
        sums = asked.groupBy("best", "run").agg(F.sum("n").alias("_n"))
        before = W.partitionBy("best").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
        ahead = sums.select(F.col("best").alias("_best"), F.col("run").alias("_run"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("ahead"))
        within = W.partitionBy("best", "run").orderBy(F.xxhash64("g", F.lit(t), F.lit(1)), "g", "n", "shard").rowsBetween(W.unboundedPreceding, -1)
        asked = asked.withColumn("since", F.coalesce(F.sum("n").over(within), F.lit(0))).join(ahead, (F.col("best") == F.col("_best")) & (F.col("run") == F.col("_run")))
        free = F.element_at(F.create_map(*[F.lit(x) for kv in room.items() for x in kv]), F.col("best"))
        go = F.greatest(F.least(F.col("n"), free - F.col("since") - F.col("ahead")), F.lit(0))
        asked = asked.withColumn("go", F.when(go > F.col("n") - F.col("there"), go).otherwise(0).cast("long"))
        moved = wish.where(~asks).select("g", "shard", "n").unionAll(asked.select("g", "shard", (F.col("n") - F.col("go")).alias("n"))).unionAll(asked.where("go > 0").select("g", F.col("best").alias("shard"), F.col("go").alias("n")))
        cells = staged(moved.where("n > 0").groupBy("g", "shard").agg(F.sum("n").alias("n")), "shards")
        was, t = now, t + 1
    return cells


def shard_documents(docs: DataFrame, shards: int = 16, rounds: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size (UTF-8 bytes plus 1), text_crc32, law 'rows', shard, slot
    (0.. within the shard), grown_shard (null under this law).

    Null texts count as empty and, like all equal texts, form a group. Null or repeated ids and
    repeated rows each take a slot of their own; rows equal in id and text are interchangeable.
    Row counts of any two shards differ by one at most. Texts of any length are one row; other
    columns are ignored, whatever their names. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text)).alias("g"))
    rows = staged(rows, "shard-rows")
    n = rows.count()
    floor, extra = divmod(n, shards)
    quotas = [floor + (s < extra) for s in range(shards)]
    order = ["doc_id", "g"]
    linked = rows.groupBy("g").agg(F.count("*").alias("group_rows")).where("group_rows > 1").select("g", F.lit(True).alias("linked"))
    rows = staged(rows.join(linked, "g", "left").withColumn("linked", F.coalesce("linked", F.lit(False))), "shard-linked")
    in_groups = staged(ranked(rows.where("linked"), ["g"], order, "nth", n), "shard-nth")
    cells = in_groups.groupBy("g", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(shards)).cast("int").alias("shard")).agg(F.count("*").alias("n"))
    cells = propagate(staged(cells, "shards"), quotas, rounds)
    # members of a group take its cells in turn: the first n of them the first cell, and so on
    upto = F.sum("n").over(W.partitionBy("g").orderBy("shard"))
    cuts = cells.select("g", "shard", upto.alias("upto"), (upto - F.col("n")).alias("since")).withColumnRenamed("g", "_g")
    placed = in_groups.join(cuts, (F.col("g") == F.col("_g")) & (F.col("nth") >= F.col("since")) & (F.col("nth") < F.col("upto"))).drop("_g", "since", "upto", "nth")
    placed = staged(ranked(placed, ["shard"], order, "slot", n), "shard-placed")
    most = F.lit(floor) + (F.col("shard") < extra).cast("int")
    keep = placed.where(F.col("slot") < most)
    loads = {r["shard"]: r["n"] for r in keep.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # one row a shard
    spare = rows.where("not linked").select("doc_id", "size", "text_crc32", "g").unionAll(placed.where(F.col("slot") >= most).select("doc_id", "size", "text_crc32", "g"))
    spare = ranked(spare.withColumn("all", F.lit(0)), ["all"], order, "nth", n)
    since, shard_of, slot_of = 0, F.lit(None).cast("int"), F.lit(None).cast("long")
    for s in range(shards):
        have = loads.get(s, 0)
        free = floor + (s < extra) - have
        here = (F.col("nth") >= since) & (F.col("nth") < since + free)
        shard_of, slot_of = F.when(here, s).otherwise(shard_of), F.when(here, F.col("nth") - since + have).otherwise(slot_of)
        since += free
    spare = spare.withColumn("shard", shard_of.cast("int")).withColumn("slot", slot_of.cast("long"))
    cols = ["doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")]
    return keep.select(*cols).unionAll(spare.select(*cols))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
