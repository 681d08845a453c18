"""Positions and running sums over the order of a whole table, without a task that sorts all rows.

Rows are sorted over range partitions and checkpointed; each task numbers its own rows, and what
the tasks before it hold is added, one number a task.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df`` in ``spark.checkpoint.dir``. Where that is unset, in a folder
    of our own, in local mode only; elsewhere that is an error, as others could not read it."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        held = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not held:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            held = tempfile.mkdtemp(prefix="corpuscle-")
            atexit.register(shutil.rmtree, held, True)
        context.setCheckpointDir(held)
    return df.checkpoint()


def bounded(df: DataFrame, most: int = 50_000) -> DataFrame:
    """``df``, to be broadcast if it has at most ``most`` rows; beyond that the join shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def running(df: DataFrame, order: Sequence[Column | str], value: Column | str | None = None, out: str = "before", last: str | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` (their number if none) over all rows before in ``order``;
    and, with ``last``, ``_last``: that column of the row before. The order should tell all rows
    apart, so that many equal values don't share a partition."""
    value = F.lit(1).cast("long") if value is None else F.col(value) if isinstance(value, str) else value
    s = settled(df.orderBy(*order).withColumns({"_task": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    ends = [F.max_by(F.col(last), "_at").alias("end")] if last else []
    parts = s.groupBy("_task").agg(F.sum(value).alias("total"), *ends).orderBy("_task").collect()  # one row a task
    ahead, total, end, rows = {}, None, None, []
    for p in parts:
        rows.append((p["_task"], total, end))
        total = p["total"] if total is None else total + p["total"]
        end = p["end"] if last else None
    kinds = dict(s.select(value.alias("v"), *([last] if last else [])).dtypes)
    kind = {"int": "bigint"}.get(kinds["v"], kinds["v"])
    ahead = df.sparkSession.createDataFrame(rows, f"_of int, _ahead {kind}, _end {kinds[last] if last else 'int'}")
    w = W.partitionBy("_task").orderBy("_at")
    within = F.coalesce(F.sum(value).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    s = s.withColumn("_in", within)
    if last:
        s = s.withColumn("_lag", F.lag(last).over(w)).withColumn("_nth", F.row_number().over(w))
    s = s.join(F.broadcast(ahead), F.col("_task") == F.col("_of"))
    s = s.withColumn(out, F.col("_in") + F.coalesce("_ahead", F.lit(0)))
    if last:
        s = s.withColumn("_last", F.when(F.col("_nth") == 1, F.col("_end")).otherwise(F.col("_lag")))
    return s.drop("_task", "_at", "_in", "_of", "_ahead", "_end", "_lag", "_nth")
