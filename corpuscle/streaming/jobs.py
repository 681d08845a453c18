"""Jobs: eviction, logs and progress; windows over events (an extension)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def kept_jobs(jobs: DataFrame, now: Column, ttl_seconds: int = 3600, most: int = 50) -> DataFrame:
    """jobs: (job_id, created, status). Finished jobs go after their time to live; of the others
    the newest ``most`` stay, running or not."""
    alive = jobs.where(~F.col("status").isin("done", "failed", "cancelled") | (F.unix_timestamp(now) - F.unix_timestamp("created") <= ttl_seconds))
    return alive.orderBy(F.desc("created"), F.desc("job_id")).limit(most)


def log_tail(logs: DataFrame, since: int) -> DataFrame:
    return logs.where(F.col("seq") >= since)


def progress(done: Column, total: Column) -> Column:
    """Percent shown: 10 at the start, 100 at the end."""
    return F.least(F.lit(100), 10 + F.round(F.coalesce(F.try_divide(done, total), F.lit(0.0)) * 90)).cast("int")


def tumbling(events: DataFrame, size: str = "1 hour", late: str | None = None) -> DataFrame:
    """(start, event_type, n, total): batch or stream; ``late`` sets the watermark."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 hours", step: str = "1 hour", late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", size, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap_seconds: int = 1800, late: str | None = None) -> DataFrame:
    """(user_id, start, stop, n) of runs of events less than the gap apart."""
    e = events.withWatermark("ts", late) if late else events
    s = e.groupBy("user_id", F.session_window("ts", f"{gap_seconds} seconds").alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("stop"))
    return s.select("user_id", "start", "stop", "n")


def first_of_each(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events without repeats of their id within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def paragraphs_by_gap(events: DataFrame, gap_seconds: int = 3600) -> DataFrame:
    """Runs of consecutive events per user: (user_id, run, n, start, stop)."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    far = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp")) > gap_seconds * 1_000_000
    e = events.withColumn("run", F.sum(F.coalesce(far.cast("int"), F.lit(0))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return e.groupBy("user_id", "run").agg(F.count("*").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("stop"))


def cancel(spark, group: str) -> None:
    """Stops a job that runs under ``spark.sparkContext.setJobGroup(group, ..., True)``: its stages end
    at once, not only between documents."""
    spark.sparkContext.cancelJobGroup(group)


class Progress:
    """What a streaming screening has done so far: (batches, rows), and its last log lines by offset."""

    def __init__(self, query):
        self.query = query

    def lines(self, since: int = 0) -> list[dict]:
        return [{"seq": p["batchId"], "rows": p["numInputRows"]} for p in self.query.recentProgress if p["batchId"] >= since]

    def rows(self) -> int:
        return sum(p["numInputRows"] for p in self.query.recentProgress)

    def stop(self) -> None:
        self.query.stop()
