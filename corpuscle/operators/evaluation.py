"""Ordering quality against graded labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscle.functions.text import stem

from .ordering import running

#: Labels have few grades; what is counted per grade refuses more than this.
MOST_GRADES = 1000


def average_ranks(df: DataFrame, col: str, out: str) -> DataFrame:
    """Ranks, highest first, ties at their mean. Counts per value are summed up, so that equal
    values meet in one row before anything is ordered."""
    counts = df.groupBy(F.col(col).alias("_v")).agg(F.count("*").alias("_n"))
    ranks = running(counts, [F.desc("_v")], "_n", "_above").select("_v", (F.col("_above") + (F.col("_n") + 1) / 2.0).alias(out))
    return df.join(ranks, F.col(col) == F.col("_v")).drop("_v")


def spearman(df: DataFrame, a: str = "score", b: str = "grade") -> DataFrame:
    """One row: rho, the correlation of average ranks; 0 if one side is constant."""
    r = average_ranks(average_ranks(df, a, "_ra"), b, "_rb")
    c = F.corr("_ra", "_rb")
    return r.agg(F.when(c.isNull() | F.isnan(c), 0.0).otherwise(c).alias("rho"))


def _grades(cells: DataFrame, col: str) -> DataFrame:
    """The distinct grades, broadcast; ValueError if they are more than MOST_GRADES."""
    grades = cells.select(F.col(col).alias("g")).distinct()
    if grades.limit(MOST_GRADES + 1).count() > MOST_GRADES:
        raise ValueError(f"more than {MOST_GRADES} distinct grades")
    return F.broadcast(grades)


def kendall(df: DataFrame, a: str = "score", b: str = "grade") -> DataFrame:
    """One row: tau_b. Pairs are counted between the distinct (a, b) values with their
    multiplicities, not between rows."""
    cells = df.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("n"))
    # concordant pairs: for each value of x, what lies below in both; grades are few
    grid = cells.groupBy("x").agg(F.collect_list(F.struct("y", "n")).alias("c")).crossJoin(_grades(cells, "y"))
    here = F.aggregate(F.filter("c", lambda e: e["y"] == F.col("g")), F.lit(0).cast("long"), lambda s, e: s + e["n"])
    lower = F.aggregate(F.filter("c", lambda e: e["y"] < F.col("g")), F.lit(0).cast("long"), lambda s, e: s + e["n"])
    upper = F.aggregate(F.filter("c", lambda e: e["y"] > F.col("g")), F.lit(0).cast("long"), lambda s, e: s + e["n"])
    g = grid.select("x", "g", here.alias("here"), lower.alias("lower"), upper.alias("upper"))
    seen = W.partitionBy("g").orderBy("x").rowsBetween(W.unboundedPreceding, -1)
    g = g.withColumns({"below": F.coalesce(F.sum("lower").over(seen), F.lit(0)), "over": F.coalesce(F.sum("upper").over(seen), F.lit(0))})
    parts = g.agg(F.sum(F.col("here") * F.col("below")).alias("con"), F.sum(F.col("here") * F.col("over")).alias("dis"))
    two = lambda n: n * (n - 1) / 2
    n = df.agg(F.count("*").alias("n"))
    tx = df.groupBy(a).count().agg(F.sum(two(F.col("count"))).alias("tx"))
    ty = df.groupBy(b).count().agg(F.sum(two(F.col("count"))).alias("ty"))
    row = parts.crossJoin(n).crossJoin(tx).crossJoin(ty)  # one row each
    d = F.sqrt((two(F.col("n")) - F.col("tx")) * (two(F.col("n")) - F.col("ty")))
    return row.select(F.coalesce(F.try_divide(F.col("con") - F.col("dis"), d), F.lit(0.0)).alias("tau_b"))


def ndcg(df: DataFrame, k: int | None = None, score: str = "score", grade: str = "grade", tie: str = "name") -> DataFrame:
    """One row: ndcg at k (all if none). The gain of a grade is 2^grade - 1."""
    def dcg(order: list, out: str) -> DataFrame:
        # k rows at most in one window, all rows over range partitions
        top = df.orderBy(*order).limit(k).withColumn("_p", F.row_number().over(W.orderBy(*order))) if k else running(df, order, out="_b").withColumn("_p", F.col("_b") + 1)
        return top.select((F.pow(F.lit(2.0), F.col(grade)) - 1).alias("g"), F.col("_p").alias("p")).agg(F.coalesce(F.sum(F.col("g") / F.log2(F.col("p") + 1.0)), F.lit(0.0)).alias(out))

    both = dcg([F.desc(score), tie], "dcg").crossJoin(dcg([F.desc(grade), tie], "ideal"))
    return both.select(F.coalesce(F.try_divide("dcg", "ideal"), F.lit(0.0)).alias("ndcg"))


def separation(df: DataFrame, least: int = 1) -> DataFrame:
    """One row: the lowest score in the field minus the highest outside; null if one is empty."""
    inside = F.col("grade") >= least
    return df.agg((F.min(F.when(inside, F.col("score"))) - F.max(F.when(~inside, F.col("score")))).alias("separation"))


def inversions(df: DataFrame) -> DataFrame:
    """One row: pairs in which the higher grade has the lower score. Counted per grade from
    running sums over distinct scores; no pair is made."""
    cells = df.groupBy("score", "grade").agg(F.count("*").alias("n"))
    by_score = cells.groupBy("score").agg(F.collect_list(F.struct("grade", "n")).alias("c"))
    g = by_score.crossJoin(_grades(cells, "grade"))
    of = lambda keep: F.aggregate(F.filter("c", keep), F.lit(0).cast("long"), lambda s, e: s + e["n"])
    g = g.select("score", "g", of(lambda e: e["grade"] == F.col("g")).alias("here"), of(lambda e: e["grade"] < F.col("g")).alias("lower"))
    over = F.coalesce(F.sum("lower").over(W.partitionBy("g").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return g.withColumn("over", over).agg(F.sum(F.col("here") * F.col("over")).cast("long").alias("inversions"))


def precision_at(df: DataFrame, k: int = 5, least: int = 3, tie: str = "name") -> DataFrame:
    top = df.orderBy(F.desc("score"), tie).limit(k)
    return top.agg(F.avg((F.col("grade") >= least).cast("double")).alias("precision"))


def by_tier(df: DataFrame, tie: str = "name") -> DataFrame:
    """n, mean, min, max of scores and the best and worst position of each grade."""
    placed = running(df, [F.desc("score"), tie], out="_b").withColumn("pos", F.col("_b") + 1)
    return placed.groupBy("grade").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.min("pos").cast("long").alias("best_pos"), F.max("pos").cast("long").alias("worst_pos"))


def compare(old: DataFrame, new: DataFrame, lower_better: tuple[str, ...] = ("n_inversions",)) -> DataFrame:
    """(metric, value) tables of two runs: delta and whether it is a regression."""
    d = F.col("new_value") - F.col("old_value")
    both = old.select("metric", F.col("value").alias("old_value")).join(new.select("metric", F.col("value").alias("new_value")), "metric")
    return both.select("metric", "old_value", "new_value", d.alias("delta"), F.when(F.col("metric").isin(*lower_better), d > 0).otherwise(d < 0).alias("worse"))


def thresholds(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """(metric, value) against (metric, least): passed; metrics that the run lacks are left out."""
    return metrics.join(limits, "metric").select("metric", "value", "least", (F.col("value") >= F.col("least")).alias("passed"))


#: The metrics of one run, in the order in which they are reported.
METRICS = ("n_labelled", "n_unlabelled", "spearman", "kendall_tau", "ndcg_at_3", "ndcg_at_5", "ndcg_at_10", "ndcg_all", "precision_at_5_qualified", "precision_at_5_relevant", "separation", "n_inversions")


def labelled(ranking: DataFrame, grades: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ranking: (path, rank, score); grades: (name, grade). The candidates with a label, met on the
    file name without suffix: (name, rank, score, grade), and the others: (name, rank, score)."""
    named = ranking.select(stem(F.col("path")).alias("name"), "rank", "score")
    of = grades.select("name", "grade").dropDuplicates(["name"])
    return named.join(of, "name"), named.join(of, "name", "left_anti")


def evaluate(ranking: DataFrame, grades: DataFrame) -> DataFrame:
    """One row with METRICS of a ranking against labels; the order is that of the ranks, as ties of
    scores were broken there. ValueError with fewer than three labelled candidates."""
    with_label, without = labelled(ranking, grades)
    known = with_label.withColumn("grade", F.col("grade").cast("double"))
    if known.limit(3).count() < 3:
        raise ValueError("fewer than 3 labelled candidates: the labels' names must be the files' names")
    # positions by rank: a score that falls as the rank grows
    placed = known.withColumn("_score", F.col("score")).withColumn("score", -F.col("rank").cast("double"))
    by_score = placed.withColumn("score", F.col("_score"))
    one = spearman(by_score).select(F.col("rho").alias("spearman"))
    parts = [kendall(by_score).toDF("kendall_tau"), *(ndcg(placed, k).toDF(n) for n, k in (("ndcg_at_3", 3), ("ndcg_at_5", 5), ("ndcg_at_10", 10), ("ndcg_all", None)))]
    parts += [precision_at(placed, 5, 3).toDF("precision_at_5_qualified"), precision_at(placed, 5, 2).toDF("precision_at_5_relevant"), separation(by_score), inversions(by_score).toDF("n_inversions")]
    parts += [known.agg(F.count("*").alias("n_labelled")), without.agg(F.count("*").alias("n_unlabelled"))]
    for p in parts:
        one = one.crossJoin(p)  # one row each
    return one.select(*METRICS)


def verdict(metrics: DataFrame, limits: dict[str, float]) -> DataFrame:
    """One row: passed (every limit that names a metric is met), failed (names of those that are not)."""
    known = {k: v for k, v in limits.items() if k in metrics.columns}
    below = F.array_compact(F.array(*[F.when(F.col(k) < v, F.lit(k)) for k, v in known.items()])) if known else F.array().cast("array<string>")
    return metrics.select((F.size(below) == 0).alias("passed"), below.alias("failed"))
