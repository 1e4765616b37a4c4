"""Ranking quality and evaluation roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranking(ranked: DataFrame, grades: DataFrame, k: int) -> DataFrame:
    """Recall, reciprocal rank and NDCG at k for each query of ``query, id, rank`` against ``query, id, grade``."""
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    relevant = grades.where("grade > 0")
    ideal = relevant.withColumn("i", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("grade"), "id")))
    best = ideal.groupBy("query").agg(F.count("*").alias("relevant"), F.sum(F.when(F.col("i") <= k, gain / F.log2(F.col("i") + 1))).alias("ideal"))
    hit = ranked.where(F.col("rank") <= k).join(relevant, ["query", "id"])
    got = hit.groupBy("query").agg(F.countDistinct("id").alias("hits"), F.min("rank").alias("first"), F.sum(gain / F.log2(F.col("rank") + 1)).alias("dcg"))
    rows = best.join(got, "query", "left")
    part = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return rows.select("query", part(F.col("hits") / F.col("relevant")).alias("recall"), part(1 / F.col("first")).alias("mrr"), part(F.col("dcg") / F.col("ideal")).alias("ndcg"))


def accuracy_lift(answers: DataFrame, by: str, *, strict: bool = False) -> DataFrame:
    """Accuracy with and without evidence by group, and the lift, over questions that have both answers.

    A strict reading fails on a question that lacks one of the two.
    """
    both = answers.groupBy("question", by).agg(F.max(F.when(F.col("variant") == "evidence", F.col("correct").cast("int"))).alias("e"), F.max(F.when(F.col("variant") == "none", F.col("correct").cast("int"))).alias("n"))
    if strict:
        both = both.withColumn("e", F.when(F.col("e").isNull() | F.col("n").isNull(), F.raise_error(F.concat(F.lit("incomplete question "), F.col("question").cast("string"))).cast("int")).otherwise(F.col("e")))
    else:
        both = both.where("e is not null and n is not null")
    return both.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg("e"), 6).alias("accuracy"), F.round(F.avg("e") - F.avg("n"), 6).alias("lift"))


def nearest_rank(rows: DataFrame, by: str, value: str, share: float = 0.95) -> DataFrame:
    """The nearest-rank percentile and the median."""
    return rows.groupBy(by).agg(F.expr(f"percentile_disc({share}) within group (order by {value})").alias("p95"), F.round(F.median(value), 6).alias("median"))


def points(results: DataFrame) -> DataFrame:
    """Points by kind: full, half and none; percent of those that are graded, and how many wait."""
    worth = F.when(F.col("grade") == "full", 1.0).when(F.col("grade") == "half", 0.5).when(F.col("grade") == "none", 0.0)
    return results.groupBy("kind").agg(F.round(F.coalesce(F.sum(worth), F.lit(0.0)), 6).alias("points"), F.count(worth).alias("graded"), F.count_if(F.col("grade").isNull()).alias("pending"), F.round(F.try_divide(100 * F.sum(worth), F.count(worth)), 6).alias("percent"))
