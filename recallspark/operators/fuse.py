"""Putting ranked lists together: reciprocal ranks, floors, pools."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The constant under the ranks, and the least score that counts as relevant.
RRF_K, FLOOR = 60, 0.22


def rrf(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """Fuses ``list, rank, id``: an id counts once a list, at its first place among the distinct ids.

    Equal sums keep the order of first appearance, by list and then by place.
    """
    once = lists.groupBy("list", "id").agg(F.min("rank").alias("rank"))
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy("list").orderBy("rank", "id")))
    return placed.groupBy("id").agg(F.sum(1.0 / (k + F.col("place"))).alias("rrf"), F.min(F.struct("list", "place")).alias("first"))


def normal(score: Column) -> Column:
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))


def floored(scored: DataFrame, floor: float = FLOOR) -> DataFrame:
    """How many scores reach the floor, and the best of those that do not."""
    s = normal(F.col("score"))
    return scored.agg(F.count_if(s >= floor).alias("kept"), F.max(F.when(s < floor, s)).alias("best_below"))


def pool(scored: DataFrame, size: int = 15, lexical: int = 5) -> DataFrame:
    """The best few by lexical rank first, then by score, each id once; ``pool_pos`` is their order."""
    by_words = F.row_number().over(Window.orderBy(F.desc_nulls_last("lexical"), "id"))
    reserved = scored.where("lexical > 0").withColumn("_w", by_words).where(F.col("_w") <= lexical)
    rest = scored.join(reserved.select("id"), "id", "left_anti").withColumn("_s", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    both = reserved.select("id", F.lit(0).alias("_c"), F.col("_w").alias("_p")).unionByName(rest.where(F.col("_s") <= size).select("id", F.lit(1).alias("_c"), F.col("_s").alias("_p")))
    placed = both.withColumn("pool_pos", F.row_number().over(Window.orderBy("_c", "_p"))).where(F.col("pool_pos") <= size).select("id", "pool_pos")
    return scored.join(placed, "id")


def skips_rerank(pooled: DataFrame, gap: float = 0.15) -> DataFrame:
    """Whether reranking may be left out: one candidate, or a clear gap between the best two."""
    top = pooled.orderBy(F.desc("score")).limit(2).agg(F.count("*").alias("n"), F.max("score").alias("a"), F.min("score").alias("b"))
    return top.select(((F.col("n") <= 1) | (F.col("a") - F.col("b") >= gap)).alias("skip"))


def expanded(original: DataFrame, found: Sequence[DataFrame]) -> DataFrame:
    """``id, score, rrf, first, original``: the order of the first query fused with those of its sub-queries.

    Each list has ``id, score`` and is cut to its limit before; an id keeps its best score, and only ids of
    the first list may be reserved a place by their words.
    """
    placed = [rows.select(F.lit(n).alias("list"), "id", "score", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank")) for n, rows in enumerate([original, *found])]
    lists = reduce(DataFrame.unionByName, placed)
    best = lists.groupBy("id").agg(F.max("score").alias("score"), F.bool_or(F.col("list") == 0).alias("original"))
    return best.join(rrf(lists.select("list", "rank", "id")), "id")


def reranked(fused: DataFrame, size: int = 15, rerank: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The best few of a fused list with their ``place``.

    ``rerank`` may give these few another order: it gets them and returns ``id, place``. Ids that it invents
    are dropped, those that it leaves out go behind, in the order they had.
    """
    cut = fused.orderBy(F.desc("rrf"), "first").limit(size)
    rows = cut.withColumn("place", F.row_number().over(Window.orderBy(F.desc("rrf"), "first")))
    if rerank is None:
        return rows
    told = rerank(rows).groupBy("id").agg(F.min("place").alias("told"))
    return rows.join(told, "id", "left").withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("told"), "place"))).drop("told")
