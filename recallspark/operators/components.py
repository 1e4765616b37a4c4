"""Connected components of a graph too large for one task: alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallspark.session import dropped, packed, written


#: A node with more edges than ``HUB`` is a hub; up to ``SENT`` hubs are sent to every task.
HUB, SENT = 1000, 200_000


def _told(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` (``u, v``) with ``m`` of their ``u``, from ``least`` (``u, m, n``, n the number of its edges).

    A hub's edges would all meet in one task, so hubs are joined where their edges lie. There are at most as
    many as edges over ``HUB``; more than may be sent are left to the join by shuffle.
    """
    hubs = written(packed(least.where(F.col("n") > HUB).select("u", "m")), "hubs")
    many = hubs.count()
    if not 0 < many <= SENT:
        return edges.join(least.select("u", "m"), "u")
    side = F.broadcast(hubs)
    rest = edges.join(side.select("u"), "u", "left_anti").join(least.where(F.col("n") <= HUB).select("u", "m"), "u")
    return edges.join(side, "u").unionByName(rest)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    return _told(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of these neighbours; edges point down."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _told(edges, least).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (the smallest id reachable) of all ids in ``edges`` (``u, v``, longs).

    Each round halves paths at least; it ends when a round changes nothing. Rounds are written to the
    shared folder, so that lineage stays short and a lost executor costs one round at most.
    """
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    now = written(packed(down.distinct()), "stars")
    seen = None
    while True:
        large = written(packed(_large_star(now).distinct()), "stars")
        made = written(packed(_small_star(large).distinct()), "stars")
        dropped(made.sparkSession, large)
        mark = made.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        dropped(made.sparkSession, now)
        now = made
        if mark == seen:
            break
        seen = mark
    found = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("id"), "component").distinct())
