"""A graph kept as a log of changes, read by merging: upserts, and deletions that take a node's edges along.

The log has ``seq`` (unique, later wins), ``op``, ``source``, ``target``, ``predicate``, ``props``:

* ``node``: the node ``source`` is there, with ``props``; ``drop_node`` takes it and all its edges away.
* ``mention``: the edge from ``source`` to ``target`` is there, and so are both its ends, made where they are not.
* ``relate``: the same for an edge by ``predicate`` between nodes that are there, else nothing; its weight is
  the number of times it was put.
* ``drop_edge`` takes an edge away; put again, it counts from one.

A change stands until something later undoes it, so each node and edge needs its last deletion and what came
after, and no order of the whole log. Changes that ask for what is not there do nothing. Rows with a null
``source``, or an edge's with a null ``target``, do nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG = "seq long, op string, source string, target string, predicate string, props string"


def nodes(log: DataFrame) -> DataFrame:
    """``id, props, born``: nodes that are there, with the props put last since they are, and when they came to be."""
    touched = log.where("op in ('node', 'drop_node')").select(F.col("source").alias("id"), "seq", "op", "props")
    ends = log.where("op = 'mention' AND source IS NOT NULL AND target IS NOT NULL").select("seq", F.explode(F.array("source", "target")).alias("id"))
    rows = touched.unionByName(ends.select("id", "seq", F.lit("end").alias("op"), F.lit(None).cast("string").alias("props"))).where("id is not null")
    gone = rows.where("op = 'drop_node'").groupBy("id").agg(F.max("seq").alias("gone"))
    alive = rows.where("op <> 'drop_node'").join(gone, "id", "left").where(F.col("gone").isNull() | (F.col("seq") > F.col("gone")))
    return alive.groupBy("id").agg(F.max_by("props", F.when(F.col("op") == "node", F.col("seq"))).alias("props"), F.min("seq").alias("born"))


def edges(log: DataFrame, alive: DataFrame | None = None) -> DataFrame:
    """``source, target, predicate, weight``: edges that are there. Mentions have no predicate and weigh 1."""
    alive = nodes(log) if alive is None else alive
    keys = ["source", "target", "predicate"]
    rows = log.where("op in ('mention', 'relate', 'drop_edge') AND source IS NOT NULL AND target IS NOT NULL").select(*keys, "seq", "op")
    rows = rows.withColumn("predicate", F.when(F.col("op") != "mention", F.col("predicate")))
    last = rows.groupBy(*keys).agg(F.max(F.when(F.col("op") == "drop_edge", F.col("seq"))).alias("gone"))
    # Both ends came to be after their last deletion, and an edge put before that went with them.
    born = lambda end: alive.select(F.col("id").alias(end), F.col("born").alias(f"{end}_born"))
    since = last.join(born("source"), "source").join(born("target"), "target").withColumn("since", F.greatest("source_born", "target_born"))
    since = since.select(*[F.col(k).alias(f"_{k}") for k in keys], "gone", "since")
    same = (F.col("source") == F.col("_source")) & (F.col("target") == F.col("_target")) & F.col("predicate").eqNullSafe(F.col("_predicate"))
    # A mention makes its ends, so it stands from that very change on; a relation needs them from before.
    after = F.when(F.col("op") == "mention", F.col("seq") >= F.col("since")).otherwise(F.col("seq") > F.col("since"))
    stands = rows.where("op <> 'drop_edge'").join(since, same).where(after & (F.col("gone").isNull() | (F.col("seq") > F.col("gone"))))
    n = F.when(F.max("op") == "mention", F.lit(1)).otherwise(F.count("*")).cast("long")
    return stands.groupBy(*keys).agg(n.alias("weight"))


def compacted(log: DataFrame) -> DataFrame:
    """A log that gives the same graph, without what was undone: one row a node, a mention, and a time that a relation was put."""
    alive = nodes(log)
    kept = edges(log, alive)
    first = alive.select(F.lit(0).cast("long").alias("seq"), F.lit("node").alias("op"), F.col("id").alias("source"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("predicate"), "props")
    op = F.when(F.col("predicate").isNull(), "mention").otherwise("relate")
    rest = kept.select(F.explode(F.sequence(F.lit(1).cast("long"), "weight")).alias("seq"), op.alias("op"), "source", "target", "predicate", F.lit(None).cast("string").alias("props"))
    return first.unionByName(rest)
