"""All nightly jobs as one chain, each on the tables that the ones before made.

Salience, ontology, types, merging of duplicate entities, repair of relations, detection of communities,
which summaries are due, bundles, and what is kept ready for retrieval. Tables that several later jobs read
are written, so that a lost executor costs one job's tasks and no job is done twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallspark.operators import community, links as op
from recallspark.operators.graph import among
from recallspark.operators.timeline import merged_projects
from recallspark.session import written


def merges(entities: DataFrame, newest: int = 200, distance: float = 0.08) -> DataFrame:
    """``old_id, new_id`` of the entities to merge; one that goes into another that goes on itself follows it.

    At most ``newest`` pairs, so their chains are followed on the driver.
    """
    into = {r["drop"]: r["keep"] for r in community.duplicates(entities, newest, distance).collect()}

    def end(i: int) -> int:
        while i in into:
            i = into[i]
        return i

    return entities.sparkSession.createDataFrame([(i, end(i)) for i in into], "old_id long, new_id long")


def repointed(edges: DataFrame, entities: DataFrame, gone: DataFrame) -> DataFrame:
    """``a, b, weight``: edges moved to the entities that others went into, added up; no loops, no missing ends."""
    one = lambda df, c: df.join(F.broadcast(gone.select(F.col("old_id").alias(c), F.col("new_id").alias("_to"))), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    moved = one(one(edges.select("a", "b", F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("weight")), "a"), "b")
    both = moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight")
    return among(both, entities).groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def detected(entities: DataFrame, edges: DataFrame, levels: int = 3) -> DataFrame:
    """``community_id, parent_id, level, entity_id``: each owner's communities, coarsest at level 0.

    An id is owner, level and least member, so a community of the same members has the same id every night.
    """
    owner = entities.select("tenant", F.col("id").alias("node"))
    owned = edges.join(owner.select(F.col("node").alias("a"), "tenant"), "a").join(owner.select(F.col("node").alias("b"), F.col("tenant").alias("other")), "b").where("tenant = other").drop("other")
    found = written(community.louvain(owner, owned, levels), "communities")
    name = F.concat_ws(":", F.col("tenant").cast("string"), F.col("level").cast("string"), F.col("community").cast("string"))
    rows = found.select("tenant", "level", "node", name.alias("community_id"))
    above = rows.select("tenant", (F.col("level") + 1).alias("level"), "node", F.col("community_id").alias("parent_id"))
    return rows.join(above, ["tenant", "level", "node"], "left").select("community_id", "parent_id", "level", F.col("node").alias("entity_id"))


def changed(members: DataFrame, before: DataFrame) -> DataFrame:
    """``community_id`` of communities that last night's (``before``: community_id, entity_id) did not have with these members."""
    now, then = (op.signatures(df.select("community_id", "entity_id")) for df in (members, before))
    return now.join(then, ["community_id", "signature"], "left_anti").select("community_id")


def nightly(thoughts: DataFrame, entities: DataFrame, kinds: DataFrame, links: DataFrame, edges: DataFrame, now: str, before: DataFrame, summaries: DataFrame, *, exempt: tuple[str, ...] = (), newest: int = 200, distance: float = 0.08, due: int = 50) -> dict[str, DataFrame]:
    """The tables after one night.

    ``entities``: id, tenant, entity_type, created_at, project, vec; ``links``: thought_id, entity_id, salience;
    ``edges``: a, b, weight (null: 1), both ways alike; ``before``: last night's members (community_id,
    entity_id); ``summaries``: community_id, generated_at. A community is due for a summary if it has none, or
    if its members changed this night and the summary is older.
    """
    fresh = written(op.risen(op.decayed(thoughts, now, exempt=exempt), now), "thoughts")
    kept = kinds.join(op.unused_kinds(kinds, entities).select("kind"), "kind", "left_anti")
    typed = written(op.repaired_types(entities, kept), "entities")
    gone = written(merges(typed, newest, distance), "merges")
    single = typed.join(F.broadcast(gone.select(F.col("old_id").alias("id"))), "id", "left_anti")
    linked = written(merged_projects(links, gone), "links")
    relations = written(repointed(edges, single, gone), "relations")
    members = written(detected(single, relations), "members")
    pairs = members.select("community_id", "entity_id")
    dirty = changed(members, before).withColumn("dirty_at", F.lit(now).cast("timestamp_ntz"))
    communities = members.select("community_id", "parent_id").distinct()
    pending = op.pending_summaries(communities.select("community_id").join(dirty, "community_id", "left"), pairs, linked, summaries, due)
    bundled = op.bundles(communities, op.community_thoughts(linked, pairs, fresh), pairs)
    return {"thoughts": fresh, "kinds": kept, "entities": single, "merges": gone, "links": linked, "relations": relations, "members": members, "pending": pending, "bundles": bundled, "top_thoughts": op.top_thoughts(linked, fresh, now), "features": op.retrieval_features(fresh, linked, pairs, relations, now)}
