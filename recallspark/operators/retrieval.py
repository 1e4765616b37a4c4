"""Hybrid retrieval: channels of candidates, merged, capped, hydrated, scored and pooled.

Every channel is bounded by its own limit before it meets another, so all after the scans works on some
hundreds of rows; the scans read the columns they need and keep the best rows task by task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallspark.functions import calendar
from recallspark.operators import fuse, lexical, vector
from recallspark.session import written

#: Weights of the score's parts.
WEIGHTS = {"thought": 0.42, "community": 0.25, "entity": 0.10, "centrality": 0.08, "specificity": 0.05, "salience": 0.04, "recency": 0.06, "temporal": 0.18}

#: Rows that channels, merge and pool hold at most.
VECTOR_K, LEXICAL_K, COMMUNITY_K, ENTITY_K, SEEDS, PER_SEED, MERGED, POOL, TEMPORAL_K = 30, 20, 12, 32, 10, 2, 80, 15, 100

#: Channels in the order in which their candidates came up.
CHANNELS = ("vector", "lexical", "bundle", "entity", "neighbor", "temporal")


@dataclass
class Memory:
    """Tables that retrieval reads.

    ``notes``: id, vec, text, active, salience, centrality, specificity, recency, communities (array).
    ``communities``: community_id, vec, thought_ids (array). ``entities``: entity_id, vec, thought_ids.
    ``neighbors``: thought_id, neighbor_id, weight. ``temporal``: id, temporal (a score).
    """

    notes: DataFrame
    communities: DataFrame
    entities: DataFrame
    neighbors: DataFrame
    temporal: DataFrame


def _listed(rows: DataFrame, order: list[Column]) -> DataFrame:
    return rows.withColumn("pos", F.row_number().over(Window.orderBy(*order)))


def candidates(m: Memory, query: Sequence[float], words: Sequence[str], entity_distance: float = 0.48) -> DataFrame:
    """``id, channel, pos, distance, rank, community_distance, entity_distance, temporal``: one row a find."""
    active = m.notes.where("active")
    near = _listed(vector.top_k(active, "id", "vec", list(query), VECTOR_K), [F.asc("distance"), F.asc("id")])
    told = _listed(lexical.search(active, words, LEXICAL_K), [F.desc("raw"), F.asc("id")])
    comm = vector.top_k(m.communities, "community_id", "vec", list(query), COMMUNITY_K)
    bundle = m.communities.join(comm, "community_id").select("community_id", "distance", F.posexplode("thought_ids").alias("i", "id"))
    ents = vector.top_k(m.entities, "entity_id", "vec", list(query), ENTITY_K).where(F.col("distance") < entity_distance)
    tops = m.entities.join(ents, "entity_id").select("entity_id", "distance", F.posexplode(F.slice("thought_ids", 1, 5)).alias("i", "id"))
    seeds = near.where(F.col("pos") <= SEEDS).select(F.col("id").alias("thought_id"))
    # The limit on all neighbours comes before the limit on each seed's.
    links = m.neighbors.join(seeds, "thought_id", "left_semi").orderBy(F.desc("weight"), "neighbor_id", "thought_id").limit(SEEDS * 4)
    links = links.withColumn("k", F.row_number().over(Window.partitionBy("thought_id").orderBy(F.desc("weight"), "neighbor_id"))).where(F.col("k") <= PER_SEED)
    none = lambda n: F.lit(None).cast("double").alias(n)

    def rows(df: DataFrame, channel: str, **values: Column) -> DataFrame:
        kinds = ("distance", "rank", "community_distance", "entity_distance", "temporal")
        return df.select("id", F.lit(CHANNELS.index(channel)).alias("channel"), "pos", *[values[k].cast("double").alias(k) if k in values else none(k) for k in kinds])

    found = [
        rows(near, "vector", distance=F.col("distance")),
        rows(told, "lexical", rank=F.col("rank")),
        rows(_listed(bundle, [F.asc("distance"), F.asc("community_id"), F.asc("i")]), "bundle", community_distance=F.col("distance")),
        rows(_listed(tops, [F.asc("distance"), F.asc("entity_id"), F.asc("i")]), "entity", entity_distance=F.col("distance")),
        rows(_listed(links, [F.desc("weight"), F.asc("neighbor_id"), F.asc("thought_id")]).withColumn("id", F.col("neighbor_id")), "neighbor"),
        rows(_listed(m.temporal.orderBy(F.desc("temporal"), "id").limit(TEMPORAL_K), [F.desc("temporal"), F.asc("id")]), "temporal", temporal=F.col("temporal")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def merged(found: DataFrame, most: int = MERGED) -> DataFrame:
    """One row an id: least distances, best rank, set of channels; then lexical, vector and other finds, cut."""
    one = found.groupBy("id").agg(
        F.min("distance").alias("distance"), F.max("rank").alias("rank"), F.min("community_distance").alias("community_distance"), F.min("entity_distance").alias("entity_distance"),
        F.max("temporal").alias("temporal"), F.sort_array(F.collect_set("channel")).alias("channels"), F.min(F.struct("channel", "pos")).alias("first"),
    )
    kind = F.when(F.col("rank").isNotNull(), 0).when(F.col("distance").isNotNull(), 1).otherwise(2)
    order = Window.orderBy(kind, F.when(kind == 0, -F.col("rank")).when(kind == 1, F.col("distance")), F.when(kind == 2, F.col("first.channel")), F.when(kind == 2, F.col("first.pos")), "id")
    return one.withColumn("merge_pos", F.row_number().over(order)).where(F.col("merge_pos") <= most)


def scored(rows: DataFrame, notes: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Hydrates (ids that are no active note vanish) and scores."""
    w = WEIGHTS | (weights or {})
    features = notes.where("active").select("id", "salience", "centrality", "specificity", "recency", "communities")
    # At most MERGED rows, read several times below: written once, so that no channel is searched again.
    h = written(rows.join(features, "id"), "candidates")
    has = lambda name: F.array_contains("channels", CHANNELS.index(name))
    sim = lambda c: F.coalesce(vector.similarity(F.col(c)), F.lit(0.0))
    thought = F.when(F.col("distance").isNotNull() | (F.col("rank") > 0), F.greatest(vector.similarity(F.col("distance")), F.when(F.col("rank") > 0, F.col("rank")))).when(has("lexical"), 0.35).otherwise(0.2)
    direct = F.when(has("lexical") | has("vector"), 1.0).otherwise(0.0)
    crowd = h.select("id", F.explode(F.array_distinct("communities")).alias("c"))
    crowded = crowd.groupBy("c").agg(F.count("*").alias("n")).where("n > 2").select("c")
    many = crowd.join(crowded, "c").groupBy("id").agg(F.count("*").alias("crowds"))
    h = h.join(many, "id", "left")
    redundancy = F.least(F.lit(0.15), F.when(has("bundle"), 0.05).otherwise(0.0) + F.when(F.col("community_distance").isNotNull(), 0.02 * F.coalesce("crowds", F.lit(0))).otherwise(0.0))
    inner = w["community"] * sim("community_distance") + w["entity"] * sim("entity_distance") + w["centrality"] * F.col("centrality") + w["specificity"] * F.col("specificity") + w["salience"] * F.least(F.col("salience") / 5, F.lit(1.0)) + w["recency"] * F.col("recency")
    score = w["thought"] * thought + direct * inner - redundancy + w["temporal"] * F.coalesce("temporal", F.lit(0.0))
    source = F.when(has("bundle"), "bundle").when(has("entity"), "entity").when(has("neighbor"), "neighbor").when(has("temporal"), "temporal").otherwise("direct")
    return h.select("id", score.alias("score"), F.col("rank").alias("lexical"), thought.alias("vector_score"), (sim("entity_distance") + 0.5 * F.col("centrality")).alias("graph_score"), redundancy.alias("redundancy"), source.alias("provenance"), "merge_pos")


def search(m: Memory, query: Sequence[float], words: Sequence[str], *, entity_distance: float = 0.48, top_k: int = 12, weights: dict[str, float] | None = None) -> DataFrame:
    """The pool of ``id, score, vector_score, graph_score, provenance, pool_pos``, best first by place."""
    k = min(max(1, top_k), 100)
    found = scored(merged(candidates(m, query, words, entity_distance)), m.notes, weights)
    return fuse.pool(found, max(POOL, k)).where(F.col("pool_pos") <= max(POOL, k))


def diagnostics(pooled: DataFrame) -> DataFrame:
    """How much of the pool's score comes by meaning and how much by the graph."""
    v, g = F.col("vector_score"), F.col("graph_score")
    share = F.when(v + g <= 1e-12, 0.0).otherwise(v / (v + g))
    top = F.max_by(share, -F.col("pool_pos"))
    return pooled.agg(F.count("*").alias("n"), F.round(F.avg(share), 6).alias("mean_share"), F.round(top, 6).alias("top_share"), F.count_if((v <= 1e-12) & (g > 1e-12)).alias("graph_only"), F.when(F.avg(share) >= 0.5, "semantic").otherwise("graph").alias("primary"))


def temporal_channel(events: DataFrame, query: Sequence[float], *, within: tuple[str, str] | None = None, limit: int = 24) -> DataFrame:
    """``id, temporal``: the events nearest to the query, those of a period alone where one is given; score is one over the rank.

    ``events``: id, vec, start_at, end_at; the period is closed below and open above. One scan, cut to the
    limit (1 to 100) task by task; the window runs over the rows that are left.
    """
    if within is not None:
        events = events.where(calendar.overlaps(F.col("start_at"), F.col("end_at"), calendar.at(within[0]), calendar.at(within[1])))
    top = vector.top_k(events, "id", "vec", list(query), min(max(1, limit), 100))
    return _listed(top, [F.asc("distance"), F.asc("id")]).select("id", (1 / F.col("pos")).alias("temporal"))


def event_seeds(events: DataFrame, queries: Sequence[Sequence[float]], limit: int) -> DataFrame:
    """``id, distance``: the nearest events of the query and of each hint, each at its least distance."""
    found = [vector.top_k(events, "id", "vec", list(q), limit) for q in queries]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.groupBy("id").agg(F.min("distance").alias("distance"))
