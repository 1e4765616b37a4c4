"""Graph operators over vertex and edge tables: paths of one or two steps, health and pruning.

Edges are ``source_id, target_id`` with what else they carry; directions are joined by union, so each step
is a hash join on ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallspark.operators.components import components


def comentions(mentions: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Pairs ``a < b`` of entities that one thought mentions, with the number of distinct thoughts.

    Mentions are made distinct first, so that a pair is counted once a thought without a distinct count.
    """
    keys = ["thought_id", *(extra or [])]
    m = mentions.select(*keys, "entity_id").distinct()
    pairs = m.withColumnRenamed("entity_id", "a").join(m.withColumnRenamed("entity_id", "b"), keys).where("a < b")
    return pairs.groupBy("a", "b", *(extra or [])).agg(F.count("*").alias("weight"))


def both_ways(edges: DataFrame, source: str, target: str) -> DataFrame:
    return edges.unionByName(edges.withColumnRenamed(source, "_").withColumnRenamed(target, source).withColumnRenamed("_", target))


def adjacency(edges: DataFrame, source: str = "a", target: str = "b") -> DataFrame:
    """Distinct neighbours both ways, without loops."""
    return both_ways(edges.select(source, target), source, target).where(F.col(source) != F.col(target)).distinct()


def degrees(edges: DataFrame, source: str = "a", target: str = "b") -> DataFrame:
    return both_ways(edges.select(source, target), source, target).groupBy(F.col(source).alias("id")).agg(F.count("*").alias("degree"))


def neighbours(relations: DataFrame, seeds: DataFrame, limit: int) -> DataFrame:
    """Thoughts one undirected relation away from ``seeds`` (``id``): hits and kinds of relation."""
    out = relations.join(seeds, F.col("source_id") == F.col("id"), "left_semi").select(F.col("target_id").alias("id"), "relation_type")
    back = relations.join(seeds, F.col("target_id") == F.col("id"), "left_semi").select(F.col("source_id").alias("id"), "relation_type")
    found = out.unionByName(back).join(seeds, "id", "left_anti")
    return found.groupBy("id").agg(F.count("*").alias("hits"), F.array_join(F.array_sort(F.collect_set("relation_type")), ",").alias("kinds")).orderBy(F.desc("hits"), "id").limit(limit)


def thoughts_of_entities(mentions: DataFrame, edges: DataFrame, seeds: DataFrame, limit: int) -> DataFrame:
    """Thoughts that mention a seed entity, or one related to a seed: hits summed, the nearer way kept."""
    near = adjacency(edges).join(seeds, F.col("a") == F.col("id"), "left_semi").select(F.col("b").alias("entity_id"))
    direct = mentions.join(seeds, F.col("entity_id") == F.col("id"), "left_semi").groupBy("thought_id").agg(F.count("*").alias("hits")).withColumn("way", F.lit(0))
    via = mentions.join(near.groupBy("entity_id").agg(F.count("*").alias("paths")), "entity_id").groupBy("thought_id").agg(F.sum("paths").alias("hits")).withColumn("way", F.lit(1))
    found = direct.unionByName(via).groupBy("thought_id").agg(F.sum("hits").alias("hits"), F.min("way").alias("way"))
    return found.orderBy(F.desc("hits"), "thought_id").limit(limit)


def thoughts_of_events(events: DataFrame, involves: DataFrame, mentions: DataFrame, seeds: DataFrame, limit: int) -> DataFrame:
    """Thoughts in which seed events occur, and those that mention an entity that a seed event involves."""
    occurs = events.join(seeds, "event_id", "left_semi").groupBy("thought_id").agg(F.count("*").alias("hits")).withColumn("way", F.lit(0))
    whose = involves.join(seeds, "event_id", "left_semi").groupBy("entity_id").agg(F.count("*").alias("paths"))
    via = mentions.join(whose, "entity_id").groupBy("thought_id").agg(F.sum("paths").alias("hits")).withColumn("way", F.lit(1))
    return occurs.unionByName(via).groupBy("thought_id").agg(F.sum("hits").alias("hits"), F.min("way").alias("way")).orderBy(F.desc("hits"), "thought_id").limit(limit)


def search_by_tokens(entities: DataFrame, edges: DataFrame, tokens: list[str], limit: int) -> DataFrame:
    """Entities whose label holds query tokens push their count of tokens to themselves and their neighbours."""
    told = [t for t in dict.fromkeys(tokens) if len(t) >= 2][:16]
    hits = sum((F.contains(F.lower("label"), F.lit(t)).cast("long") for t in told), F.lit(0).cast("long"))
    seeds = entities.select("id", hits.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(max(3 * limit, 20))
    pushed = adjacency(edges).join(seeds, F.col("a") == F.col("id")).select(F.col("b").alias("id"), "score")
    return seeds.unionByName(pushed).groupBy("id").agg(F.sum("score").alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges, components, isolated nodes and density, with flags for a graph in poor health."""
    pairs = edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u <> v").distinct()
    found = components(pairs)
    joined = nodes.select("id").distinct().join(found, "id", "left")
    sizes = joined.agg(F.count("*").alias("nodes"), F.count_if(F.col("component").isNull()).alias("isolated"), F.countDistinct("component").alias("linked"))
    rows = sizes.join(pairs.agg(F.count("*").alias("edges")), F.lit(True))
    n = F.col("nodes").cast("double")
    rows = rows.select("nodes", "edges", (F.col("isolated") + F.col("linked")).alias("components"), "isolated", F.round(F.coalesce(F.try_divide(F.col("edges"), n * (n - 1) / 2), F.lit(0.0)), 9).alias("density"))
    share = F.col("isolated") / n
    return rows.withColumns({"sparse": F.col("density") < 0.015, "lonely": share > 0.6, "split": F.col("components") > 6})


def missing_pairs(mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """Co-mentioned pairs that no edge joins, either way."""
    pairs = comentions(mentions)
    there = adjacency(edges)
    return pairs.join(there, ["a", "b"], "left_anti")


def lexical_relation(one: Column, other: Column) -> Column:
    """``part_of`` if the shorter label begins the longer as whole words, ``related_to`` if it lies in it."""
    a, b = F.lower(one), F.lower(other)
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return F.when(F.startswith(long, F.concat(short, F.lit(" "))), "part_of").when(F.contains(long, short), "related_to")


def suspicious(edges: DataFrame, mentions: DataFrame) -> DataFrame:
    """Weak ``related_to`` edges whose ends no thought mentions together."""
    weak = edges.where("predicate = 'related_to' and weight <= 1")
    pairs = comentions(mentions).select(F.col("a").alias("_a"), F.col("b").alias("_b"))
    return weak.join(pairs, (F.least("a", "b") == F.col("_a")) & (F.greatest("a", "b") == F.col("_b")), "left_anti")


def duplicate_support(edges: DataFrame, mentions: DataFrame, texts: DataFrame, least: int = 3, share: float = 0.5) -> DataFrame:
    """Edges whose supporting thoughts are mostly the same text: all pairs in one grouping."""
    m = mentions.select("thought_id", "entity_id").distinct().join(texts, "thought_id")
    pairs = m.select("thought_id", F.col("entity_id").alias("a"), "text_key").join(m.select("thought_id", F.col("entity_id").alias("b")), "thought_id").where("a < b").join(edges.select("a", "b").distinct(), ["a", "b"], "left_semi")
    stats = pairs.groupBy("a", "b").agg(F.countDistinct("thought_id").alias("n"), F.countDistinct("text_key").alias("texts"))
    return stats.where((F.col("n") >= least) & ((F.col("n") - F.col("texts")) / F.col("n") >= share))


def invalid_typed(edges: DataFrame, types: DataFrame, allowed: DataFrame) -> DataFrame:
    """Edges whose (predicate, type, type) the ontology does not hold; ``related_to`` is always allowed."""
    named = edges.where("predicate <> 'related_to'").join(types.select(F.col("id").alias("a"), F.col("entity_type").alias("from_type")), "a").join(types.select(F.col("id").alias("b"), F.col("entity_type").alias("to_type")), "b")
    return named.join(allowed, ["predicate", "from_type", "to_type"], "left_anti")


def orphans(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    return entities.join(mentions, F.col("id") == F.col("entity_id"), "left_anti")


def among(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in a set of ids, without loops."""
    keep = lambda df, c: df.join(ids.select(F.col("id").alias("_id")), F.col(c) == F.col("_id"), "left_semi")
    return keep(keep(edges, "a"), "b").where("a <> b")


def author_layers(mentions: DataFrame, authors: DataFrame) -> DataFrame:
    """For each co-mentioned pair the authors of the thoughts that mention it.

    A thought's layer goes with its mentions before pairs are made, so that pairs are not moved once more. A
    thought is what one person wrote down: its pairs are the square of the entities it mentions.
    """
    m = mentions.select("thought_id", "entity_id").distinct()
    told = m.join(authors.select("thought_id", "layer"), "thought_id").withColumnRenamed("entity_id", "a")
    pairs = told.join(m.withColumnRenamed("entity_id", "b"), "thought_id").where("a < b")
    return pairs.select("a", "b", "layer").distinct().groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_list("layer")), ",").alias("layers"))


def layer_index(mentions: DataFrame, authors: DataFrame) -> DataFrame:
    """The layers of the thoughts that mention each entity, sorted; there are no more than there are authors."""
    pairs = mentions.join(authors.select("thought_id", "layer"), "thought_id").select("entity_id", "layer").distinct()
    return pairs.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_list("layer")), ",").alias("layers"))


def snapshot(mentions: DataFrame, relations: DataFrame, most_nodes: int, most_edges: int) -> DataFrame:
    """Edges to draw: the heaviest co-mentions and relations between the most mentioned entities."""
    nodes = mentions.groupBy(F.col("entity_id").alias("id")).agg(F.countDistinct("thought_id").alias("n")).orderBy(F.desc("n"), "id").limit(most_nodes)
    drawn = comentions(mentions).withColumn("kind", F.lit("co_mention")).unionByName(relations.select("a", "b", "weight").withColumn("kind", F.lit("relation")))
    return among(drawn, nodes).orderBy(F.desc("weight"), "a", "b", "kind").limit(most_edges)


def drawing(entities: DataFrame, mentions: DataFrame, relations: DataFrame, most_nodes: int = 400, most_edges: int = 800) -> tuple[DataFrame, DataFrame]:
    """A graph to draw: nodes (``id, label, subtype, project_status``) and edges (``a, b, relation, kind``).

    The first entities, the heaviest co-mentions and the first relations are taken, each up to its bound;
    ends of edges that are not among the nodes are added. Loops go, and edges to what is no entity.
    """
    node = entities.select("id", F.coalesce("label", F.lit("")).alias("label"), F.coalesce("entity_type", F.lit("other")).alias("subtype"), "project_status")
    said = F.when(F.col("weight") > 1, F.concat(F.lit("co_mentioned ("), F.col("weight").cast("string"), F.lit(")"))).otherwise("co_mentioned")
    together = comentions(mentions).orderBy(F.desc("weight"), "a", "b").limit(most_edges).select("a", "b", said.alias("relation"), F.lit("co_mention").alias("kind"))
    stated = relations.select("a", "b", F.coalesce("predicate", F.lit("related_to")).alias("relation")).orderBy("a", "b", "relation").limit(most_edges)
    edges = among(together.unionByName(stated.withColumn("kind", F.lit("entity_relation"))), entities.select("id"))
    shown = node.orderBy("id").limit(most_nodes).select("id")
    wanted = shown.unionByName(edges.select(F.explode(F.array("a", "b")).alias("id"))).distinct()
    return node.join(wanted, "id", "left_semi"), edges


def hull(points: DataFrame, group: str, padding: float = 28.0) -> DataFrame:
    """A circle around each group's points: their mean, and the largest distance from it plus a margin."""
    mean = points.groupBy(group).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    far = points.join(mean, group).groupBy(group, "cx", "cy").agg(F.max(F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))).alias("far"), F.count("*").alias("n"))
    return far.select(group, F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), F.round(F.col("far") + padding, 6).alias("radius"), "n")


def grid_clusters(points: DataFrame, cell: float) -> DataFrame:
    cells = points.withColumn("cell", F.concat_ws(":", F.floor(F.col("x") / cell).cast("string"), F.floor(F.col("y") / cell).cast("string")))
    return hull(cells, "cell", 0.0)


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key under an order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def fixture_map(mapped: DataFrame, runs: DataFrame, thoughts: DataFrame) -> DataFrame:
    """Where each fixture was last put: the thought of its newest run, if it is still there and the run's user's own.

    ``mapped`` has ``fixture_id, run_id, thought_id``, ``runs`` ``run_id, eval_user, created_at``, ``thoughts``
    ``id, user_id``. Of runs of one time the greater id wins.
    """
    rows = mapped.where("fixture_id is not null").join(runs, "run_id")
    rows = rows.join(thoughts.select(F.col("id").alias("thought_id"), F.col("user_id").alias("eval_user")), ["thought_id", "eval_user"], "left_semi")
    newest = rows.groupBy("fixture_id").agg(F.max_by(F.struct("thought_id", "run_id"), F.struct("created_at", "run_id", -F.col("thought_id"))).alias("m"))
    return newest.select("fixture_id", F.col("m.thought_id").alias("thought_id"), F.col("m.run_id").alias("source_run_id"))


def contradictions(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """Relations of kind ``contradicts`` both whose ends are in a result set (``id``)."""
    keep = lambda df, c: df.join(ids.select(F.col("id").alias("_id")), F.col(c) == F.col("_id"), "left_semi")
    return keep(keep(relations.where("relation_type = 'contradicts'"), "source_id"), "target_id").select("source_id", "target_id")


def metrics(thoughts: DataFrame, entities: DataFrame, edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row of counts; each table is counted by itself and only the counts meet."""
    out = entities.agg(F.count("*").alias("entities"), F.count("project_status").alias("projects"))
    for name, rows in (("thoughts", thoughts), ("edges", edges), ("communities", communities)):
        out = out.crossJoin(rows.agg(F.count("*").alias(name)))
    return out
