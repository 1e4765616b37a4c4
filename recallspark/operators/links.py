"""Materialised links, community bundles, retrieval features and salience."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallspark.operators.graph import adjacency, latest

#: Sources of links that say a thought belongs to a project.
MEMBERSHIP = ("manual", "project")


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 86_400_000_000.0


def confidence(value: Column) -> Column:
    """high, medium and low as numbers; numbers are cut to 0..1; anything else is 0.4."""
    number = F.when(value.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), value.try_cast("double"))
    named = F.when(value == "high", 1.0).when(value == "medium", 0.7).when(value == "low", 0.4)
    return F.coalesce(named, F.when(number.isNotNull(), F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0))), F.lit(0.4))


def entity_links(extracted: DataFrame, membership: DataFrame, entities: DataFrame) -> DataFrame:
    """One link for each thought and entity, the most salient; members of a project keep their own link.

    Links to entities that do not exist come back with ``dangling`` set, for the caller to refuse.
    """
    best = extracted.groupBy("thought_id", "entity_id").agg(F.max("salience").alias("salience"))
    fresh = best.join(membership.select("thought_id", "entity_id"), ["thought_id", "entity_id"], "left_anti")
    known = entities.select(F.col("id").alias("entity_id")).distinct().withColumn("_there", F.lit(True))
    return fresh.join(known, "entity_id", "left").select("thought_id", "entity_id", "salience", F.col("_there").isNull().alias("dangling"))


def neighbour_links(relations: DataFrame) -> DataFrame:
    return relations.select(F.col("source_id").alias("thought_id"), F.col("target_id").alias("neighbor_id"), "relation_type", F.lit(1.0).alias("weight")).distinct()


def top_thoughts(links: DataFrame, thoughts: DataFrame, now: str, most: int = 20) -> DataFrame:
    """Each entity's best thoughts in order, with their rank scores."""
    rows = links.join(thoughts.select(F.col("id").alias("thought_id"), F.col("salience").alias("own"), "created_at"), "thought_id")
    order = Window.partitionBy("entity_id").orderBy(F.desc("salience"), F.desc("own"), F.desc("created_at"), "thought_id")
    # The filter is on the row number itself, so that each task sends no more than ``most`` rows of an entity.
    rows = rows.withColumn("i", F.row_number().over(order)).where(F.col("i") <= most).withColumn("i", F.col("i") - 1)
    age = F.greatest(days_between(F.lit(now).cast("timestamp_ntz"), F.col("created_at")), F.lit(0.0))
    score = 0.5 * F.col("salience") + 0.3 * F.col("own") + 0.2 / (1 + age) - 0.01 * F.col("i")
    return rows.select("entity_id", "i", "thought_id", F.round(score, 6).alias("rank_score"))


def as_lists(top: DataFrame) -> DataFrame:
    """``entity_id, thought_ids, rank_scores``; lists are no longer than the top that they hold."""
    found = top.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("i", "thought_id", "rank_score"))).alias("r"))
    return found.select("entity_id", F.col("r.thought_id").alias("thought_ids"), F.col("r.rank_score").alias("rank_scores"))


def community_thoughts(links: DataFrame, members: DataFrame, thoughts: DataFrame, rows: int = 40, most: int = 20) -> DataFrame:
    """Each community's thoughts: the best ``rows`` links first, then each thought once, at most ``most``."""
    joined = links.join(members, "entity_id").join(thoughts.select(F.col("id").alias("thought_id"), F.col("salience").alias("own"), "created_at"), "thought_id")
    order = Window.partitionBy("community_id").orderBy(F.desc("own"), F.desc("created_at"), "thought_id", "entity_id")
    cut = joined.withColumn("place", F.row_number().over(order)).where(F.col("place") <= rows)
    once = cut.groupBy("community_id", "thought_id").agg(F.min("place").alias("place"))
    again = Window.partitionBy("community_id").orderBy("place")
    return once.withColumn("i", F.row_number().over(again) - 1).where(F.col("i") < most).select("community_id", "i", "thought_id")


def bundles(communities: DataFrame, thoughts: DataFrame, members: DataFrame, entities: int = 10, siblings: int = 8) -> DataFrame:
    """Each community with its thoughts, its first entities and its siblings, as comma lists."""
    comma = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    t = thoughts.groupBy("community_id").agg(F.array_sort(F.collect_list(F.struct("i", "thought_id"))).alias("t"))
    first = Window.partitionBy("community_id").orderBy("entity_id")
    e = members.withColumn("n", F.row_number().over(first)).where(F.col("n") <= entities).groupBy("community_id").agg(F.array_sort(F.collect_list("entity_id")).alias("e"))
    # A community's first siblings are among its parent's first few children: one more than asked, as it may be one of them.
    child = Window.partitionBy("parent_id").orderBy("community_id")
    few = communities.where("parent_id is not null").withColumn("n", F.row_number().over(child)).where(F.col("n") <= siblings + 1).groupBy("parent_id").agg(F.array_sort(F.collect_list("community_id")).alias("few"))
    others = lambda c: F.slice(F.filter(c, lambda x: x != F.col("community_id")), 1, siblings)
    near = communities.join(few, "parent_id").select("community_id", others(F.col("few")).alias("s"))
    rows = communities.join(t, "community_id", "left").join(e, "community_id", "left").join(near, "community_id", "left")
    return rows.select("community_id", "parent_id", F.coalesce(comma(F.col("t.thought_id")), F.lit("")).alias("thought_ids"), F.coalesce(comma(F.col("e")), F.lit("")).alias("entity_ids"), F.coalesce(F.array_join("s", ","), F.lit("")).alias("sibling_ids"))


def pending_summaries(communities: DataFrame, members: DataFrame, links: DataFrame, summaries: DataFrame, limit: int) -> DataFrame:
    """Communities to summarise: two members and a thought at least, without summary or changed since."""
    linked = members.join(links, "entity_id").groupBy("community_id").agg(F.countDistinct("thought_id").alias("thoughts"))
    sizes = members.groupBy("community_id").agg(F.countDistinct("entity_id").alias("members"))
    rows = communities.join(sizes, "community_id").join(linked, "community_id").where("members >= 2 and thoughts >= 1").join(summaries, "community_id", "left")
    due = rows.where("generated_at is null or dirty_at > generated_at").withColumn("missing", F.col("generated_at").isNull())
    return due.select("community_id", "members", "thoughts", "missing").orderBy(F.desc("missing"), F.desc("members"), "community_id").limit(limit)


def retrieval_features(thoughts: DataFrame, links: DataFrame, members: DataFrame, edges: DataFrame, now: str, half_life: float = 90.0) -> DataFrame:
    """Centrality, specificity, up to three communities and recency of each thought."""
    degree = adjacency(edges).groupBy(F.col("a").alias("entity_id")).agg(F.count("*").alias("degree"))
    top = degree.agg(F.max("degree").alias("max_degree"))
    central = links.join(degree, "entity_id", "left").groupBy("thought_id").agg(F.max(F.coalesce("degree", F.lit(0))).alias("degree")).join(F.broadcast(top), F.lit(True)).select("thought_id", F.round(F.coalesce(F.try_divide("degree", "max_degree"), F.lit(0.0)), 6).alias("centrality"))
    pairs = links.select("thought_id", "entity_id").join(members, "entity_id")
    freq = pairs.groupBy("community_id").agg(F.count("*").alias("freq"))
    most = freq.agg(F.max("freq").alias("max_freq"))
    special = pairs.join(freq, "community_id").join(F.broadcast(most), F.lit(True)).groupBy("thought_id").agg(F.round(1 - F.sum("freq") / (F.count("*") * F.max("max_freq")), 6).alias("specificity"))
    own = pairs.groupBy("thought_id", "community_id").agg(F.count("*").alias("n"))
    first = Window.partitionBy("thought_id").orderBy(F.desc("n"), "community_id")
    own = own.withColumn("k", F.row_number().over(first)).where("k <= 3").groupBy("thought_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "community_id"))), lambda x: x["community_id"]), ",").alias("communities"))
    age = F.greatest(days_between(F.lit(now).cast("timestamp_ntz"), F.col("created_at")), F.lit(0.0))
    rows = thoughts.select(F.col("id").alias("thought_id"), F.round(F.exp(-age * F.ln(F.lit(2.0)) / half_life), 6).alias("recency"))
    rows = rows.join(central, "thought_id", "left").join(special, "thought_id", "left").join(own, "thought_id", "left")
    return rows.select("thought_id", "recency", F.coalesce("centrality", F.lit(0.0)).alias("centrality"), F.coalesce("specificity", F.lit(0.0)).alias("specificity"), F.coalesce("communities", F.lit("")).alias("communities"))


def decayed(thoughts: DataFrame, now: str, exempt: tuple[str, ...] = (), after: float = 7.0, factor: float = 0.97, least: float = 0.1) -> DataFrame:
    """Salience of thoughts not seen for a week falls by a factor a day; one application a call."""
    days = days_between(F.lit(now).cast("timestamp_ntz"), F.coalesce("last_accessed_at", "created_at"))
    idle = (days > after) & ~F.coalesce(F.col("category").isin(*exempt) if exempt else F.lit(False), F.lit(False)) & ~F.coalesce(F.col("never_stale"), F.lit(False))
    return thoughts.withColumn("salience", F.when(idle, F.greatest(F.lit(least), F.col("salience") * F.pow(F.lit(factor), days - after))).otherwise(F.col("salience")))


def risen(thoughts: DataFrame, now: str, a_day: float = 0.15, most: float = 5.0) -> DataFrame:
    """Open tasks weigh more the longer they stand open; goes after ``decayed``."""
    days = days_between(F.lit(now).cast("timestamp_ntz"), F.col("created_at"))
    task = (F.col("category") == "task") & (F.col("lifecycle") == "open")
    return thoughts.withColumn("salience", F.when(task, F.least(F.lit(most), F.greatest(F.col("salience"), 1 + a_day * days))).otherwise(F.col("salience")))


def reconsolidated(thoughts: DataFrame, seen: DataFrame) -> DataFrame:
    """Thoughts that an answer used: one more access, a little more salience, at most five."""
    hit = F.col("_hit").isNotNull()
    rows = thoughts.join(seen.select(F.col("id"), F.lit(1).alias("_hit")).distinct(), "id", "left")
    return rows.withColumn("access_count", F.col("access_count") + hit.cast("int")).withColumn("salience", F.when(hit, F.least(F.col("salience") + 0.05, F.lit(5.0))).otherwise(F.col("salience"))).drop("_hit")


def dirty_communities(touched: DataFrame, links: DataFrame, members: DataFrame, most: int = 50) -> DataFrame:
    """Communities of the entities of new thoughts, to be refreshed."""
    hit = links.join(touched.select(F.col("id").alias("thought_id")), "thought_id", "left_semi").select("entity_id").distinct()
    return members.join(hit, "entity_id", "left_semi").groupBy("community_id").agg(F.count("*").alias("entities")).orderBy("community_id").limit(most)


def overlay_names(communities: DataFrame, summaries: DataFrame, members: DataFrame, labels: DataFrame) -> DataFrame:
    """A community's name: its summary cut to 48 characters, else its first three members, else its level."""
    named = members.join(labels.select(F.col("id").alias("entity_id"), "label"), "entity_id")
    first = named.withColumn("k", F.row_number().over(Window.partitionBy("community_id").orderBy("entity_id"))).where("k <= 3").groupBy("community_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "label"))), lambda x: x["label"]), ", ").alias("labels"))
    rows = communities.join(summaries, "community_id", "left").join(first, "community_id", "left")
    said = F.nullif(F.trim("summary_text"), F.lit(""))
    short = F.when(F.char_length(said) <= 48, said).otherwise(F.concat(F.rtrim(F.substring(said, 1, 47)), F.lit("…")))
    return rows.select("community_id", F.coalesce(short, "labels", F.concat(F.lit("Cluster L"), F.col("level").cast("string"))).alias("name"))


def signatures(members: DataFrame) -> DataFrame:
    """A community's members, sorted and joined: equal sets have equal signatures."""
    return members.groupBy("community_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("entity_id")), lambda x: x.cast("string")), ",").alias("signature"))


def community_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Communities of equal members keep their id; others are new or obsolete."""
    a, b = signatures(before).withColumnRenamed("community_id", "old_id"), signatures(after).withColumnRenamed("community_id", "new_id")
    rows = a.join(b, "signature", "full")
    state = F.when(F.col("old_id").isNull(), "new").when(F.col("new_id").isNull(), "obsolete").otherwise("kept")
    return rows.select(F.coalesce("old_id", "new_id").alias("community_id"), state.alias("state"), F.sha2("signature", 256).alias("fingerprint"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of both tables, the newest of each key; new rows win ties."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, keys, F.desc_nulls_last(version), F.desc("_new")).drop("_new")


def rebuilt(links: DataFrame, fresh: DataFrame) -> DataFrame:
    """Derived links are replaced as a whole; links that people made stay."""
    return links.where("source <> 'ingest'").unionByName(fresh.withColumn("source", F.lit("ingest")).join(links.where("source <> 'ingest'").select("thought_id", "entity_id"), ["thought_id", "entity_id"], "left_anti").select(*links.columns))


def unused_kinds(kinds: DataFrame, entities: DataFrame) -> DataFrame:
    """Unprotected kinds of entity that no entity has."""
    return kinds.where("not protected").join(entities.select(F.col("entity_type").alias("kind")), "kind", "left_anti")


def pruned_ontology(kinds: DataFrame, entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kinds that stay, and of the allowed relations (``from_kind, to_kind``) those between such kinds."""
    gone = unused_kinds(kinds, entities).select("kind").distinct()
    for end in ("from_kind", "to_kind"):
        relations = relations.join(gone.select(F.col("kind").alias(end)), end, "left_anti")
    return kinds.join(gone, "kind", "left_anti"), relations


def threads(links: DataFrame, entities: DataFrame) -> DataFrame:
    """The project each thought is on: of its links that make it a member the most salient, ties to the smaller id."""
    projects = entities.where("project_status is not null").select(F.col("id").alias("entity_id"), "label")
    rows = links.where(F.col("source").isin(*MEMBERSHIP)).join(projects, "entity_id")
    return latest(rows, ["thought_id"], F.desc("salience"), F.asc("entity_id")).select("thought_id", "entity_id", "label")


def repaired_types(entities: DataFrame, active: DataFrame, fallback: str = "concept") -> DataFrame:
    known = active.select(F.col("kind").alias("entity_type")).distinct().withColumn("_ok", F.lit(True))
    return entities.join(known, "entity_type", "left").withColumn("entity_type", F.when(F.col("_ok").isNull(), F.lit(fallback)).otherwise(F.col("entity_type"))).drop("_ok")


def largest_communities(members: DataFrame, limit: int, preview: int = 4) -> DataFrame:
    """The communities of most members (``community_id, entity_id, label``), with their first few labels."""
    top = members.groupBy("community_id").agg(F.count("*").alias("members")).orderBy(F.desc("members"), "community_id").limit(limit)
    first = members.join(F.broadcast(top.select("community_id")), "community_id", "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("community_id").orderBy("entity_id"))).where(F.col("n") <= preview)
    told = first.groupBy("community_id").agg(F.array_sort(F.collect_list(F.struct("n", "label"))).alias("l"))
    return top.join(told, "community_id").select("community_id", "members", F.array_join("l.label", ", ").alias("preview"))


def consolidated(thoughts: DataFrame, entities: DataFrame, kinds: DataFrame, links: DataFrame, members: DataFrame, edges: DataFrame, now: str, exempt: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The nightly jobs in their order, each on what the ones before made.

    First salience, the ontology and the entities' types; then the communities' bundles; then what is kept ready
    for retrieval. ``members`` are communities as detected (``community_id, parent_id, entity_id``).
    """
    fresh = risen(decayed(thoughts, now, exempt=exempt), now)
    kept = kinds.join(unused_kinds(kinds, entities).select("kind"), "kind", "left_anti")
    typed = repaired_types(entities, kept)
    own = members.select("community_id", "entity_id")
    bundled = bundles(members.select("community_id", "parent_id").distinct(), community_thoughts(links, own, fresh), own)
    return {"thoughts": fresh, "kinds": kept, "entities": typed, "bundles": bundled, "top_thoughts": top_thoughts(links, fresh, now), "features": retrieval_features(fresh, links, own, edges, now)}
