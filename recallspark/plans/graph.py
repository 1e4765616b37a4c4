"""Graph queries over mentions of parts in orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallspark.operators import graph as op
from recallspark.plans.book import Book
from recallspark.sources import views as v
from recallspark.sources.views import ctes

BOOK = Book()

_M = ctes("v_mention", "v_entity", "v_thought")
_EDGE = ", v_edge AS (SELECT a.entity_id AS a, b.entity_id AS b, count(*) AS weight FROM v_mention a JOIN v_mention b ON a.thought_id = b.thought_id AND a.entity_id < b.entity_id GROUP BY 1, 2)"
#: Edges to walk along: pairs that two thoughts or more mention.
_STRONG = _EDGE + ", strong AS (SELECT * FROM v_edge WHERE weight >= 2)"
_ADJ = _STRONG + ", adj AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM strong UNION ALL SELECT b, a FROM strong))"


#: Pairs that one thought alone mentions, which no strong edge joins.
_MISSING = """WITH m AS MATERIALIZED (SELECT DISTINCT l_orderkey AS t, l_partkey AS e FROM lineitem)
, missing AS MATERIALIZED (SELECT x.e AS a, y.e AS b, count(*) AS weight FROM m x JOIN m y ON x.t = y.t AND x.e < y.e GROUP BY 1, 2 HAVING count(*) < 2) """


def strong_edges(spark, d):
    return op.comentions(v.mentions(spark, d)).where("weight >= 2")


@BOOK.query(_M + _EDGE + "SELECT a, b, weight FROM v_edge ORDER BY weight DESC, a, b LIMIT 200")
def comention_edges(spark, d):
    return op.comentions(v.mentions(spark, d)).orderBy(F.desc("weight"), "a", "b").limit(200)


_REL = ", rel AS (SELECT l_orderkey AS source_id, (l_partkey * 3 + 1) AS target_id, 'r' || (l_linenumber % 3) AS relation_type FROM lineitem)"


def relations(spark, d):
    kind = F.concat(F.lit("r"), (F.col("l_linenumber") % 3).cast("string"))
    return v.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source_id"), (F.col("l_partkey") * 3 + 1).alias("target_id"), kind.alias("relation_type"))


@BOOK.query(_M + _REL + """
, s AS (SELECT id FROM v_thought WHERE id % 100 = 1), f AS (SELECT target_id AS id, relation_type FROM rel WHERE source_id IN (FROM s) UNION ALL SELECT source_id, relation_type FROM rel WHERE target_id IN (FROM s))
SELECT id, count(*) AS hits, string_agg(DISTINCT relation_type, ',' ORDER BY relation_type) AS kinds FROM f WHERE id NOT IN (FROM s) GROUP BY 1 ORDER BY hits DESC, id LIMIT 100""")
def neighbors_1hop(spark, d):
    return op.neighbours(relations(spark, d), v.thoughts(spark, d).where("id % 100 = 1").select("id"), 100)


@BOOK.query(_M + _ADJ + """
, s AS (SELECT id FROM v_entity WHERE id % 50 = 3), n AS (SELECT b AS entity_id, count(*) AS paths FROM adj WHERE a IN (FROM s) GROUP BY 1)
, f AS (SELECT thought_id, count(*) AS hits, 0 AS way FROM v_mention WHERE entity_id IN (FROM s) GROUP BY 1 UNION ALL SELECT thought_id, sum(paths), 1 FROM v_mention JOIN n USING (entity_id) GROUP BY 1)
SELECT thought_id, sum(hits)::BIGINT AS hits, min(way) AS way FROM f GROUP BY 1 ORDER BY hits DESC, thought_id LIMIT 200""")
def expand_entities(spark, d):
    seeds = v.entities(spark, d).where("id % 50 = 3").select("id")
    return op.thoughts_of_entities(v.mentions(spark, d), strong_edges(spark, d), seeds, 200)


@BOOK.query(ctes("v_event", "v_mention") + """
, s AS (SELECT event_id, thought_id FROM v_event WHERE thought_id % 400 = 5), i AS (SELECT event_id, entity_id FROM v_event JOIN v_mention USING (thought_id))
, w AS (SELECT entity_id, count(*) AS paths FROM i WHERE event_id IN (SELECT event_id FROM s) GROUP BY 1)
, f AS (SELECT thought_id, count(*) AS hits, 0 AS way FROM s GROUP BY 1 UNION ALL SELECT thought_id, sum(paths), 1 FROM v_mention JOIN w USING (entity_id) GROUP BY 1)
SELECT thought_id, sum(hits)::BIGINT AS hits, min(way) AS way FROM f GROUP BY 1 ORDER BY hits DESC, thought_id LIMIT 200""")
def expand_events(spark, d):
    events, mentions = v.events(spark, d), v.mentions(spark, d)
    seeds = events.where("thought_id % 400 = 5").select("event_id")
    involves = events.select("event_id", "thought_id").join(mentions, "thought_id").select("event_id", "entity_id")
    return op.thoughts_of_events(events, involves, mentions, seeds, 200)


@BOOK.query(_M + _ADJ + """
, s AS (SELECT id, (contains(lower(label), 'red')::INT + contains(lower(label), 'ring')::INT + contains(lower(label), 'small')::INT)::BIGINT AS score FROM v_entity)
, t AS (SELECT * FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 60), p AS (SELECT id, score FROM t UNION ALL SELECT b, score FROM adj JOIN t ON a = id)
SELECT id, sum(score)::BIGINT AS score FROM p GROUP BY 1 ORDER BY score DESC, id LIMIT 20""")
def graph_only_search(spark, d):
    return op.search_by_tokens(v.entities(spark, d), strong_edges(spark, d), ["red", "ring", "small", "red", "x"], 20)


@BOOK.query(_M + _STRONG + "SELECT id, count(*) AS degree FROM (SELECT a AS id FROM strong UNION ALL SELECT b FROM strong) GROUP BY 1")
def entity_degree(spark, d):
    return op.degrees(strong_edges(spark, d))


@BOOK.query(_M + _ADJ + """
, r(id, c) AS (SELECT id, id FROM v_entity UNION SELECT adj.b, r.c FROM r JOIN adj ON adj.a = r.id WHERE r.c < adj.b)
, l AS (SELECT id, min(c) AS c FROM r GROUP BY 1), n AS (SELECT count(*) AS nodes FROM v_entity), e AS (SELECT count(*) AS edges FROM strong), i AS (SELECT count(*) AS isolated FROM v_entity WHERE id NOT IN (SELECT a FROM adj))
SELECT nodes, edges, (SELECT count(DISTINCT c) FROM l) AS components, isolated, round(edges / (nodes::DOUBLE * (nodes - 1) / 2), 9) AS density, round(edges / (nodes::DOUBLE * (nodes - 1) / 2), 9) < 0.015 AS sparse, isolated / nodes::DOUBLE > 0.6 AS lonely, (SELECT count(DISTINCT c) FROM l) > 6 AS split FROM n, e, i""")
def graph_health(spark, d):
    return op.health(v.entities(spark, d), strong_edges(spark, d))


@BOOK.query(_MISSING + "SELECT a, b, weight FROM missing")
def missing_pairs(spark, d):
    return op.missing_pairs(v.mentions(spark, d), strong_edges(spark, d))


#: Stated relations between parts, most of them without a common mention.
_STATED = ", stated AS (SELECT p_partkey AS a, (p_partkey * 7 + 3) % (SELECT count(*) FROM part) AS b, 'related_to' AS predicate, 1::BIGINT AS weight FROM part)"


def stated(spark, d):
    n = v.table(spark, d, "part").count()
    return v.table(spark, d, "part").select(F.col("p_partkey").alias("a"), ((F.col("p_partkey") * 7 + 3) % n).alias("b"), F.lit("related_to").alias("predicate"), F.lit(1).cast("long").alias("weight"))


@BOOK.query(_M + _EDGE + _STATED + "SELECT s.a, s.b, s.predicate, s.weight FROM stated s LEFT JOIN v_edge e ON least(s.a, s.b) = e.a AND greatest(s.a, s.b) = e.b WHERE e.a IS NULL")
def prune_suspicious(spark, d):
    return op.suspicious(stated(spark, d), v.mentions(spark, d)).select("a", "b", "predicate", "weight")


@BOOK.query(_M + _EDGE + """
, t AS (SELECT id AS thought_id, id % 2 AS text_key FROM v_thought), p AS (SELECT x.entity_id AS a, y.entity_id AS b, thought_id, text_key FROM v_mention x JOIN v_mention y USING (thought_id) JOIN t USING (thought_id) WHERE x.entity_id < y.entity_id)
, g AS (SELECT a, b, count(DISTINCT thought_id) AS n, count(DISTINCT text_key) AS texts FROM p GROUP BY 1, 2) SELECT * FROM g WHERE n >= 3 AND (n - texts) / n::DOUBLE >= 0.5""")
def prune_duplicate_support(spark, d):
    texts = v.thoughts(spark, d).select(F.col("id").alias("thought_id"), (F.col("id") % 2).alias("text_key"))
    return op.duplicate_support(op.comentions(v.mentions(spark, d)), v.mentions(spark, d), texts)


@BOOK.query(_M + _STATED + """
, e AS (SELECT a, b, CASE WHEN a % 2 = 0 THEN 'part_of' ELSE predicate END AS predicate FROM stated), t AS (SELECT e.*, x.entity_type AS from_type, y.entity_type AS to_type FROM e JOIN v_entity x ON x.id = a JOIN v_entity y ON y.id = b)
SELECT a, b, predicate, from_type, to_type FROM t WHERE predicate <> 'related_to' AND NOT (from_type = 'Brand#1' AND to_type = 'Brand#2') AND NOT (from_type = to_type)""")
def prune_invalid_typed(spark, d):
    edges = stated(spark, d).withColumn("predicate", F.when(F.col("a") % 2 == 0, "part_of").otherwise(F.col("predicate")))
    types = v.entities(spark, d).select("id", "entity_type")
    kinds = types.select("entity_type").distinct()
    allowed = kinds.select(F.lit("part_of").alias("predicate"), F.col("entity_type").alias("from_type"), F.col("entity_type").alias("to_type"))
    allowed = allowed.unionByName(spark.createDataFrame([("part_of", "Brand#1", "Brand#2")], allowed.schema))
    return op.invalid_typed(edges, types, allowed).select("a", "b", "predicate", "from_type", "to_type")


@BOOK.query(_M + "SELECT id, label FROM v_entity WHERE id NOT IN (SELECT entity_id FROM v_mention WHERE source = 'manual')")
def orphan_entities(spark, d):
    return op.orphans(v.entities(spark, d), v.mentions(spark, d).where("source = 'manual'")).select("id", "label")


@BOOK.query(_M + """
, p AS (SELECT DISTINCT x.entity_id AS a, y.entity_id AS b, CASE WHEN t.user_id % 3 = 0 THEN 'user' ELSE 'apikey:' || (t.user_id % 3) END AS layer FROM v_mention x JOIN v_mention y USING (thought_id) JOIN v_thought t ON t.id = thought_id WHERE x.entity_id < y.entity_id)
SELECT a, b, string_agg(layer, ',' ORDER BY layer) AS layers FROM p GROUP BY 1, 2""")
def author_layers(spark, d):
    layer = F.when(F.col("user_id") % 3 == 0, "user").otherwise(F.concat(F.lit("apikey:"), (F.col("user_id") % 3).cast("string")))
    return op.author_layers(v.mentions(spark, d), v.thoughts(spark, d).select(F.col("id").alias("thought_id"), layer.alias("layer")))


@BOOK.query(_M + """
, p AS (SELECT DISTINCT entity_id, CASE WHEN user_id % 3 = 0 THEN 'user' ELSE 'apikey:' || (user_id % 3) END AS layer FROM v_mention JOIN v_thought ON id = thought_id)
SELECT entity_id, string_agg(layer, ',' ORDER BY layer) AS layers FROM p GROUP BY 1""")
def layer_index(spark, d):
    layer = F.when(F.col("user_id") % 3 == 0, "user").otherwise(F.concat(F.lit("apikey:"), (F.col("user_id") % 3).cast("string")))
    return op.layer_index(v.mentions(spark, d), v.thoughts(spark, d).select(F.col("id").alias("thought_id"), layer.alias("layer")))


@BOOK.query(_M + _EDGE + _STATED + """
, n AS (SELECT entity_id AS id, count(DISTINCT thought_id) AS n FROM v_mention GROUP BY 1 ORDER BY n DESC, id LIMIT 400)
, e AS (SELECT a, b, weight, 'co_mention' AS kind FROM v_edge UNION ALL SELECT a, b, weight, 'relation' FROM stated)
SELECT * FROM e WHERE a IN (SELECT id FROM n) AND b IN (SELECT id FROM n) AND a <> b ORDER BY weight DESC, a, b, kind LIMIT 800""")
def graph_snapshot(spark, d):
    return op.snapshot(v.mentions(spark, d), stated(spark, d), 400, 800)


_DRAWN = """
, c AS (SELECT a, b, CASE WHEN weight > 1 THEN 'co_mentioned (' || weight || ')' ELSE 'co_mentioned' END AS relation, 'co_mention' AS kind FROM (SELECT * FROM v_edge ORDER BY weight DESC, a, b LIMIT 800))
, r AS (SELECT a, b, predicate AS relation, 'entity_relation' AS kind FROM stated ORDER BY a, b, predicate LIMIT 800)
, e AS (SELECT * FROM (SELECT * FROM c UNION ALL SELECT * FROM r) WHERE a <> b AND a IN (SELECT id FROM v_entity) AND b IN (SELECT id FROM v_entity))"""


@BOOK.query(_M + _EDGE + _STATED + _DRAWN + " SELECT * FROM e")
def drawn_edges(spark, d):
    return op.drawing(v.entities(spark, d), v.mentions(spark, d), stated(spark, d))[1]


@BOOK.query(_M + _EDGE + _STATED + _DRAWN + ", w AS (SELECT id FROM (SELECT id FROM v_entity ORDER BY id LIMIT 400) UNION SELECT a FROM e UNION SELECT b FROM e) SELECT id, label, entity_type AS subtype, project_status FROM v_entity WHERE id IN (SELECT id FROM w)")
def drawn_nodes(spark, d):
    return op.drawing(v.entities(spark, d), v.mentions(spark, d), stated(spark, d))[0]


@BOOK.query("WITH p AS (SELECT floor(p_retailprice / 25)::BIGINT || ':' || floor(p_size / 10)::BIGINT AS cell, p_retailprice AS x, p_size::DOUBLE AS y FROM part), m AS (SELECT cell, avg(x) AS cx, avg(y) AS cy FROM p GROUP BY 1) SELECT cell, round(cx, 6) AS cx, round(cy, 6) AS cy, round(max(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))), 6) AS radius, count(*) AS n FROM p JOIN m USING (cell) GROUP BY cell, cx, cy")
def grid_clusters(spark, d):
    points = v.table(spark, d, "part").select((F.col("p_retailprice") / 2.5).alias("x0"), F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"))
    cells = points.withColumn("cell", F.concat_ws(":", F.floor(F.col("x") / 25).cast("string"), F.floor(F.col("y") / 10).cast("string")))
    return op.hull(cells, "cell", 0.0)


@BOOK.query(_MISSING[:-1] + """, p AS (SELECT a, b, lower(split_part(x.p_name, ' ', 1)) AS one, lower(y.p_name) AS other FROM missing JOIN part x ON x.p_partkey = a JOIN part y ON y.p_partkey = b)
SELECT a, b, CASE WHEN starts_with(other, one || ' ') THEN 'part_of' ELSE 'related_to' END AS relation FROM p WHERE contains(other, one)""")
def lexical_relations(spark, d):
    gaps = op.missing_pairs(v.mentions(spark, d), strong_edges(spark, d))
    labels = v.entities(spark, d).select("id", "label")
    named = gaps.join(labels.select(F.col("id").alias("a"), F.split("label", " ")[0].alias("one")), "a").join(labels.select(F.col("id").alias("b"), F.col("label").alias("other")), "b")
    return named.select("a", "b", op.lexical_relation(F.col("one"), F.col("other")).alias("relation")).where("relation is not null")
