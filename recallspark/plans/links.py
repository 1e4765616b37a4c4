"""Links, bundles, features and salience over orders and parts, with a fixed nested partition as communities."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallspark.operators import graph, links as op, nightly
from recallspark.plans.book import Book
from recallspark.sources import views as v
from recallspark.sources.views import ORDER_NOW, ctes

BOOK = Book()

_M = ctes("v_mention", "v_entity", "v_thought")
_COMM = ", mem AS (SELECT l2 AS community_id, id AS entity_id FROM v_entity), com AS (SELECT DISTINCT l2 AS community_id, l1 AS parent_id, 2 AS level FROM v_entity)"
_AGE = f"(epoch_us(TIMESTAMP '{ORDER_NOW}') - epoch_us(created_at)) / 86400000000.0::DOUBLE"


def members(spark, d):
    return v.entities(spark, d).select(F.col("l2").alias("community_id"), F.col("id").alias("entity_id"))


def communities(spark, d):
    return v.entities(spark, d).select(F.col("l2").alias("community_id"), F.col("l1").alias("parent_id"), F.lit(2).alias("level")).distinct()


@BOOK.query(_M + """
, x AS (SELECT l_orderkey AS thought_id, CASE WHEN l_partkey % 97 = 0 THEN -l_partkey ELSE l_partkey END AS entity_id, CASE l_linenumber % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 WHEN 2 THEN 0.4 ELSE 0.4 END::DOUBLE AS salience FROM lineitem)
, b AS (SELECT thought_id, entity_id, max(salience) AS salience FROM x GROUP BY 1, 2)
SELECT b.*, e.id IS NULL AS dangling FROM b LEFT JOIN v_entity e ON e.id = entity_id WHERE (b.thought_id, entity_id) NOT IN (SELECT thought_id, entity_id FROM v_mention WHERE source = 'manual')""")
def thought_entity_links(spark, d):
    said = F.element_at(F.array(*map(F.lit, ("high", "medium", "low", "unsure"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    lines = v.table(spark, d, "lineitem")
    rows = lines.select(F.col("l_orderkey").alias("thought_id"), F.when(F.col("l_partkey") % 97 == 0, -F.col("l_partkey")).otherwise(F.col("l_partkey")).alias("entity_id"), op.confidence(said).alias("salience"))
    return op.entity_links(rows, v.mentions(spark, d).where("source = 'manual'"), v.entities(spark, d))


@BOOK.query(_M + f"""
, r AS (SELECT entity_id, thought_id, m.salience, t.salience AS own, created_at, row_number() OVER (PARTITION BY entity_id ORDER BY m.salience DESC, t.salience DESC, created_at DESC, thought_id) - 1 AS i FROM v_mention m JOIN v_thought t ON t.id = thought_id)
SELECT entity_id, i::INT AS i, thought_id, round(0.5 * salience + 0.3 * own + 0.2 / (1 + greatest({_AGE}, 0.0)) - 0.01 * i, 6) AS rank_score FROM r WHERE i < 20""")
def entity_top_thoughts(spark, d):
    return op.top_thoughts(v.mentions(spark, d), v.thoughts(spark, d), ORDER_NOW)


_CT = _COMM + """
, j AS (SELECT community_id, thought_id, row_number() OVER (PARTITION BY community_id ORDER BY t.salience DESC, created_at DESC, thought_id, entity_id) AS place FROM v_mention JOIN mem USING (entity_id) JOIN v_thought t ON t.id = thought_id)
, o AS (SELECT community_id, thought_id, min(place) AS place FROM j WHERE place <= 40 GROUP BY 1, 2), ct AS (SELECT community_id, row_number() OVER (PARTITION BY community_id ORDER BY place) - 1 AS i, thought_id FROM o)"""


@BOOK.query(_M + _CT + "SELECT community_id, i::INT AS i, thought_id FROM ct WHERE i < 20")
def community_thoughts(spark, d):
    return op.community_thoughts(v.mentions(spark, d), members(spark, d), v.thoughts(spark, d))


@BOOK.query(_M + _CT + """
, t AS (SELECT community_id, string_agg(thought_id::VARCHAR, ',' ORDER BY i) AS thought_ids FROM ct WHERE i < 20 GROUP BY 1)
, e AS (SELECT community_id, string_agg(entity_id::VARCHAR, ',' ORDER BY entity_id) AS entity_ids FROM (SELECT *, row_number() OVER (PARTITION BY community_id ORDER BY entity_id) AS n FROM mem) WHERE n <= 10 GROUP BY 1)
, s AS (SELECT community_id, string_agg(sibling, ',' ORDER BY sibling) AS sibling_ids FROM (SELECT a.community_id, b.community_id AS sibling, row_number() OVER (PARTITION BY a.community_id ORDER BY b.community_id) AS n FROM com a JOIN com b ON a.parent_id = b.parent_id AND a.community_id <> b.community_id) WHERE n <= 8 GROUP BY 1)
SELECT community_id, parent_id, coalesce(thought_ids, '') AS thought_ids, coalesce(entity_ids, '') AS entity_ids, coalesce(sibling_ids, '') AS sibling_ids FROM com LEFT JOIN t USING (community_id) LEFT JOIN e USING (community_id) LEFT JOIN s USING (community_id)""")
def community_bundles(spark, d):
    found = op.community_thoughts(v.mentions(spark, d), members(spark, d), v.thoughts(spark, d))
    return op.bundles(communities(spark, d), found, members(spark, d))


_SUM = ", su AS (SELECT community_id, 'About ' || community_id || ' and what belongs to it, told at some length' AS summary_text, TIMESTAMP '2001-01-01' AS generated_at FROM com WHERE length(community_id) % 2 = 0)"


def summaries(spark, d):
    text = F.concat(F.lit("About "), F.col("community_id"), F.lit(" and what belongs to it, told at some length"))
    return communities(spark, d).where(F.length("community_id") % 2 == 0).select("community_id", text.alias("summary_text"), F.lit("2001-01-01").cast("timestamp_ntz").alias("generated_at"))


@BOOK.query(_M + _COMM + _SUM + """
, l AS (SELECT community_id, count(DISTINCT thought_id) AS thoughts FROM mem JOIN v_mention USING (entity_id) GROUP BY 1), z AS (SELECT community_id, count(DISTINCT entity_id) AS members FROM mem GROUP BY 1)
, k AS (SELECT *, CASE WHEN length(community_id) % 3 = 0 THEN TIMESTAMP '2001-06-01' END AS dirty_at FROM com)
SELECT community_id, members, thoughts, generated_at IS NULL AS missing FROM k JOIN z USING (community_id) JOIN l USING (community_id) LEFT JOIN su USING (community_id) WHERE members >= 2 AND thoughts >= 1 AND (generated_at IS NULL OR dirty_at > generated_at) ORDER BY missing DESC, members DESC, community_id LIMIT 50""")
def summary_pending(spark, d):
    dirty = communities(spark, d).withColumn("dirty_at", F.when(F.length("community_id") % 3 == 0, F.lit("2001-06-01").cast("timestamp_ntz")))
    return op.pending_summaries(dirty, members(spark, d), v.mentions(spark, d), summaries(spark, d).drop("summary_text"), 50)


@BOOK.query(_M + _COMM + _SUM + """
, f AS (SELECT community_id, string_agg(label, ', ' ORDER BY entity_id) AS labels FROM (SELECT community_id, entity_id, label, row_number() OVER (PARTITION BY community_id ORDER BY entity_id) AS k FROM mem JOIN v_entity ON id = entity_id) WHERE k <= 3 GROUP BY 1)
SELECT community_id, coalesce(CASE WHEN length(summary_text) <= 48 THEN summary_text ELSE rtrim(substr(summary_text, 1, 47)) || '…' END, labels, 'Cluster L' || level) AS name FROM com LEFT JOIN su USING (community_id) LEFT JOIN f USING (community_id)""")
def overlay_names(spark, d):
    return op.overlay_names(communities(spark, d), summaries(spark, d), members(spark, d), v.entities(spark, d))


@BOOK.query(_M + _COMM + f"""
, e AS (SELECT a.entity_id AS a, b.entity_id AS b FROM v_mention a JOIN v_mention b ON a.thought_id = b.thought_id AND a.entity_id < b.entity_id GROUP BY 1, 2 HAVING count(*) >= 2)
, g AS (SELECT id, count(*) AS degree FROM (SELECT a AS id FROM e UNION ALL SELECT b FROM e) GROUP BY 1), c AS (SELECT thought_id, round(max(coalesce(degree, 0)) / (SELECT max(degree) FROM g)::DOUBLE, 6) AS centrality FROM v_mention LEFT JOIN g ON id = entity_id GROUP BY 1)
, p AS (SELECT thought_id, community_id FROM v_mention JOIN mem USING (entity_id)), q AS (SELECT community_id, count(*) AS freq FROM p GROUP BY 1)
, s AS (SELECT thought_id, round(1 - sum(freq) / (count(*) * (SELECT max(freq) FROM q))::DOUBLE, 6) AS specificity FROM p JOIN q USING (community_id) GROUP BY 1)
, o AS (SELECT thought_id, string_agg(community_id, ',' ORDER BY k) AS communities FROM (SELECT thought_id, community_id, row_number() OVER (PARTITION BY thought_id ORDER BY count(*) DESC, community_id) AS k FROM p GROUP BY 1, 2) WHERE k <= 3 GROUP BY 1)
SELECT id AS thought_id, round(exp(-greatest({_AGE}, 0.0) * ln(2.0::DOUBLE) / 90.0::DOUBLE), 6) AS recency, coalesce(centrality, 0.0)::DOUBLE AS centrality, coalesce(specificity, 0.0)::DOUBLE AS specificity, coalesce(communities, '') AS communities
FROM v_thought LEFT JOIN c ON c.thought_id = id LEFT JOIN s ON s.thought_id = id LEFT JOIN o ON o.thought_id = id""")
def retrieval_features(spark, d):
    edges = graph.comentions(v.mentions(spark, d)).where("weight >= 2")
    return op.retrieval_features(v.thoughts(spark, d), v.mentions(spark, d), members(spark, d), edges, ORDER_NOW)


def _dated(spark, d):
    seen = F.when(F.col("id") % 4 == 0, F.lit("2001-08-30").cast("timestamp_ntz"))
    return v.thoughts(spark, d).withColumn("last_accessed_at", seen).withColumn("never_stale", F.col("id") % 11 == 0)


_DECAY = f""", t AS (SELECT *, (epoch_us(TIMESTAMP '{ORDER_NOW}') - epoch_us(CASE WHEN id % 4 = 0 THEN TIMESTAMP '2001-08-30' ELSE created_at END)) / 86400000000.0::DOUBLE AS days FROM v_thought)
, dec AS (SELECT * EXCLUDE (salience), CASE WHEN days > 7 AND category <> 'note' AND id % 11 <> 0 THEN greatest(0.1::DOUBLE, salience * pow(0.97::DOUBLE, days - 7)) ELSE salience END AS salience FROM t)"""


@BOOK.query(_M + _DECAY + "SELECT id, round(salience, 6) AS salience FROM dec")
def salience_decay(spark, d):
    return op.decayed(_dated(spark, d), ORDER_NOW, exempt=("note",)).select("id", F.round("salience", 6).alias("salience"))


@BOOK.query(_M + _DECAY + f"SELECT id, round(CASE WHEN category = 'task' AND lifecycle = 'open' THEN least(5.0::DOUBLE, greatest(salience, 1 + 0.15::DOUBLE * ({_AGE}))) ELSE salience END, 6) AS salience FROM dec")
def task_rise(spark, d):
    return op.risen(op.decayed(_dated(spark, d), ORDER_NOW, exempt=("note",)), ORDER_NOW).select("id", F.round("salience", 6).alias("salience"))


@BOOK.query(_M + "SELECT id, CASE WHEN id % 10 = 0 THEN 4 ELSE 3 END AS access_count, round(CASE WHEN id % 10 = 0 THEN least(salience + 0.05, 5.0) ELSE salience END, 6) AS salience FROM v_thought")
def access_reconsolidation(spark, d):
    rows = v.thoughts(spark, d).withColumn("access_count", F.lit(3))
    return op.reconsolidated(rows, rows.where("id % 10 = 0").select("id")).select("id", "access_count", F.round("salience", 6).alias("salience"))


@BOOK.query(_M + _COMM + "SELECT community_id, count(*) AS entities FROM mem WHERE entity_id IN (SELECT entity_id FROM v_mention WHERE thought_id % 500 = 7) GROUP BY 1 ORDER BY 1 LIMIT 50")
def dirty_communities(spark, d):
    return op.dirty_communities(v.thoughts(spark, d).where("id % 500 = 7").select("id"), v.mentions(spark, d), members(spark, d))


@BOOK.query(_M + """
, a AS (SELECT l2 AS c, string_agg(id::VARCHAR, ',' ORDER BY id) AS s FROM v_entity GROUP BY 1), b AS (SELECT CASE WHEN id % 400 = 0 THEN 'moved' ELSE l2 END || '!' AS c, string_agg(id::VARCHAR, ',' ORDER BY id) AS s FROM v_entity GROUP BY 1)
SELECT coalesce(a.c, b.c) AS community_id, CASE WHEN a.c IS NULL THEN 'new' WHEN b.c IS NULL THEN 'obsolete' ELSE 'kept' END AS state, sha256(coalesce(a.s, b.s)) AS fingerprint FROM a FULL JOIN b ON a.s = b.s""")
def community_diff(spark, d):
    after = v.entities(spark, d).select(F.concat(F.when(F.col("id") % 400 == 0, "moved").otherwise(F.col("l2")), F.lit("!")).alias("community_id"), F.col("id").alias("entity_id"))
    return op.community_diff(members(spark, d), after)


@BOOK.query("WITH u AS (SELECT o_custkey AS k, o_orderdate AS t_at, o_totalprice AS price, 0 AS n FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey, o_orderdate, o_totalprice, 1 FROM orders WHERE o_orderkey % 2 = 1) SELECT k, t_at AS \"at\", max(price) AS price FROM (SELECT *, rank() OVER (PARTITION BY k ORDER BY t_at DESC, n DESC, price DESC) AS r FROM u) WHERE r = 1 GROUP BY 1, 2")
def keyed_upsert(spark, d):
    rows = v.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias('at'), F.col("o_totalprice").alias("price"), "o_orderkey")
    best = lambda df: graph.latest(df, ["k"], F.desc('at'), F.desc("price")).drop("o_orderkey")
    return op.upserted(best(rows.where("o_orderkey % 2 = 0")), best(rows.where("o_orderkey % 2 = 1")), ["k"], 'at')


@BOOK.query(_M + "SELECT thought_id, entity_id, salience, source FROM v_mention WHERE source = 'manual' UNION ALL SELECT thought_id, entity_id, 0.5, 'ingest' FROM v_mention WHERE entity_id % 3 = 0 AND (thought_id, entity_id) NOT IN (SELECT thought_id, entity_id FROM v_mention WHERE source = 'manual')")
def rebuild_links(spark, d):
    m = v.mentions(spark, d)
    return op.rebuilt(m, m.where("entity_id % 3 = 0").select("thought_id", "entity_id", F.lit(0.5).alias("salience")))


@BOOK.query("WITH k AS (SELECT DISTINCT 'Brand#' || (p_partkey % 40) AS kind, p_partkey % 40 % 7 = 0 AS protected FROM part) SELECT kind FROM k WHERE NOT protected AND kind NOT IN (SELECT p_brand FROM part)")
def unused_kinds(spark, d):
    n = F.col("p_partkey") % 40
    kinds = v.table(spark, d, "part").select(F.concat(F.lit("Brand#"), n.cast("string")).alias("kind"), (n % 7 == 0).alias("protected")).distinct()
    return op.unused_kinds(kinds, v.entities(spark, d)).select("kind")


@BOOK.query("WITH k AS (SELECT DISTINCT 'Brand#' || (p_partkey % 40) AS kind, p_partkey % 40 % 7 = 0 AS protected, p_partkey % 40 AS n FROM part), g AS (SELECT kind FROM k WHERE NOT protected AND kind NOT IN (SELECT p_brand FROM part)), r AS (SELECT DISTINCT a.kind AS from_kind, b.kind AS to_kind FROM k a JOIN k b ON b.n IN (a.n + 1, a.n + 7)) SELECT * FROM r WHERE from_kind NOT IN (SELECT kind FROM g) AND to_kind NOT IN (SELECT kind FROM g)")
def pruned_relations(spark, d):
    n = (F.col("p_partkey") % 40).alias("n")
    kinds = v.table(spark, d, "part").select(n).distinct().select(F.concat(F.lit("Brand#"), F.col("n").cast("string")).alias("kind"), (F.col("n") % 7 == 0).alias("protected"), "n")
    nexts = kinds.select(F.col("kind").alias("from_kind"), F.explode(F.array(F.col("n") + 1, F.col("n") + 7)).alias("n"))
    allowed = nexts.join(kinds.select("n", F.col("kind").alias("to_kind")), "n").select("from_kind", "to_kind").distinct()
    return op.pruned_ontology(kinds.drop("n"), v.entities(spark, d), allowed)[1]


@BOOK.query(_M + """
, j AS (SELECT thought_id, entity_id, label, row_number() OVER (PARTITION BY thought_id ORDER BY m.salience DESC, entity_id) AS n FROM v_mention m JOIN v_entity e ON e.id = entity_id WHERE source = 'manual' AND project_status IS NOT NULL)
SELECT thought_id, entity_id, label FROM j WHERE n = 1""")
def thought_threads(spark, d):
    return op.threads(v.mentions(spark, d), v.entities(spark, d))


@BOOK.query(_M + _DECAY + f"""
, n AS (SELECT id, created_at, CASE WHEN category = 'task' AND lifecycle = 'open' THEN least(5.0::DOUBLE, greatest(salience, 1 + 0.15::DOUBLE * ({_AGE}))) ELSE salience END AS salience FROM dec)
, r AS (SELECT entity_id, thought_id, m.salience, n.salience AS own, created_at, row_number() OVER (PARTITION BY entity_id ORDER BY m.salience DESC, n.salience DESC, created_at DESC, thought_id) - 1 AS i FROM v_mention m JOIN n ON n.id = thought_id)
SELECT entity_id, i::INT AS i, thought_id, round(0.5 * salience + 0.3 * own + 0.2 / (1 + greatest({_AGE}, 0.0)) - 0.01 * i, 6) AS rank_score FROM r WHERE i < 20""")
def nightly_top_thoughts(spark, d):
    """What the nightly jobs in their order leave ready: entities' thoughts by the salience of that night."""
    m, e = v.mentions(spark, d), v.entities(spark, d)
    kinds = e.select(F.col("entity_type").alias("kind"), F.lit(False).alias("protected")).distinct()
    own = e.select(F.col("l2").alias("community_id"), F.col("l1").alias("parent_id"), F.col("id").alias("entity_id"))
    made = op.consolidated(_dated(spark, d), e, kinds, m, own, graph.comentions(m).where("weight >= 2"), ORDER_NOW, exempt=("note",))
    return made["top_thoughts"]


def night(spark, d):
    """One night's jobs over all tables: parts with the vectors of equal number, last night's communities by type."""
    m = v.mentions(spark, d)
    vec = v.vectors(spark, d).select("id", "vec")
    e = v.entities(spark, d).join(vec, "id", "left").withColumns({"tenant": F.lit(1).cast("long"), "project": F.col("project_status").isNotNull(), "created_at": F.col("id")})
    kinds = e.select(F.col("entity_type").alias("kind"), F.lit(False).alias("protected")).distinct()
    before = e.select(F.col("l2").alias("community_id"), F.col("id").alias("entity_id"))
    summaries = e.select(F.concat(F.lit("1:0:"), F.col("id").cast("string")).alias("community_id"), F.lit("2001-08-01").cast("timestamp_ntz").alias("generated_at")).where("id % 2 = 0")
    return nightly.nightly(_dated(spark, d), e, kinds, m, graph.comentions(m).where("weight >= 2"), ORDER_NOW, before, summaries, exempt=("note",), distance=0.75)


@BOOK.query()
def nightly_members(spark, d):
    """The communities that a whole night finds, after duplicate entities were merged and their relations moved."""
    return night(spark, d)["members"]


@BOOK.query("SELECT p_partkey AS id, CASE WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') THEN p_brand ELSE 'concept' END AS entity_type FROM part")
def repaired_types(spark, d):
    active = v.entities(spark, d).where(F.col("entity_type").isin("Brand#1", "Brand#2", "Brand#3")).select(F.col("entity_type").alias("kind"))
    return op.repaired_types(v.entities(spark, d), active).select("id", "entity_type")
