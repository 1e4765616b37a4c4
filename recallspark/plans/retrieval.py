"""Lexical, fused and hybrid retrieval over documents, their vectors and made-up links."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from recallspark.functions import text as t
from recallspark.operators import fuse, index, lexical, retrieval as op, vector
from recallspark.plans.book import Book
from recallspark.plans.vectors import query_vector
from recallspark.session import new_folder
from recallspark.sources import views as v
from recallspark.sources.views import ctes

BOOK = Book()

WORDS = ["the", "de", "und", "para", "mentre"]
_TOK = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
_COUNT = " + ".join(f"least(len(list_filter(tok, lambda x: x = '{w}')), 256)" for w in WORDS)


def _lex(source: str) -> str:
    return f"lx AS (SELECT id, 0.1::DOUBLE * ({_COUNT})::DOUBLE AS raw FROM (SELECT id, {_TOK} AS tok FROM {source}))"


@BOOK.query(ctes("v_note") + f", {_lex('v_note')} SELECT id, round(raw, 6) AS raw, round(least(1.0, raw * 2.5), 6) AS rank FROM lx WHERE raw > 0 ORDER BY raw DESC, id LIMIT 30")
def lexical_search(spark, d):
    return lexical.search(v.notes(spark, d), WORDS, 30).select("id", F.round("raw", 6).alias("raw"), F.round("rank", 6).alias("rank"))


_CUED = ", cued AS (SELECT id, coalesce(text, '') || ' ' || concat_ws(' ', tenant, category) AS text FROM v_note WHERE id % 11 <> 0)"


@BOOK.query(ctes("v_note") + _CUED + f", {_lex('cued')} SELECT id, round(raw, 6) AS raw, round(least(1.0, raw * 2.5), 6) AS rank FROM lx WHERE raw > 0 ORDER BY raw DESC, id LIMIT 30")
def index_search(spark, d):
    # The first batch has old texts without cues, the second what they are now, the third takes some away.
    notes, kept = v.notes(spark, d), index.Postings(spark, new_folder(spark, "postings"))
    kept.put(notes.select("id", F.concat_ws(" ", F.lit("the the draft"), "category").alias("text")), 0)
    kept.put(notes.select("id", "text", F.array_compact(F.array("tenant", "category")).alias("cues")), 1)
    kept.put(notes.limit(0).select("id", "text"), 2, gone=notes.where("id % 11 = 0").select("id"))
    return kept.search(WORDS, 30).select("id", F.round("raw", 6).alias("raw"), F.round("rank", 6).alias("rank"))


@BOOK.query("WITH v_item AS (SELECT item_id AS id, text FROM benchmark), " + _lex("v_item") + " SELECT id, round(raw, 6) AS raw FROM lx WHERE raw > 0 ORDER BY raw DESC, id LIMIT 50")
def note_search(spark, d):
    rows = v.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return lexical.search(rows, WORDS, 50).select("id", F.round("raw", 6).alias("raw"))


@BOOK.query(ctes("v_note") + f", x AS (SELECT id, {_TOK} AS tok FROM v_note) SELECT id, len(tok)::INT AS n, len(list_distinct(tok))::INT AS n_distinct FROM x")
def lexical_tokens(spark, d):
    return v.notes(spark, d).select("id", t.tokens(F.col("text")).alias("tok")).select("id", F.size("tok").alias("n"), F.size(F.array_distinct("tok")).alias("n_distinct"))


@BOOK.query()
def lexical_fold(spark, d):
    return v.notes(spark, d).select("id", F.sha2(t.folded(F.col("text")), 256).alias("folded_sha256"))


_LISTS = """v AS (SELECT 0 AS list, id, row_number() OVER (ORDER BY list_cosine_distance(vec, (SELECT vec FROM v_vec WHERE id = 0)), id) AS rank FROM v_vec WHERE id <> 0 QUALIFY rank <= 30)
, l AS (SELECT 1 AS list, id, row_number() OVER (ORDER BY raw DESC, id) AS rank FROM lx WHERE raw > 0 QUALIFY rank <= 30)
, f AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min(list * 1000 + rank) AS first FROM (SELECT * FROM v UNION ALL SELECT * FROM l) GROUP BY 1)"""


def lists(spark, d):
    near = vector.top_k(v.vectors(spark, d).where("id <> 0"), "id", "vec", query_vector(spark, d), 30)
    told = lexical.search(v.notes(spark, d), WORDS, 30)
    place = lambda df, n, *o: df.select(F.lit(n).alias("list"), "id", F.row_number().over(Window.orderBy(*o)).alias("rank"))
    return place(near, 0, "distance", "id").unionByName(place(told, 1, F.desc("raw"), "id"))


@BOOK.query(ctes("v_vec", "v_note") + f", {_lex('v_note')}, {_LISTS} SELECT id, round(rrf, 9) AS rrf FROM f")
def rrf_fuse(spark, d):
    return fuse.rrf(lists(spark, d)).select("id", F.round("rrf", 9).alias("rrf"))


@BOOK.query(ctes("v_vec", "v_note") + f", {_lex('v_note')}, {_LISTS} SELECT id, round(rrf, 9) AS rrf FROM f ORDER BY rrf DESC, first LIMIT 15")
def expansion_candidates(spark, d):
    return fuse.rrf(lists(spark, d)).orderBy(F.desc("rrf"), "first").limit(15).select("id", F.round("rrf", 9).alias("rrf"))


def memory(spark, d) -> op.Memory:
    """Documents with a vector of the same number; features, bundles and links are arithmetic on the id."""
    i = F.col("id")
    notes = v.notes(spark, d).join(v.vectors(spark, d), "id").select(
        "id", (i % 50).alias("user_id"), "vec", "text", "tenant", "label", (i % 13 != 0).alias("active"), ((i % 50) / 10).alias("salience"), ((i % 7) / 7).alias("centrality"), ((i % 5) / 5).alias("specificity"), ((i % 9) / 9).alias("recency"), F.array(F.concat(F.lit("c"), F.col("label").cast("string"))).alias("communities"),
    )

    def group(key, name):
        best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("salience"), "id"))
        top = notes.withColumn("k", best).where("k <= 20").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("k", "id"))).alias("t"))
        return notes.groupBy(key).agg(F.min_by("vec", "id").alias("vec")).join(top, key).select(F.col(key).cast("string").alias(name), "vec", F.col("t.id").alias("thought_ids"))

    n = notes.count()
    links = notes.select(i.alias("thought_id"), ((i * 7 + 3) % n).alias("neighbor_id"), (1 / (1 + i % 4)).alias("weight")).unionByName(notes.select(i.alias("thought_id"), ((i * 3 + 1) % n).alias("neighbor_id"), F.lit(0.5).alias("weight"))).unionByName(notes.select(i.alias("thought_id"), ((i + 11) % n).alias("neighbor_id"), F.lit(0.7).alias("weight")))
    temporal = notes.where("id % 97 = 5").select("id", (1 / (1 + F.floor(i / 97))).alias("temporal"))
    return op.Memory(notes, group("label", "community_id"), group("tenant", "entity_id"), links, temporal)


_MEM = """, n AS (SELECT id, vec, text, tenant, label, id % 13 <> 0 AS active, (id % 50) / 10.0::DOUBLE AS salience, (id % 7) / 7.0::DOUBLE AS centrality, (id % 5) / 5.0::DOUBLE AS specificity, (id % 9) / 9.0::DOUBLE AS recency FROM v_note JOIN v_vec USING (id))
, q AS (SELECT vec FROM v_vec WHERE id = 0)
, na AS (SELECT id, text FROM n WHERE active), """ + _lex("na") + """
, vc AS (SELECT n.id, list_cosine_distance(n.vec, q.vec) AS distance FROM n, q WHERE active ORDER BY 2, 1 LIMIT 30)
, lc AS (SELECT id, least(1.0::DOUBLE, raw * 2.5) AS rank FROM lx WHERE raw > 0 ORDER BY raw DESC, id LIMIT 20)
, cv AS (SELECT label, min_by(vec, id) AS vec FROM n GROUP BY 1), cd AS (SELECT label, list_cosine_distance(cv.vec, q.vec) AS distance FROM cv, q ORDER BY 2, label::VARCHAR LIMIT 12)
, ct AS (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY salience DESC, id) AS k FROM n)
, bc AS (SELECT id, distance, row_number() OVER (ORDER BY distance, label::VARCHAR, k) AS pos FROM ct JOIN cd USING (label) WHERE k <= 20)
, ev AS (SELECT tenant, min_by(vec, id) AS vec FROM n GROUP BY 1), ed AS (SELECT tenant, list_cosine_distance(ev.vec, q.vec) AS distance FROM ev, q ORDER BY 2, 1 LIMIT 32)
, et AS (SELECT tenant, id, row_number() OVER (PARTITION BY tenant ORDER BY salience DESC, id) AS k FROM n)
, ec AS (SELECT id, distance, row_number() OVER (ORDER BY distance, tenant, k) AS pos FROM et JOIN ed USING (tenant) WHERE k <= 5 AND distance < 0.95)
, nb AS (SELECT id AS s, (id * 7 + 3) % (SELECT count(*) FROM n) AS t, 1 / (1 + id % 4)::DOUBLE AS w FROM n UNION ALL SELECT id, (id * 3 + 1) % (SELECT count(*) FROM n), 0.5 FROM n UNION ALL SELECT id, (id + 11) % (SELECT count(*) FROM n), 0.7 FROM n)
, nl AS (SELECT * FROM nb WHERE s IN (SELECT id FROM vc ORDER BY distance, id LIMIT 10) ORDER BY w DESC, t, s LIMIT 40)
, nk AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY w DESC, t) AS k FROM nl)
, nc AS (SELECT t AS id, row_number() OVER (ORDER BY w DESC, t, s) AS pos FROM nk WHERE k <= 2)
, tc AS (SELECT id, 1 / (1 + id // 97)::DOUBLE AS temporal, row_number() OVER (ORDER BY 1 / (1 + id // 97)::DOUBLE DESC, id) AS pos FROM n WHERE id % 97 = 5 QUALIFY pos <= 100)
, u AS (SELECT id, 0 AS ch, 0 AS pos, distance, NULL::DOUBLE AS rank, NULL::DOUBLE AS cdist, NULL::DOUBLE AS edist, NULL::DOUBLE AS temporal FROM vc UNION ALL SELECT id, 1, 0, NULL, rank, NULL, NULL, NULL FROM lc UNION ALL SELECT id, 2, pos, NULL, NULL, distance, NULL, NULL FROM bc
  UNION ALL SELECT id, 3, pos, NULL, NULL, NULL, distance, NULL FROM ec UNION ALL SELECT id, 4, pos, NULL, NULL, NULL, NULL, NULL FROM nc UNION ALL SELECT id, 5, pos, NULL, NULL, NULL, NULL, temporal FROM tc)
, g AS (SELECT id, min(distance) AS distance, max(rank) AS rank, min(cdist) AS cdist, min(edist) AS edist, max(temporal) AS temporal, list_distinct(list(ch)) AS chs, min(ch * 100000 + pos) AS first FROM u GROUP BY 1)
, mg AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN rank IS NOT NULL THEN 0 WHEN distance IS NOT NULL THEN 1 ELSE 2 END, CASE WHEN rank IS NOT NULL THEN -rank ELSE distance END NULLS FIRST, CASE WHEN rank IS NULL AND distance IS NULL THEN first END NULLS FIRST, id)::INT AS merge_pos FROM g)
, h AS (SELECT mg.*, n.* EXCLUDE (id, vec, text) FROM mg JOIN n USING (id) WHERE merge_pos <= 80 AND active)
, cr AS (SELECT label, count(*) AS members FROM h GROUP BY 1)
, sc AS (SELECT h.id, merge_pos, rank, chs, greatest(0.0, 1 - edist) AS esim, centrality,
    CASE WHEN distance IS NOT NULL OR rank > 0 THEN greatest(coalesce(greatest(0.0, 1 - distance), 0.0), coalesce(rank, 0.0)) WHEN list_contains(chs, 1) THEN 0.35 ELSE 0.2 END::DOUBLE AS thought,
    least(0.15::DOUBLE, CASE WHEN list_contains(chs, 2) THEN 0.05 ELSE 0 END::DOUBLE + CASE WHEN cdist IS NOT NULL AND members > 2 THEN 0.02 ELSE 0 END::DOUBLE) AS redundancy,
    CASE WHEN list_contains(chs, 0) OR list_contains(chs, 1) THEN 0.25::DOUBLE * coalesce(greatest(0.0, 1 - cdist), 0) + 0.10::DOUBLE * coalesce(greatest(0.0, 1 - edist), 0) + 0.08::DOUBLE * centrality + 0.05::DOUBLE * specificity + 0.04::DOUBLE * least(salience / 5, 1) + 0.06::DOUBLE * recency ELSE 0 END AS inner_part, coalesce(temporal, 0) AS temporal
  FROM h JOIN cr USING (label))
, so AS (SELECT id, merge_pos, rank AS lexical, 0.42::DOUBLE * thought + inner_part - redundancy + 0.18::DOUBLE * temporal AS score, thought AS vector_score, coalesce(esim, 0) + 0.5 * centrality AS graph_score, redundancy, CASE WHEN list_contains(chs, 2) THEN 'bundle' WHEN list_contains(chs, 3) THEN 'entity' WHEN list_contains(chs, 4) THEN 'neighbor' WHEN list_contains(chs, 5) THEN 'temporal' ELSE 'direct' END AS provenance FROM sc)
, rs AS (SELECT id, 0 AS c, row_number() OVER (ORDER BY lexical DESC, id) AS p FROM so WHERE lexical > 0 QUALIFY p <= 5)
, po AS (SELECT id, row_number() OVER (ORDER BY c, p)::INT AS pool_pos FROM (SELECT * FROM rs UNION ALL SELECT id, 1, row_number() OVER (ORDER BY score DESC, id) FROM so WHERE id NOT IN (SELECT id FROM rs)))
"""
_HYBRID = ctes("v_note", "v_vec") + _MEM


def _scored(spark, d):
    m = memory(spark, d)
    return op.scored(op.merged(op.candidates(m, query_vector(spark, d), WORDS, 0.95)), m.notes)


@BOOK.query(_HYBRID + "SELECT id, merge_pos, round(score, 6) AS score, round(redundancy, 6) AS redundancy, provenance FROM so")
def weighted_merge(spark, d):
    return _scored(spark, d).select("id", "merge_pos", F.round("score", 6).alias("score"), F.round("redundancy", 6).alias("redundancy"), "provenance")


@BOOK.query(_HYBRID + "SELECT id, pool_pos FROM po WHERE pool_pos <= 15")
def rerank_pool(spark, d):
    return fuse.pool(_scored(spark, d)).select("id", "pool_pos")


@BOOK.query(_HYBRID + "SELECT id, round(score, 6) AS score, round(vector_score, 6) AS vector_score, round(graph_score, 6) AS graph_score, provenance, pool_pos FROM so JOIN po USING (id) WHERE pool_pos <= 15")
def hybrid_search(spark, d):
    found = op.search(memory(spark, d), query_vector(spark, d), WORDS, entity_distance=0.95)
    return found.select("id", F.round("score", 6).alias("score"), F.round("vector_score", 6).alias("vector_score"), F.round("graph_score", 6).alias("graph_score"), "provenance", "pool_pos")


@BOOK.query(_HYBRID + """, p AS (SELECT *, CASE WHEN vector_score + graph_score <= 1e-12 THEN 0 ELSE vector_score / (vector_score + graph_score) END AS share FROM so JOIN po USING (id) WHERE pool_pos <= 15)
SELECT count(*) AS n, round(avg(share), 6) AS mean_share, round(min_by(share, pool_pos), 6) AS top_share, count(*) FILTER (vector_score <= 1e-12 AND graph_score > 1e-12) AS graph_only, CASE WHEN avg(share) >= 0.5 THEN 'semantic' ELSE 'graph' END AS "primary" FROM p""")
def retrieval_diagnostics(spark, d):
    return op.diagnostics(op.search(memory(spark, d), query_vector(spark, d), WORDS, entity_distance=0.95))


@BOOK.query(_HYBRID + "SELECT count(*) FILTER (least(greatest(score, 0), 1) >= 0.22) AS kept, round(max(least(greatest(score, 0), 1)) FILTER (least(greatest(score, 0), 1) < 0.22), 6) AS best_below FROM so")
def relevance_floor(spark, d):
    return fuse.floored(_scored(spark, d)).select("kept", F.round("best_below", 6).alias("best_below"))


@BOOK.query(_HYBRID + ", t AS (SELECT score FROM so JOIN po USING (id) WHERE pool_pos <= 15 ORDER BY score DESC LIMIT 2) SELECT count(*) <= 1 OR max(score) - min(score) >= 0.15 AS skip FROM t")
def skip_rerank(spark, d):
    return fuse.skips_rerank(fuse.pool(_scored(spark, d)))


@BOOK.query("""WITH w AS (SELECT p_partkey AS entity_id, lower(p_name) AS label FROM part), s AS (SELECT p_partkey AS id, lower(p_name) AS text FROM part)
SELECT id, entity_id, 1::BIGINT AS hits FROM s JOIN w ON text = label OR contains(text, label || ' ') AND contains(' ' || text || ' ', ' ' || label || ' ') OR contains(text, ' ' || label) AND contains(' ' || text || ' ', ' ' || label || ' ')""")
def label_hits(spark, d):
    part = v.table(spark, d, "part")
    labels = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"))
    return lexical.label_hits(part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), labels)


@BOOK.query("""WITH w AS (SELECT min(p_partkey) AS entity_id, lower(p_name) AS label, p_brand FROM part GROUP BY 2, 3), s AS (SELECT p_partkey AS id, lower(p_name) AS text FROM part)
, h AS (SELECT id, entity_id, row_number() OVER (PARTITION BY id ORDER BY entity_id)::INT AS place FROM s JOIN w ON contains(' ' || text || ' ', ' ' || label || ' ')) SELECT * FROM h WHERE place <= 12""")
def label_hints(spark, d):
    part = v.table(spark, d, "part")
    labels = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_brand").alias("entity_type"))
    return lexical.label_hints(part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), labels)


@BOOK.query("""WITH s AS (SELECT item_id AS id, text, TIMESTAMP '2024-01-01' + to_days(item_id::INT) AS made_at FROM benchmark), x AS (SELECT id, list_contains(""" + _TOK + """, 'zzz') AS hit, made_at FROM s)
SELECT id, false AS hit FROM x WHERE NOT hit ORDER BY made_at DESC, id LIMIT 3""")
def summaries_newest(spark, d):
    return lexical.search_or_newest(_summaries(spark, d), ["zzz"], 10).select("id", "hit")


@BOOK.query("""WITH s AS (SELECT item_id AS id, text, TIMESTAMP '2024-01-01' + to_days(item_id::INT) AS made_at FROM benchmark), x AS (SELECT id, len(list_intersect(""" + _TOK + """, ['the', 'de'])) > 0 AS hit, made_at FROM s)
SELECT id, hit FROM x WHERE hit ORDER BY made_at DESC, id LIMIT 10""")
def summaries_or_newest(spark, d):
    return lexical.search_or_newest(_summaries(spark, d), ["the", "de"], 10).select("id", "hit")


def _summaries(spark, d):
    return v.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text", (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("item_id").cast("int"))).alias("at"))
