"""Agenda views over events sixty days on, with their orders' state; retrieval and queue rules beside."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recallspark.functions import calendar as c
from recallspark.operators import agenda as op, fuse, graph, links, retrieval, rollups, vector
from recallspark.plans.book import Book
from recallspark.plans.graph import strong_edges
from recallspark.plans.timeline import _NEAR, _SEC, near
from recallspark.plans.vectors import query_vector
from recallspark.sources import views as v
from recallspark.sources.views import ORDER_NOW, ctes
from recallspark.streaming import streams

BOOK = Book()

_NOW = f"TIMESTAMP '{ORDER_NOW}'"
_IT = ctes("v_event", "v_thought", "v_entity", "v_mention") + _NEAR + f""", it AS (SELECT e.event_id, e.thought_id, CASE WHEN e.thought_id % 11 = 0 THEN NULL ELSE e.start_at END AS start_at, CASE WHEN e.thought_id % 11 = 0 THEN NULL ELSE e.end_at END AS end_at, CASE WHEN e.minutes % 4 <> 0 THEN e.minutes END AS minutes, t.lifecycle,
  CASE WHEN e.thought_id % 6 = 0 THEN {_NOW} + INTERVAL 1 DAY END AS snoozed_until, CASE WHEN e.thought_id % 5 <> 0 THEN (e.thought_id % 40)::VARCHAR ELSE ' ' END AS project FROM near e JOIN v_thought t ON t.id = e.thought_id)
, se AS (SELECT *, CASE WHEN start_at IS NULL THEN 'unscheduled' ELSE {_SEC} END AS section, lifecycle = 'completed' AS done, lifecycle <> 'completed' AND coalesce(end_at::DATE < {_NOW}::DATE, false) AS prior FROM it)
"""


def items(spark, d):
    """Events with every eleventh order's undated, every sixth's snoozed and four fifths in projects."""
    o = F.col("thought_id")
    e = near(spark, d).join(v.thoughts(spark, d).select(F.col("id").alias("thought_id"), "lifecycle"), "thought_id")
    dated = lambda t: F.when(o % 11 != 0, F.col(t)).alias(t)
    snoozed = F.when(o % 6 == 0, c.plus_days(c.at(ORDER_NOW), 1))
    return e.select("event_id", "thought_id", dated("start_at"), dated("end_at"), F.when(F.col("minutes") % 4 != 0, F.col("minutes")).alias("minutes"), "lifecycle", snoozed.alias("snoozed_until"), F.when(o % 5 != 0, (o % 40).cast("string")).otherwise(" ").alias("project"))


@BOOK.query(_IT + f"SELECT event_id FROM se WHERE section IN ('today', 'unscheduled') OR (done AND start_at::DATE = {_NOW}::DATE)")
def today_view(spark, d):
    return op.today(items(spark, d), ORDER_NOW).select("event_id")


@BOOK.query(_IT + "SELECT event_id FROM se WHERE NOT done AND section IN ('tomorrow', 'this_week', 'later')")
def upcoming_view(spark, d):
    return op.upcoming(items(spark, d), ORDER_NOW).select("event_id")


@BOOK.query(_IT + "SELECT event_id FROM se WHERE (NOT done AND section IN ('today', 'unscheduled')) OR prior")
def today_todo(spark, d):
    return op.today_todo(items(spark, d), ORDER_NOW).select("event_id")


@BOOK.query(_IT + f"SELECT event_id FROM se WHERE (NOT done AND section IN ('today', 'unscheduled') AND (snoozed_until IS NULL OR snoozed_until <= {_NOW})) OR prior")
def open_todo_today(spark, d):
    return op.open_todo(items(spark, d), ORDER_NOW).select("event_id")


@BOOK.query(_IT + "SELECT event_id FROM se WHERE section = 'later' OR prior")
def overdue_merged(spark, d):
    rows = op.upcoming(items(spark, d).withColumn("lifecycle", F.lit("open")), ORDER_NOW).select("event_id", "start_at", "end_at")
    later = rows.where(F.to_date("start_at") >= F.date_add(F.to_date(c.at(ORDER_NOW)), 7))
    late = op.today_todo(items(spark, d), ORDER_NOW).where(F.to_date("end_at") < F.to_date(c.at(ORDER_NOW)))
    return op.merged(later, late).select("event_id")


@BOOK.query(_IT + "SELECT lifecycle, sum(coalesce(minutes, 30))::BIGINT AS minutes FROM it GROUP BY 1")
def estimated_minutes(spark, d):
    return op.estimated_minutes(items(spark, d), "lifecycle")


@BOOK.query("SELECT DISTINCT trim(t) AS tag FROM (SELECT unnest([' ' || p_brand || ' ', p_type, ' ']) AS t FROM part) WHERE trim(t) <> ''")
def distinct_tags(spark, d):
    rows = v.table(spark, d, "part").select(F.array(F.concat(F.lit(" "), "p_brand", F.lit(" ")), F.col("p_type"), F.lit(" ")).alias("tags"))
    return op.distinct_tags(rows)


@BOOK.query(_IT + "SELECT DISTINCT e AS energy, CASE e WHEN 'deep' THEN 1 ELSE 3 END::INT AS place FROM (SELECT CASE thought_id % 3 WHEN 0 THEN 'deep' WHEN 1 THEN 'light' ELSE 'none' END AS e FROM it) WHERE e <> 'none'")
def energy_levels(spark, d):
    k = F.col("thought_id") % 3
    return op.energy_levels(items(spark, d).select(F.when(k == 0, "deep").when(k == 1, "light").otherwise("none").alias("energy")))


@BOOK.query(_IT + "SELECT nullif(trim(project), '') AS project, CASE WHEN trim(project) = '' THEN NULL WHEN project::INT % 2 = 0 THEN 'P' || project ELSE project END AS label, count(*) AS items, sum(coalesce(minutes, 30))::BIGINT AS minutes FROM (SELECT project, minutes FROM it) GROUP BY 1, 2".replace("project::INT", "TRY_CAST(project AS INT)"))
def items_by_project(spark, d):
    label = F.when(F.expr("try_cast(project as int)") % 2 == 0, F.concat(F.lit("P"), "project")).otherwise(" ")
    return op.by_project(items(spark, d).withColumn("project_label", label))


@BOOK.query("SELECT doc_id AS id FROM documents WHERE contains(lower(text), 'mentre') OR contains(lower(source), 'mentre')")
def item_search(spark, d):
    return op.found(v.notes(spark, d), "  Mentre ", "text", "tenant").select("id")


@BOOK.query(ctes("v_thought") + "SELECT CASE WHEN lifecycle IN ('completed', 'archived') THEN lifecycle ELSE 'open' END AS col, count(*) AS n FROM v_thought GROUP BY 1")
def kanban_columns(spark, d):
    return v.thoughts(spark, d).groupBy(op.kanban(F.col("lifecycle")).alias("col")).agg(F.count("*").alias("n"))


_PLACED = """, o AS (SELECT o_orderkey AS id, o_orderdate + to_minutes((o_orderkey % 1440)::INT) AS s, (o_orderkey % 5 + 1)::INT AS step FROM orders)
, x AS (SELECT id, s + to_days((i * step)::INT) AS start_at FROM o, range(60) r(i) WHERE s + to_days((i * step)::INT) >= TIMESTAMP '1999-01-04' AND s + to_days((i * step)::INT) < TIMESTAMP '1999-01-11')
, p AS (SELECT id, start_at, (start_at::DATE - DATE '1999-01-04')::INT AS day, (hour(start_at) * 60 + minute(start_at))::DOUBLE AS m FROM x)"""


@BOOK.query(ctes("v_thought") + _PLACED + " SELECT id, day, greatest(m, 360.0) AS from_minute, least(m + 60, 1320.0) AS to_minute FROM p WHERE least(m + 60, 1320.0) > greatest(m, 360.0)")
def week_placements(spark, d):
    """Orders that come again every few days, at most sixty times, on the sheet of one week."""
    none = F.lit(None)
    o = v.table(spark, d, "orders").withColumn("s", F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("o_orderkey") % 1440).cast("int")))
    o = o.where((F.col("s") < c.at("1999-01-11")) & (F.col("s") >= c.at("1998-03-01")))
    times = c.occurrences(F.lit("DAILY"), (F.col("o_orderkey") % 5 + 1).cast("int"), none.cast("int"), F.col("s") + F.make_dt_interval((F.col("o_orderkey") % 5 + 1).cast("int") * 59), none.cast("array<int>"), F.col("s"), c.at("1999-01-04"), c.at("1999-01-11"))
    rows = o.select(F.col("o_orderkey").alias("id"), F.explode(times).alias("start_at")).withColumn("end_at", F.lit(None).cast("timestamp_ntz"))
    return op.week_placements(rows, "1999-01-04").select("id", "day", "from_minute", "to_minute")


_Q = "(SELECT vec FROM v_vec WHERE id = 0)"


@BOOK.query(ctes("v_vec") + f"SELECT id, round(1.0::DOUBLE / row_number() OVER (ORDER BY list_cosine_distance(vec, {_Q}), id), 9) AS temporal FROM v_vec WHERE TIMESTAMP '2024-01-01' + to_days((id % 90)::INT) < TIMESTAMP '2024-02-01' AND TIMESTAMP '2024-01-03' + to_days((id % 90)::INT) > TIMESTAMP '2024-01-20' ORDER BY list_cosine_distance(vec, {_Q}), id LIMIT 24")
def temporal_channel(spark, d):
    start = c.plus_days(c.at("2024-01-01"), F.col("id") % 90)
    rows = v.vectors(spark, d).withColumns({"start_at": start, "end_at": c.plus_days(start, 2)})
    return retrieval.temporal_channel(rows, query_vector(spark, d), within=("2024-01-20", "2024-02-01")).select("id", F.round("temporal", 9).alias("temporal"))


@BOOK.query(ctes("v_vec") + """, q AS (SELECT id AS q, vec FROM v_vec WHERE id IN (0, 1, 2)), r AS (SELECT q, v.id, list_cosine_distance(v.vec, q.vec) AS distance FROM v_vec v, q), k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, id) AS n FROM r)
SELECT id, round(min(distance), 6) AS distance FROM k WHERE n <= 10 GROUP BY 1""")
def event_seeds(spark, d):
    found = retrieval.event_seeds(v.vectors(spark, d), [query_vector(spark, d, n) for n in (0, 1, 2)], 10)
    return found.select("id", F.round("distance", 6).alias("distance"))


@BOOK.query(ctes("v_vec") + """, o AS (SELECT id, 1 - list_cosine_distance(vec, """ + _Q + """) AS score FROM v_vec WHERE id <> 0 ORDER BY 2 DESC, 1 LIMIT 20)
, s AS (SELECT id, 1 - list_cosine_distance(vec, (SELECT vec FROM v_vec WHERE id = 1)) AS score FROM v_vec WHERE id > 1 ORDER BY 2 DESC, 1 LIMIT 10)
, l AS (SELECT 0 AS list, id, row_number() OVER (ORDER BY score DESC, id) AS rank, score FROM o UNION ALL SELECT 1, id, row_number() OVER (ORDER BY score DESC, id), score FROM s)
, f AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min(list * 1000 + rank) AS first, max(score) AS score, bool_or(list = 0) AS original FROM l GROUP BY 1)
SELECT id, round(score, 6) AS score, original, row_number() OVER (ORDER BY rrf DESC, first)::INT AS place FROM f QUALIFY place <= 15""")
def expansion_fusion(spark, d):
    near_to = lambda n, k: vector.top_k(v.vectors(spark, d).where(F.col("id") > n), "id", "vec", query_vector(spark, d, n), k).select("id", (1 - F.col("distance")).alias("score"))
    found = fuse.expanded(near_to(0, 20), [near_to(1, 10)])
    return fuse.reranked(found, 15).select("id", F.round("score", 6).alias("score"), "original", "place")


@BOOK.query("WITH r AS (SELECT l_orderkey AS source_id, l_partkey * 3 + 1 AS target_id, CASE WHEN l_linenumber % 3 = 0 THEN 'contradicts' ELSE 'supports' END AS relation_type FROM lineitem), s AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 2 = 0) SELECT DISTINCT source_id, target_id FROM r WHERE relation_type = 'contradicts' AND source_id IN (FROM s) AND target_id IN (FROM s)")
def contradictions(spark, d):
    kind = F.when(F.col("l_linenumber") % 3 == 0, "contradicts").otherwise("supports")
    rows = v.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source_id"), (F.col("l_partkey") * 3 + 1).alias("target_id"), kind.alias("relation_type"))
    return graph.contradictions(rows, v.thoughts(spark, d).where("id % 2 = 0").select("id")).distinct()


@BOOK.query(ctes("v_thought", "v_entity", "v_mention") + """, e AS (SELECT a.entity_id AS a, b.entity_id AS b FROM v_mention a JOIN v_mention b ON a.thought_id = b.thought_id AND a.entity_id < b.entity_id GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT (SELECT count(*) FROM v_thought) AS thoughts, (SELECT count(*) FROM v_entity) AS entities, (SELECT count(*) FROM e) AS edges, (SELECT count(DISTINCT l1) FROM v_entity) AS communities, (SELECT count(*) FROM v_entity WHERE project_status IS NOT NULL) AS projects""")
def graph_metrics(spark, d):
    e = v.entities(spark, d)
    return graph.metrics(v.thoughts(spark, d), e, strong_edges(spark, d), e.select("l1").distinct())


@BOOK.query("""WITH m AS (SELECT p_type AS community_id, p_name AS label, p_partkey AS entity_id FROM part), c AS (SELECT community_id, count(*) AS members FROM m GROUP BY 1 ORDER BY members DESC, community_id LIMIT 12)
, p AS (SELECT community_id, label, entity_id, row_number() OVER (PARTITION BY community_id ORDER BY entity_id) AS n FROM m) SELECT c.community_id, members, string_agg(label, ', ' ORDER BY entity_id) AS preview FROM c JOIN p USING (community_id) WHERE n <= 4 GROUP BY 1, 2""")
def largest_communities(spark, d):
    rows = v.table(spark, d, "part").select(F.col("p_type").alias("community_id"), F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("label"))
    return links.largest_communities(rows, 12)


@BOOK.query(ctes("v_account") + "SELECT user_id, name FROM v_account ORDER BY available_credits ASC NULLS LAST, lower(name), user_id LIMIT 30")
def account_sorted(spark, d):
    return rollups.sorted_by(v.accounts(spark, d), "available_credits", "asc", allowed=("name", "available_credits"), default="name", tie="name", key="user_id").limit(30).select("user_id", "name")


@BOOK.query(ctes("v_account") + "SELECT user_id FROM v_account WHERE lower(name) = lower('CUSTOMER#000000007')")
def account_by_name(spark, d):
    return v.accounts(spark, d).where(rollups.same_text(F.col("name"), "CUSTOMER#000000007")).select("user_id")


@BOOK.query(ctes("v_vec") + """, n AS (SELECT count(*) AS n FROM v_vec), p AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM v_vec), a AS (SELECT id, i, 1 - 2 * (i + 0.5::DOUBLE) / n AS y, i * pi() * (3 - sqrt(5.0::DOUBLE)) AS t FROM p, n)
, r AS (SELECT id, cos(t) * sqrt(1 - y * y) AS x, y, sin(t) * sqrt(1 - y * y) AS z FROM a), m AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM r), s AS (SELECT id, x - mx AS x, y - my AS y, z - mz AS z FROM r, m), g AS (SELECT max(sqrt(x * x + y * y + z * z)) AS far FROM s)
SELECT id, round(x / far, 6) AS x, round(y / far, 6) AS y, round(z / far, 6) AS z FROM s, g""")
def sphere_projection(spark, d):
    return vector.on_sphere(v.vectors(spark, d).select("id"))


_REM = "SELECT event_id AS job_id, ts AS fire_at, ts + to_hours((event_id % 40)::INT) AS start_at, CASE WHEN event_id % 9 = 0 THEN 'done' ELSE 'open' END AS lifecycle FROM events"


@BOOK.query(f"WITH j AS ({_REM}), x AS (SELECT * FROM j WHERE fire_at <= TIMESTAMP '2024-01-15' ORDER BY fire_at, job_id LIMIT 200) SELECT job_id, CASE WHEN lifecycle <> 'open' OR start_at <= TIMESTAMP '2024-01-15' OR TIMESTAMP '2024-01-15' - fire_at > INTERVAL 24 HOUR THEN 'skipped' ELSE 'sent' END AS status FROM x")
def reminder_tick(spark, d):
    e = v.table(spark, d, "events")
    start = F.col("ts") + F.make_dt_interval(F.lit(0), (F.col("event_id") % 40).cast("int"))
    rows = e.select(F.col("event_id").alias("job_id"), F.col("ts").alias("fire_at"), start.alias("start_at"), F.when(F.col("event_id") % 9 == 0, "done").otherwise("open").alias("lifecycle"))
    return streams.reminder_tick(rows, "2024-01-15 00:00:00").select("job_id", "status")


@BOOK.query(ctes("v_job") + ", p AS (SELECT job_id, attempts, job_id % 3 = 0 AS failed FROM v_job WHERE status = 'pending' AND attempts < 3 ORDER BY run_after, job_id LIMIT 20) SELECT job_id, attempts + 1 AS attempts, CASE WHEN NOT failed THEN 'completed' WHEN attempts + 1 >= 3 THEN 'failed' ELSE 'pending' END AS status FROM p")
def sync_attempts(spark, d):
    taken = streams.next_attempts(v.jobs(spark, d), 20, most=3)
    return streams.after_attempt(taken.withColumn("ok", F.col("job_id") % 3 != 0), most=3).select("job_id", "attempts", "status")


@BOOK.query("SELECT kind, place, r_name AS region FROM region CROSS JOIN (VALUES ('person', 1), ('place', 2), ('project', 3)) t(kind, place)")
def seeded_kinds(spark, d):
    kinds = spark.createDataFrame([("person", 1), ("place", 2), ("project", 3)], "kind string, place int")
    return v.table(spark, d, "region").select(F.col("r_name").alias("region")).crossJoin(F.broadcast(kinds))
