"""Evaluation metrics, communities, entity merging, streams and exports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recallspark.operators import changes, community, graph, metrics, vector
from recallspark.plans.book import Book
from recallspark.plans.vectors import query_vector
from recallspark.session import new_folder
from recallspark.sources import exports, views as v
from recallspark.sources.views import ctes
from recallspark.streaming import arrivals, queues, streams

BOOK = Book()


@BOOK.query(ctes("v_vec") + """
, r AS (SELECT id, label, row_number() OVER (ORDER BY list_cosine_distance(vec, (SELECT vec FROM v_vec WHERE id = 0)), id) AS rank FROM v_vec WHERE id <> 0)
, g AS (SELECT id, CASE WHEN label = (SELECT label FROM v_vec WHERE id = 0) THEN 1 + id % 3 ELSE 0 END AS grade FROM v_vec WHERE id <> 0), i AS (SELECT *, row_number() OVER (ORDER BY grade DESC, id) AS i FROM g WHERE grade > 0)
, b AS (SELECT count(*) AS relevant, sum((pow(2.0::DOUBLE, grade) - 1) / log2(i + 1)) FILTER (i <= 50) AS ideal FROM i), h AS (SELECT count(*) AS hits, min(rank) AS first, sum((pow(2.0::DOUBLE, grade) - 1) / log2(rank + 1)) AS dcg FROM r JOIN g USING (id) WHERE grade > 0 AND rank <= 50)
SELECT 0::INT AS query, round(coalesce(hits / relevant::DOUBLE, 0), 6) AS recall, round(coalesce(1 / first::DOUBLE, 0), 6) AS mrr, round(coalesce(dcg / ideal, 0), 6) AS ndcg FROM b, h""")
def ndcg_recall_mrr(spark, d):
    rows = v.vectors(spark, d)
    wanted = rows.where("id = 0").select(F.col("label").alias("own"))
    found = vector.top_k(rows.where("id <> 0"), "id", "vec", query_vector(spark, d), 50)
    ranked = found.select(F.lit(0).alias("query"), "id", F.row_number().over(Window.orderBy("distance", "id")).alias("rank"))
    grades = rows.where("id <> 0").join(F.broadcast(wanted), F.lit(True)).select(F.lit(0).alias("query"), "id", F.when(F.col("label") == F.col("own"), 1 + F.col("id") % 3).otherwise(0).alias("grade"))
    return metrics.ranking(ranked, grades, 50)


@BOOK.query("WITH a AS (SELECT doc_id AS q, 'b' || (doc_id % 4) AS bucket, quality AS e, CASE WHEN doc_id % 9 <> 0 THEN toxic END AS n FROM labels) SELECT bucket, count(*) AS n, round(avg(e), 6) AS accuracy, round(avg(e) - avg(n), 6) AS lift FROM a WHERE e IS NOT NULL AND n IS NOT NULL GROUP BY 1")
def group_accuracy_lift(spark, d):
    rows = v.table(spark, d, "labels").withColumn("bucket", F.concat(F.lit("b"), (F.col("doc_id") % 4).cast("string")))
    one = lambda name, col: rows.select(F.col("doc_id").alias("question"), "bucket", F.lit(name).alias("variant"), F.col(col).alias("correct"))
    return metrics.accuracy_lift(one("evidence", "quality").unionByName(one("none", "toxic").where("question % 9 <> 0")), "bucket")


@BOOK.query("SELECT event_type, quantile_disc(value, 0.95) AS p95, round(median(value), 6) AS median FROM events GROUP BY 1")
def p95_latency(spark, d):
    return metrics.nearest_rank(v.table(spark, d, "events"), "event_type", "value")


@BOOK.query("WITH r AS (SELECT event_type AS kind, CASE event_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.0 END::DOUBLE AS w FROM events) SELECT kind, round(coalesce(sum(w), 0), 6)::DOUBLE AS points, count(w) AS graded, count(*) - count(w) AS pending, round(100 * sum(w) / count(w), 6) AS percent FROM r GROUP BY 1")
def eval_rollup(spark, d):
    grade = F.when(F.col("event_id") % 4 == 0, "full").when(F.col("event_id") % 4 == 1, "half").when(F.col("event_id") % 4 == 2, "none")
    return metrics.points(v.table(spark, d, "events").select(F.col("event_type").alias("kind"), grade.alias("grade")))


@BOOK.query("SELECT user_id AS fixture, event_id, ts AS mapped_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'click') WHERE n = 1")
def latest_mapping(spark, d):
    rows = v.table(spark, d, "events").where("event_type = 'click'")
    return graph.latest(rows, ["user_id"], F.desc("ts"), F.desc("event_id")).select(F.col("user_id").alias("fixture"), "event_id", F.col("ts").alias("mapped_at"))


_FIXTURES = ctes("v_thought") + """, m AS (SELECT k AS fixture_id, event_id % 40 AS run_id, event_id % (SELECT count(*) FROM orders) AS thought_id FROM (SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events))
, r AS (SELECT run_id, run_id % 3 AS eval_user, max(ts) AS created_at FROM (SELECT event_id % 40 AS run_id, ts FROM events) GROUP BY 1, 2)
, j AS (SELECT fixture_id, thought_id, run_id AS source_run_id, row_number() OVER (PARTITION BY fixture_id ORDER BY r.created_at DESC, run_id DESC, thought_id) AS n FROM m JOIN r USING (run_id) JOIN v_thought t ON t.id = thought_id AND t.user_id % 3 = eval_user WHERE eval_user = 1)
SELECT fixture_id, thought_id, source_run_id FROM j WHERE n = 1"""


@BOOK.query(_FIXTURES)
def fixture_map(spark, d):
    e, n = v.events_k(spark, d), v.table(spark, d, "orders").count()
    run = F.col("event_id") % 40
    made = e.select(F.col("k").alias("fixture_id"), run.alias("run_id"), (F.col("event_id") % n).alias("thought_id"))
    runs = e.groupBy(run.alias("run_id")).agg(F.max("ts").alias("created_at")).withColumn("eval_user", F.col("run_id") % 3)
    thoughts = v.thoughts(spark, d).select("id", (F.col("user_id") % 3).alias("user_id"))
    return graph.fixture_map(made, runs.where("eval_user = 1"), thoughts)


def tenant_graph(spark, d):
    """Co-mentions by tenant: an order's customer."""
    owner = v.thoughts(spark, d).select(F.col("id").alias("thought_id"), F.col("user_id").alias("tenant"))
    m = v.mentions(spark, d).join(owner, "thought_id").select("tenant", "thought_id", "entity_id")
    edges = graph.comentions(m, ["tenant"]).select("tenant", "a", "b", F.col("weight").cast("double").alias("weight"))
    return m.select("tenant", F.col("entity_id").alias("node")).distinct(), edges


@BOOK.query()
def louvain_levels(spark, d):
    return community.louvain(*tenant_graph(spark, d))


_RESOLUTION = ctes("v_entity", "v_mention") + """, e AS (SELECT lower(label) AS key, min(id) AS id, min(entity_type) AS entity_type FROM v_entity GROUP BY 1)
, said AS (SELECT l_orderkey AS thought_id, l_partkey AS part, l_linenumber % 3 AS k, lower(label) AS label, entity_type FROM lineitem JOIN v_entity ON l_partkey = id)
, m AS (SELECT thought_id * 100000 + part AS mention_id, thought_id, min(CASE k WHEN 0 THEN string_split(label, ' ')[1] || ' thing' WHEN 1 THEN 'the ' || label ELSE label END) AS key, min(entity_type) AS entity_type FROM said GROUP BY thought_id, part)
, al AS (SELECT 'the ' || key AS alias, id AS entity_id FROM e WHERE id % 2 = 0)
, r AS (SELECT m.*, e.id AS by_key, al.entity_id AS by_alias FROM m LEFT JOIN e USING (key) LEFT JOIN al ON al.alias = m.key)
, pm AS (SELECT x.entity_id AS a, y.entity_id AS b FROM v_mention x JOIN v_mention y ON x.thought_id = y.thought_id AND x.entity_id < y.entity_id GROUP BY 1, 2 HAVING count(*) >= 2)
, ad AS (SELECT a, b FROM pm UNION SELECT b, a FROM pm)
, nb AS (SELECT DISTINCT thought_id, b AS id FROM v_mention JOIN ad ON entity_id = a)
, co AS (SELECT thought_id, id FROM nb JOIN v_mention v USING (thought_id) WHERE v.entity_id = id)
, ew AS (SELECT DISTINCT id, unnest(string_split(key, ' ')) AS word FROM e), mw AS (SELECT DISTINCT mention_id, unnest(string_split(key, ' ')) AS word FROM r WHERE by_key IS NULL AND by_alias IS NULL)
, o AS (SELECT DISTINCT mention_id, id FROM mw JOIN ew USING (word))
, s AS (SELECT mention_id, e.id, (CASE WHEN e.entity_type = r.entity_type THEN 2 ELSE 0 END) + (CASE WHEN nb.id IS NOT NULL THEN 5 ELSE 0 END) + (CASE WHEN nb.id IS NOT NULL AND EXISTS (SELECT 1 FROM co WHERE co.thought_id = r.thought_id AND co.id <> e.id) THEN 3 ELSE 0 END) + (CASE WHEN e.key = r.key THEN 2 ELSE 0 END) AS score
  FROM o JOIN r USING (mention_id) JOIN e ON e.id = o.id LEFT JOIN nb ON nb.thought_id = r.thought_id AND nb.id = e.id)
, t AS (SELECT mention_id, max(score) AS score, arg_max(id, score) AS best, coalesce((list(score ORDER BY score DESC))[2], 0) AS next FROM s GROUP BY 1 HAVING max(score) >= 5)
SELECT mention_id, coalesce(by_key, by_alias, CASE WHEN score - next >= 2 THEN best END) AS entity_id
, CASE WHEN by_key IS NOT NULL THEN 'key' WHEN by_alias IS NOT NULL THEN 'alias' WHEN score - next >= 2 THEN 'context' WHEN score IS NOT NULL THEN 'ambiguous' ELSE 'new' END AS how, score::INT AS score FROM r LEFT JOIN t USING (mention_id)"""


@BOOK.query(_RESOLUTION)
def entity_resolution(spark, d):
    e = v.entities(spark, d).groupBy(F.lower("label").alias("key")).agg(F.min("id").alias("id"), F.min("entity_type").alias("entity_type"))
    said = v.table(spark, d, "lineitem").join(v.entities(spark, d), F.col("l_partkey") == F.col("id"))
    key = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.split(F.lower("label"), " ")[0], F.lit(" thing"))).when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("the "), F.lower("label"))).otherwise(F.lower("label"))
    mentions = said.groupBy(F.col("l_orderkey").alias("thought_id"), F.col("l_partkey").alias("entity_id")).agg(F.min(key).alias("key"), F.min("entity_type").alias("entity_type"))
    mentions = mentions.select((F.col("thought_id") * 100_000 + F.col("entity_id")).alias("mention_id"), "thought_id", "key", "entity_type")
    aliases = e.select(F.concat(F.lit("the "), "key").alias("alias"), F.col("id").alias("entity_id")).where("entity_id % 2 = 0")
    m = v.mentions(spark, d)
    return community.resolved(mentions, e, aliases, graph.comentions(m).where("weight >= 2"), m)


@BOOK.query()
def entity_dedup(spark, d):
    rows = v.vectors(spark, d).select("id", "vec", F.col("label").cast("string").alias("entity_type"), (F.col("id") % 10 == 0).alias("project"), F.col("id").alias("created_at"))
    return community.duplicates(rows, 200, 0.75)


_DAYS = "SELECT date_trunc('day', ts)::TIMESTAMP AS bucket, event_type, count(*) AS n, round(sum(value::DECIMAL(18,6))::DOUBLE, 6) AS total FROM events GROUP BY 1, 2"


def _stream(spark, d):
    # A file source wants a folder of files: the table is copied to one first, as a queue's writer would do.
    rows = v.table(spark, d, "events")
    path = new_folder(spark, "incoming")
    rows.repartition(4).write.parquet(path)
    return streams.event_stream(spark, path, rows.schema, 1)


@BOOK.query(_DAYS)
def stream_tumbling(spark, d):
    found = streams.to_table(streams.tumbling(_stream(spark, d), late="60 days"), "buckets", "complete")
    return found.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "event_type", "n", F.round(F.col("total").cast("double"), 6).alias("total"))


@BOOK.query("SELECT DISTINCT user_id || '-' || event_type AS dedupe_key FROM events")
def stream_dedupe(spark, d):
    jobs = _stream(spark, d).withColumn("dedupe_key", F.concat(F.col("user_id").cast("string"), F.lit("-"), F.col("event_type")))
    return streams.to_table(streams.active_once(jobs, "60 days"), "active").select("dedupe_key")

# Streams get what arrives in four parts, each in the order of events.
_PARTS = 4


def _chunk(spark, d):
    n = v.table(spark, d, "events").count()
    return F.floor(F.col("event_id") * _PARTS / n).cast("int")


@BOOK.query("SELECT event_id FROM events WHERE floor(epoch(ts)) <= epoch(TIMESTAMP '2024-01-15') AND epoch(TIMESTAMP '2024-01-15') - floor(epoch(ts)) <= 86400")
def reminders_not_late(spark, d):
    return streams.to_table(streams.not_late(_stream(spark, d), "2024-01-15 00:00:00"), "due").select("event_id")


@BOOK.query("""WITH e AS (SELECT event_id, ts - to_hours(CASE WHEN event_id % 5 = 0 THEN 25 WHEN event_id % 7 = 0 THEN 23 ELSE 0 END) AS fire_at, floor(event_id * 4 / (SELECT count(*) FROM events)) AS part FROM events)
, m AS (SELECT part, max(fire_at) AS most FROM e GROUP BY part), w AS (SELECT part, max(most) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 24 HOUR AS mark FROM m)
SELECT event_id, part::BIGINT AS batch, coalesce(fire_at < mark, false) AS late FROM e JOIN w USING (part)""")
def stream_late_drop(spark, d):
    hours = F.when(F.col("event_id") % 5 == 0, 25).when(F.col("event_id") % 7 == 0, 23).otherwise(0)
    rows = v.table(spark, d, "events").select("event_id", (F.col("ts").cast("timestamp") - F.make_dt_interval(F.lit(0), hours)).alias("fire_at"))
    parted = arrivals.Lateness(spark, "fire_at", 24, new_folder(spark, "lateness"))
    arrivals.arriving(rows, _chunk(spark, d), _PARTS, lambda stream, progress: arrivals.taken(stream, parted, progress))
    said = lambda name, late: parted.rows(name, rows.schema).select("event_id", "batch", F.lit(late).alias("late"))
    return said("on_time", False).unionByName(said("late", True))


@BOOK.query(ctes("v_entity") + "SELECT l1 AS community, count(*)::BIGINT AS mentions, sum(l_quantity)::BIGINT AS quantity, max(l_orderkey) AS newest FROM lineitem JOIN v_entity ON l_partkey = id GROUP BY 1")
def incremental_communities(spark, d):
    rows = v.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.col("l_quantity").cast("long").alias("quantity"))
    home = v.entities(spark, d).select(F.col("id").alias("l_partkey"), F.col("l1").alias("community"))
    kept = arrivals.Versioned(spark, new_folder(spark, "communities"), ["community"], ["mentions", "quantity"], ["newest"])

    def refresh(batch, number):
        kept.add(batch.join(home, "l_partkey").select("community", F.lit(1).cast("long").alias("mentions"), "quantity", F.col("l_orderkey").alias("newest")), number)

    most = rows.agg(F.max("l_orderkey")).first()[0] or 0
    arrivals.arriving(rows, F.floor(F.col("l_orderkey") * _PARTS / (most + 1)).cast("int"), _PARTS, lambda stream, progress: streams.by_batches(stream, refresh, progress))
    return kept.now()


def queue_commands(spark, d):
    """Events as a queue's commands: views and clicks put jobs, sign-ups and errors claim, purchases end one."""
    op = F.when(F.col("event_type").isin("view", "click"), "put").when(F.col("event_type") == "purchase", "done").otherwise("claim")
    job = F.when(op == "put", F.col("event_id"))
    return v.table(spark, d, "events").select("event_id", F.col("user_id").alias("tenant"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), op.alias("op"), job.alias("job_id"))


@BOOK.query()
def queue_changes(spark, d):
    rows, path = queue_commands(spark, d), new_folder(spark, "changes")
    with queues.kept_in_rocks(spark):
        arrivals.arriving(rows, _chunk(spark, d), _PARTS, lambda stream, progress: streams.appended(queues.queue(stream, 24 * 60), path, progress))
    return spark.read.schema(queues.CHANGES).parquet(path)


def graph_log(spark, d):
    """Events as changes of a graph: nodes are users' and events' kinds, and numbers of a hundred."""
    e = v.events_k(spark, d)
    op = F.element_at(F.array(*map(F.lit, ("node", "mention", "relate", "relate", "relate", "node", "mention", "relate", "drop_edge", "drop_node"))), (F.col("event_id") % 10 + 1).cast("int"))
    # Deletions hit few nodes each, else nothing would last.
    keep = (op != "drop_node") | (F.col("k") % 3 == 0)
    text = lambda c: F.col(c).cast("string")
    source, target = F.concat(F.lit("n"), text("k")), F.concat(F.lit("n"), (F.floor("value") % 10).cast("string"))
    predicate = F.when(op.isin("relate", "drop_edge"), F.when(F.floor("value") % 2 == 0, "part_of").otherwise("related_to"))
    return e.where(keep).select(F.col("event_id").alias("seq"), op.alias("op"), source.alias("source"), F.when(~op.isin("node", "drop_node"), target).alias("target"), predicate.alias("predicate"), F.when(op == "node", F.col("event_type")).alias("props"))


_LOG = ctes("v_k") + """, lg AS (SELECT event_id AS seq, ['node', 'mention', 'relate', 'relate', 'relate', 'node', 'mention', 'relate', 'drop_edge', 'drop_node'][(event_id % 10 + 1)::INT] AS op, 'n' || k AS source, 'n' || (floor(value)::BIGINT % 10) AS target,
  CASE WHEN floor(value)::BIGINT % 2 = 0 THEN 'part_of' ELSE 'related_to' END AS predicate, event_type AS props FROM v_k WHERE event_id % 10 <> 9 OR k % 3 = 0)
, ne AS (SELECT source AS id, seq, op, CASE WHEN op = 'node' THEN props END AS props FROM lg WHERE op IN ('node', 'drop_node') UNION ALL SELECT source, seq, op, NULL FROM lg WHERE op = 'mention' UNION ALL SELECT target, seq, op, NULL FROM lg WHERE op = 'mention')
, no AS (SELECT *, sum((op = 'drop_node')::INT) OVER (PARTITION BY id ORDER BY seq) AS life FROM ne)
, na AS (SELECT id, min(seq) FILTER (op <> 'drop_node') AS born, arg_max(props, seq) FILTER (op = 'node') AS props FROM no WHERE life = (SELECT max(life) FROM no i WHERE i.id = no.id) GROUP BY id HAVING count(*) FILTER (op <> 'drop_node') > 0)
"""


@BOOK.query(_LOG + "SELECT id, props FROM na")
def logged_nodes(spark, d):
    return changes.nodes(graph_log(spark, d)).select("id", "props")


@BOOK.query(_LOG + """, pu AS (SELECT source, target, CASE WHEN op <> 'mention' THEN predicate END AS predicate, seq, op FROM lg WHERE op IN ('mention', 'relate', 'drop_edge'))
, gone AS (SELECT source, target, predicate, max(seq) AS gone FROM pu WHERE op = 'drop_edge' GROUP BY ALL)
SELECT p.source, p.target, p.predicate, CASE WHEN p.predicate IS NULL THEN 1 ELSE count(*) END::BIGINT AS weight FROM pu p JOIN na a ON a.id = p.source JOIN na b ON b.id = p.target LEFT JOIN gone g ON g.source = p.source AND g.target = p.target AND g.predicate IS NOT DISTINCT FROM p.predicate
WHERE op <> 'drop_edge' AND seq > coalesce(gone, -1) AND CASE op WHEN 'mention' THEN seq >= greatest(a.born, b.born) ELSE seq > greatest(a.born, b.born) END GROUP BY p.source, p.target, p.predicate""")
def logged_edges(spark, d):
    return changes.edges(graph_log(spark, d))


@BOOK.query(ctes("v_job") + "SELECT job_id, 'running' AS status, attempts + 1 AS attempts FROM v_job WHERE (status = 'pending' AND run_after <= TIMESTAMP '2024-01-10') OR (status = 'running' AND run_after < TIMESTAMP '2024-01-10' - INTERVAL 10 MINUTE) ORDER BY run_after, job_id LIMIT 200")
def claim_jobs(spark, d):
    return streams.claimed(v.jobs(spark, d), "2024-01-10 00:00:00", 200).select("job_id", "status", "attempts")


@BOOK.query(ctes("v_thought") + "SELECT id, category, lifecycle FROM v_thought")
def csv_export(spark, d):
    rows = v.thoughts(spark, d).select("id", "category", "lifecycle", "created_at")
    return exports.csv_round_trip(rows, ["created_at", "id"]).select("id", "category", "lifecycle")


@BOOK.query(ctes("v_mention", "v_entity") + "SELECT 'entity' AS kind, 'e' || id AS source, label AS target, NULL::DOUBLE AS salience FROM v_entity UNION ALL SELECT 'mention', 't' || thought_id, 'e' || entity_id, round(salience, 9) FROM v_mention")
def graph_export(spark, d):
    path = exports.write_graph(v.entities(spark, d), v.mentions(spark, d), new_folder(spark, "graph"))
    nodes, edges = exports.read_graph(spark, path)
    told = nodes.select("kind", F.col("id").alias("source"), F.col("label").alias("target"), F.lit(None).cast("double").alias("salience"))
    return told.unionByName(edges.select(F.lit("mention").alias("kind"), "source", "target", F.round("salience", 9).alias("salience")))


@BOOK.query(ctes("v_event", "v_mention") + "SELECT 't' || thought_id AS source, 'v' || event_id AS target, 'occurs_in' AS kind FROM v_event UNION ALL SELECT DISTINCT 'v' || event_id, 'e' || entity_id, 'involves' FROM v_event JOIN v_mention USING (thought_id)")
def graph_event_edges(spark, d):
    path = exports.write_graph(v.entities(spark, d), v.mentions(spark, d), new_folder(spark, "graph"), v.events(spark, d))
    return exports.read_event_edges(spark, path)


#: Tables of the dump with a key, a text and a number of each.
_TABLES = (("customer", "c_custkey", "c_name", "c_acctbal"), ("orders", "o_orderkey", "o_orderpriority", "o_totalprice"), ("part", "p_partkey", "p_name", "p_retailprice"), ("benchmark", "item_id", "text", "item_id"))


@BOOK.query(" UNION ALL ".join(f"SELECT '{n}' AS name, {k}::BIGINT AS key, sha256(coalesce({c}, '')) AS said, {x}::DOUBLE AS amount FROM {n}" for n, k, c, x in _TABLES))
def table_contents(spark, d):
    path = new_folder(spark, "dump")
    exports.write_tables({n: v.table(spark, d, n) for n, *_ in _TABLES}, path)
    rows = None
    for n, k, c, x in _TABLES:
        back = exports.read_csv(spark, f"{path}/{n}", v.table(spark, d, n).schema)
        one = back.select(F.lit(n).alias("name"), F.col(k).cast("long").alias("key"), F.sha2(F.coalesce(F.col(c), F.lit("")), 256).alias("said"), F.col(x).cast("double").alias("amount"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


@BOOK.query("SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part")
def table_export(spark, d):
    return exports.write_tables({n: v.table(spark, d, n) for n in ("customer", "orders", "part")}, new_folder(spark, "dump"))


_DUMP = {"thoughts": "v_thought", "entities": "v_entity", "thought_entities": "v_mention", "temporal_events": "v_event", "accounts": "v_account", "calls": "v_call", "ledger": "v_ledger", "jobs": "v_job"}


@BOOK.query(ctes(*_DUMP.values()) + " UNION ALL ".join(f"SELECT '{n}.csv' AS name, count(*) AS n, 1 AS export_version, 'tenant-1' AS tenant FROM {t}" for n, t in _DUMP.items()))
def export_manifest(spark, d):
    made = (v.thoughts, v.entities, v.mentions, v.events, v.accounts, v.calls, v.ledger, v.jobs)
    path = new_folder(spark, "dump")
    counts = exports.write_tables({n: f(spark, d) for n, f in zip(_DUMP, made)}, path)
    told = exports.write_manifest(counts, path, 1, "2024-02-01T00:00:00.000Z", "tenant-1")
    return told.select("export_version", "tenant", F.explode("files").alias("name", "n"))


@BOOK.query(ctes("v_vec") + """, r AS (SELECT id, label, TIMESTAMP '2024-01-01' + to_days((id % 37)::INT) AS made, strftime(TIMESTAMP '2024-03-01' + to_days((id % 11)::INT), '%Y-%m-%dT%H:%M:%S.000Z') AS stamp FROM v_vec)
, s AS (SELECT id, 'Thought' AS kind, stamp FROM r WHERE label = 0 ORDER BY made, id LIMIT 800), e AS (SELECT id, 'Entity' AS kind, stamp FROM r WHERE label >= 5 ORDER BY made, id LIMIT (SELECT 800 - count(*) FROM s)), a AS (SELECT * FROM s UNION ALL SELECT * FROM e)
SELECT count(*) AS n, sha256(string_agg(kind || ':' || id || ':' || stamp, chr(10) ORDER BY kind, id::VARCHAR)) AS revision FROM a""")
def embedding_snapshot(spark, d):
    day = lambda start, n: (F.lit(start).cast("timestamp_ntz") + F.make_dt_interval((F.col("id") % n).cast("int")))
    rows = v.vectors(spark, d).withColumns({"created_at": day("2024-01-01", 37), "updated_at": day("2024-03-01", 11)})
    return exports.snapshot(rows.where("label = 0"), rows.where("label >= 5"))
