"""Timeline queries: windows, validity, solver, agenda, projects, over orders and their shipments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recallspark.functions import calendar as c, recurrence
from recallspark.operators import graph, planner, timeline as op
from recallspark.operators.rollups import keyset_page
from recallspark.plans.book import Book
from recallspark.sources import views as v
from recallspark.sources.views import ORDER_NOW, ctes

BOOK = Book()

_E = ctes("v_event", "v_thought", "v_mention", "v_entity")
_NOW = f"TIMESTAMP '{ORDER_NOW}'"


@BOOK.query(_E + "SELECT event_id, kind FROM v_event WHERE start_at < TIMESTAMP '1999-02-01' AND TIMESTAMP '1999-01-01' < end_at")
def period_overlap(spark, d):
    return op.in_window(v.events(spark, d), "1999-01-01", "1999-02-01").select("event_id", "kind")


@BOOK.query(_E + "SELECT event_id FROM v_event WHERE end_at >= TIMESTAMP '2001-06-01' AND start_at <= TIMESTAMP '2001-06-15'")
def closed_range(spark, d):
    return op.in_range(v.events(spark, d), "2001-06-01", "2001-06-15").select("event_id")


@BOOK.query(_E + " SELECT " + ", ".join(f"count(*) FILTER ({w}) AS {n}" for n, w in (("past", f"end_at < {_NOW}"), ("upcoming", f"end_at >= {_NOW}"), ("relevant", f"end_at >= {_NOW} AND start_at <= {_NOW} + INTERVAL 7 DAY"), ("everything", "true"))) + " FROM v_event")
def range_presets(spark, d):
    e = v.events(spark, d)
    parts = [op.preset(e, p, ORDER_NOW).agg(F.count("*").alias(n)) for p, n in (("past", "past"), ("upcoming", "upcoming"), ("relevant", "relevant"), ("all", "everything"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, F.lit(True))
    return out


_ITEMS = """, items AS (SELECT event_id AS item_id, thought_id, user_id, kind, start_at FROM v_event UNION ALL SELECT 'task-' || id, id, user_id, 'task', created_at FROM v_thought WHERE category = 'task' AND lifecycle = 'open' AND id NOT IN (SELECT thought_id FROM v_event))"""


@BOOK.query(_E + _ITEMS + "SELECT item_id, kind, start_at, row_number() OVER (ORDER BY start_at DESC, item_id DESC)::INT AS place, true AS has_more FROM items WHERE start_at < TIMESTAMP '2000-01-01' ORDER BY start_at DESC, item_id DESC LIMIT 50")
def timeline_page(spark, d):
    rows = op.with_tasks(v.events(spark, d), v.thoughts(spark, d))
    return keyset_page(rows, "start_at", "item_id", ("2000-01-01 00:00:00", ""), 50).select("item_id", "kind", "start_at", "place", "has_more")


@BOOK.query(_E + _ITEMS + "SELECT item_id, thought_id, user_id FROM items WHERE kind = 'task'")
def tasks_without_event(spark, d):
    return op.with_tasks(v.events(spark, d), v.thoughts(spark, d)).where("kind = 'task'").select("item_id", "thought_id", "user_id")


@BOOK.query("""WITH o AS (SELECT o_orderkey AS id, o_orderdate AS s, CASE WHEN o_orderkey % 6 = 0 THEN o_orderdate - INTERVAL 2 DAY END AS e, CASE WHEN o_orderkey % 5 = 0 THEN 'deadline' ELSE 'appointment' END AS kind, ['day', 'week', 'month', 'minute'][(o_orderkey % 4 + 1)::INT] AS prec, o_orderkey % 7 = 0 AS fuzzy FROM orders)
, x AS (SELECT *, CASE WHEN e IS NOT NULL THEN e WHEN kind = 'deadline' THEN s + INTERVAL 1 DAY WHEN fuzzy THEN s + INTERVAL 7 DAY WHEN prec = 'day' THEN s + INTERVAL 1 DAY WHEN prec = 'week' THEN s + INTERVAL 7 DAY WHEN prec = 'month' THEN date_trunc('month', s) + INTERVAL 1 MONTH + to_days((day(s) - 1)::INT) ELSE s + INTERVAL 1 HOUR END AS b FROM o)
SELECT id, (CASE WHEN b <= s THEN s + INTERVAL 1 HOUR ELSE b END)::TIMESTAMP AS end_at FROM x""")
def resolve_bounds(spark, d):
    o, k = v.table(spark, d, "orders"), F.col("o_orderkey")
    start, end = F.col("o_orderdate"), F.when(k % 6 == 0, c.plus_days(F.col("o_orderdate"), -2))
    kind, prec = F.when(k % 5 == 0, "deadline").otherwise("appointment"), F.element_at(F.array(*map(F.lit, ("day", "week", "month", "minute"))), (k % 4 + 1).cast("int"))
    return o.select(k.alias("id"), c.resolved_end(start, end, kind, prec, k % 7 == 0).alias("end_at"))


@BOOK.query(_E + f"SELECT thought_id, max(end_at) AS last_end, CASE WHEN max(end_at) <= {_NOW} THEN 'expired' ELSE 'active' END AS status FROM v_event GROUP BY 1")
def validity_status(spark, d):
    return op.validity(v.events(spark, d), ORDER_NOW)


@BOOK.query("""WITH o AS (SELECT o_orderkey AS id, o_orderdate::DATE AS d, o_orderkey % 4 AS u, o_orderkey % 7 + 1 AS n FROM orders)
SELECT id, (CASE u WHEN 0 THEN d - n::INT WHEN 1 THEN d - (n * 7)::INT WHEN 2 THEN (date_trunc('month', d) - to_months(n::INT))::DATE + (day(d) - 1)::INT ELSE d - ((isodow(d) - n + 6) % 7 + 1 + CASE WHEN (isodow(d) - n + 6) % 7 < 0 THEN 7 ELSE 0 END)::INT END)::TIMESTAMP + INTERVAL 12 HOUR AS at_time FROM o""")
def relative_dates(spark, d):
    k = F.col("o_orderkey")
    unit = F.element_at(F.array(*map(F.lit, ("days", "weeks", "months", "weekday"))), (k % 4 + 1).cast("int"))
    return v.table(spark, d, "orders").select(k.alias("id"), c.relative_date(F.col("o_orderdate"), unit, k % 7 + 1).alias("at_time"))


@BOOK.query("""WITH o AS (SELECT o_orderkey AS id, o_orderdate AS s, o_orderkey % 5 + 1 AS step FROM orders), x AS (SELECT id, s + to_days((i * step)::INT) AS at_time, i FROM o, range(500) r(i))
, y AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS n FROM x WHERE at_time >= TIMESTAMP '1999-01-01' AND at_time < TIMESTAMP '1999-03-01') SELECT id, at_time FROM y WHERE n <= 10""")
def rrule_expand(spark, d):
    o = v.table(spark, d, "orders")
    none = F.lit(None)
    times = c.occurrences(F.lit("DAILY"), (F.col("o_orderkey") % 5 + 1).cast("int"), F.lit(10), none.cast("timestamp_ntz"), none.cast("array<int>"), F.col("o_orderdate"), c.at("1999-01-01"), c.at("1999-03-01"))
    return o.select(F.col("o_orderkey").alias("id"), F.explode(times).alias("at_time"))


def rules(spark, d):
    """A rule for each order: by days, weeks, weekdays and months in turn, some with an end or a count."""
    k, none = F.col("o_orderkey"), F.lit(None)
    freq = F.element_at(F.array(*map(F.lit, ("DAILY", "WEEKLY", "WEEKLY", "MONTHLY"))), (k % 4 + 1).cast("int"))
    byday = F.when(k % 4 == 2, F.array(F.lit(1), F.lit(3), (k % 7 + 1).cast("int")))
    until = F.when(k % 3 == 1, c.at("1999-02-11"))
    count = F.when(k % 5 == 0, F.lit(4)).otherwise(none.cast("int"))
    return v.table(spark, d, "orders").select(k.alias("id"), freq.alias("freq"), (k % 3 + 1).cast("int").alias("interval"), count.alias("count"), until.alias("until"), byday.alias("byday"), F.col("o_orderdate").alias("start"))


@BOOK.query("""WITH RECURSIVE o AS (SELECT o_orderkey AS id, o_orderdate::TIMESTAMP AS s, (o_orderkey % 3 + 1)::INT AS step, o_orderkey % 4 AS k, CASE WHEN o_orderkey % 3 = 1 THEN TIMESTAMP '1999-02-11' END AS until, CASE WHEN o_orderkey % 5 = 0 THEN 4 END AS most, [1, 3, o_orderkey % 7 + 1] AS days FROM orders)
, mo(id, at_time, i) AS (SELECT id, s, 0 FROM o WHERE k = 3 UNION ALL SELECT mo.id, date_trunc('month', at_time) + to_months(step) + (at_time - date_trunc('month', at_time)), i + 1 FROM mo JOIN o USING (id) WHERE i < 499 AND at_time < TIMESTAMP '1999-03-01')
, da AS (SELECT id, s + to_days((i * CASE k WHEN 0 THEN step WHEN 1 THEN step * 7 ELSE 1 END)::INT) AS at_time, i FROM o, range(500) r(i) WHERE k < 3)
, x AS (SELECT * FROM mo UNION ALL SELECT * FROM da), y AS (SELECT x.id, at_time, i, most, row_number() OVER (PARTITION BY x.id ORDER BY i) AS n FROM x JOIN o USING (id) WHERE at_time >= TIMESTAMP '1998-06-01' AND at_time < TIMESTAMP '1999-03-01' AND (until IS NULL OR at_time <= until) AND (k <> 2 OR list_contains(days, isodow(at_time))))
SELECT id, at_time FROM y WHERE most IS NULL OR n <= most""")
def rrule_kinds(spark, d):
    times = c.occurrences(*map(F.col, ("freq", "interval", "count", "until", "byday", "start")), c.at("1998-06-01"), c.at("1999-03-01"))
    return rules(spark, d).select("id", F.explode(times).alias("at_time"))


@BOOK.query()
def rrule_strict(spark, d):
    return recurrence.expanded(rules(spark, d), c.at("1998-06-01"), c.at("1999-03-01")).select("id", "at_time", "n")


@BOOK.query(_E + "SELECT user_id, (list(event_id ORDER BY start_at, event_id))[1] AS earliest, (list(event_id ORDER BY start_at DESC, event_id DESC))[1] AS latest FROM v_event GROUP BY 1 HAVING count(*) >= 2")
def solver_ordering(spark, d):
    return op.solve_ordering(v.events(spark, d))


@BOOK.query(_E + ", n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY start_at, event_id)::INT AS place, count(*) OVER (PARTITION BY user_id) AS n FROM v_event) SELECT user_id, event_id, place FROM n WHERE n >= 3")
def solver_multi_ordering(spark, d):
    return op.solve_multi_ordering(v.events(spark, d))


_ENDS = ", z AS (SELECT user_id, min(start_at) AS a, max(start_at) AS b FROM v_event GROUP BY 1 HAVING min(start_at) < max(start_at))"


@BOOK.query(_E + _ENDS + "SELECT user_id, (b::DATE - a::DATE)::INT AS days, (b::DATE - a::DATE + 1)::INT AS days_inclusive, ((b::DATE - a::DATE) // 7)::INT AS weeks, (12 * (year(b) - year(a)) + month(b) - month(a))::INT AS months FROM z")
def solver_duration(spark, d):
    return op.solve_duration(v.events(spark, d))


@BOOK.query(_E + """, f AS (SELECT user_id, thought_id, min(start_at) AS start_at FROM v_event GROUP BY 1, 2), a AS (SELECT user_id, max(thought_id) AS anchor FROM f GROUP BY 1), n AS (SELECT a.*, f.start_at AS t FROM a JOIN f ON f.thought_id = anchor AND f.user_id = a.user_id)
SELECT n.user_id, anchor, count(f.thought_id) AS before FROM n LEFT JOIN f ON f.user_id = n.user_id AND f.thought_id <> anchor AND f.start_at < t GROUP BY 1, 2""")
def solver_count(spark, d):
    e = v.events(spark, d)
    anchors = e.groupBy("user_id").agg(F.max("thought_id").alias("thought_id"), F.min_by("start_at", F.struct(-F.col("thought_id"), "start_at")).alias("start_at"))
    return op.solve_count(e, anchors)


@BOOK.query(_E + f", z AS (SELECT user_id, min(start_at) AS a FROM v_event GROUP BY 1) SELECT user_id, ({_NOW}::DATE - a::DATE)::INT AS days, (({_NOW}::DATE - a::DATE) // 7)::INT AS weeks, (12 * (2001 - year(a)) + 9 - month(a))::INT AS months FROM z")
def solver_lookback(spark, d):
    return op.solve_lookback(v.events(spark, d), ORDER_NOW)


@BOOK.query(_E + _ENDS + ", m AS (SELECT user_id, 12 * (year(b) - year(a)) + month(b) - month(a) AS m FROM z) SELECT user_id, (m // 12)::INT AS years, (m % 12)::INT AS months FROM m")
def solver_span(spark, d):
    return op.solve_span(v.events(spark, d))


@BOOK.query(_E + f", x AS (SELECT event_id, ({_NOW}::DATE - end_at::DATE)::INT AS days_past, minutes FROM v_event WHERE end_at < {_NOW} AND kind = 'deadline') SELECT event_id, days_past, days_past >= 1 AS prior_day, coalesce(minutes, 60) AS owed, CASE WHEN days_past < 1 THEN 'today' WHEN days_past <= 7 THEN 'week' WHEN days_past <= 30 THEN 'month' ELSE 'older' END AS bucket FROM x")
def overdue(spark, d):
    return op.overdue(v.events(spark, d).where("kind = 'deadline'"), ORDER_NOW).select("event_id", "days_past", "prior_day", "owed", "bucket")


@BOOK.query("""WITH x AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events WHERE ts <= TIMESTAMP '2024-01-28 12:00:00' + INTERVAL 12 HOUR), r AS (SELECT * FROM x WHERE day <= DATE '2024-01-28' AND day > DATE '2023-12-29')
, i AS (SELECT *, day - (row_number() OVER (PARTITION BY user_id ORDER BY day))::INT AS island FROM r) SELECT user_id, count(*) AS streak FROM i GROUP BY user_id, island HAVING max(day) >= DATE '2024-01-27'""")
def streak(spark, d):
    return op.streaks(v.table(spark, d, "events").select("user_id", F.col("ts").alias("at")), "2024-01-28 12:00:00")


@BOOK.query("SELECT user_id, count(*) FILTER (ts::DATE = DATE '2024-01-25') AS today, count(*) AS this_week FROM events WHERE ts::DATE >= DATE '2024-01-22' GROUP BY 1")
def completed_counts(spark, d):
    return op.completed_counts(v.table(spark, d, "events").select("user_id", F.col("ts").alias("at")), "2024-01-25 12:00:00")


_OPEN = f"SELECT event_id, CASE WHEN thought_id % 11 <> 0 THEN start_at END AS s, end_at AS e, TIMESTAMP '2001-07-01' AS t FROM v_event"


@BOOK.query(_E + ", x AS (" + _OPEN + ") " + " UNION ALL ".join(f"SELECT '{n}' AS view, count(*) AS n, count(*) FILTER (s IS NULL) AS undated FROM x WHERE {w}" for n, w in (("past", "s < t"), ("upcoming", "s IS NULL OR e >= t"), ("relevant", "s IS NULL OR e >= t OR s >= t AND s <= t + INTERVAL 7 DAY"), ("all", "true"))))
def view_ranges(spark, d):
    items = v.events(spark, d).withColumn("start_at", F.when(F.col("thought_id") % 11 != 0, F.col("start_at")))
    parts = [op.view_range(items, n, "2001-07-01").agg(F.count("*").alias("n"), F.count_if(F.col("start_at").isNull()).alias("undated")).withColumn("view", F.lit(n)) for n in ("past", "upcoming", "relevant", "all")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@BOOK.query(_E + f"""
, p AS (SELECT id AS project_id, project_status, TIMESTAMP '2001-08-01' + to_days((id % 90)::INT) AS target_date, CASE WHEN id % 3 = 0 THEN id END AS next_action FROM v_entity)
, l AS (SELECT DISTINCT entity_id FROM v_mention JOIN v_thought ON id = thought_id WHERE lifecycle = 'open' AND created_at < TIMESTAMP '1995-03-01')
SELECT project_id, CASE WHEN target_date < {_NOW} THEN 'deadline' WHEN project_id IN (SELECT entity_id FROM l) THEN 'milestone' ELSE 'no_next_action' END AS reason FROM p WHERE project_status = 'active' AND (target_date < {_NOW} OR project_id IN (SELECT entity_id FROM l) OR next_action IS NULL)""")
def stalled_projects(spark, d):
    k = F.col("id")
    projects = v.entities(spark, d).select(k.alias("project_id"), "project_status", c.plus_days(c.at("2001-08-01"), k % 90).alias("target_date"), F.when(k % 3 == 0, k).alias("next_action"))
    early = v.thoughts(spark, d).where((F.col("lifecycle") == "open") & (F.col("created_at") < c.at("1995-03-01")))
    stones = v.mentions(spark, d).join(early, F.col("thought_id") == F.col("id")).select(F.col("entity_id").alias("project_id"), F.col("created_at").alias("target_date"), F.lit(None).cast("timestamp_ntz").alias("completed_at"))
    return op.stalled(projects, stones, ORDER_NOW)


@BOOK.query(_E + "SELECT id, user_id, created_at FROM v_thought WHERE category = 'task' AND lifecycle = 'open' AND id NOT IN (SELECT thought_id FROM v_mention WHERE source = 'manual') AND id NOT IN (SELECT thought_id FROM v_event WHERE kind = 'period') ORDER BY created_at, id LIMIT 50")
def open_threads(spark, d):
    return op.open_threads(v.thoughts(spark, d), v.events(spark, d).where("kind = 'period'"), v.mentions(spark, d).where("source = 'manual'")).select("id", "user_id", "created_at")


@BOOK.query(_E + """
, w(a, b) AS (VALUES (TIMESTAMP '2000-01-01', TIMESTAMP '2000-01-31')), t AS (SELECT user_id, count(*) AS n FROM v_thought, w WHERE created_at >= a AND created_at < b GROUP BY 1), k AS (SELECT user_id, count(*) AS n FROM v_event, w WHERE kind = 'deadline' AND end_at >= a AND end_at < b GROUP BY 1), e AS (SELECT user_id, count(*) AS n FROM v_event, w WHERE start_at >= a AND start_at < b GROUP BY 1)
SELECT user_id, coalesce(t.n, 0) AS new_thoughts, coalesce(k.n, 0) AS tasks_done, coalesce(e.n, 0) AS events FROM t FULL JOIN k USING (user_id) FULL JOIN e USING (user_id)""")
def digest_activity(spark, d):
    e = v.events(spark, d)
    done = e.where("kind = 'deadline'").select("user_id", F.col("end_at").alias("at"))
    return op.digest(v.thoughts(spark, d), done, e, "2000-01-01", "2000-01-31")


@BOOK.query(_E + "SELECT created_at::DATE::VARCHAR AS day, category, count(*) AS n FROM v_thought WHERE created_at >= TIMESTAMP '2001-07-11' AND created_at < TIMESTAMP '2001-08-01' GROUP BY 1, 2")
def pattern_mix(spark, d):
    return op.pattern_mix(v.thoughts(spark, d), "2001-08-01 00:00:00").withColumn("day", F.col("day").cast("string"))


@BOOK.query(ctes("v_thought", "v_mention", "v_entity") + """
, w AS (SELECT * FROM v_thought WHERE created_at::DATE >= DATE '2001-07-11'), m AS (SELECT DISTINCT thought_id, l2 FROM v_mention JOIN v_entity e ON e.id = entity_id), c AS (SELECT DISTINCT l2, l1 FROM v_entity WHERE length(l2) % 2 = 0)
, k AS (SELECT 'day' AS kind, created_at::DATE::VARCHAR AS key, count(*) AS n FROM w GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM w GROUP BY 2 UNION ALL SELECT 'community', l1, count(*) FROM w JOIN m ON thought_id = w.id JOIN c USING (l2) GROUP BY 2)
SELECT *, row_number() OVER (PARTITION BY kind ORDER BY CASE kind WHEN 'day' THEN 0 ELSE -n END, key)::INT AS place FROM k""")
def pattern_activity(spark, d):
    e = v.entities(spark, d)
    members = v.mentions(spark, d).join(e, F.col("entity_id") == F.col("id")).select("thought_id", F.col("l2").alias("community_id")).distinct()
    names = e.where(F.length("l2") % 2 == 0).select(F.col("l2").alias("community_id"), F.col("l1").alias("name")).distinct()
    return op.pattern_activity(v.thoughts(spark, d), members, names, "2001-07-31")


_SINCE, _THEN = "TIMESTAMP '2000-01-01'", "TIMESTAMP '2000-02-01'"


@BOOK.query(_E + f""", l AS (SELECT entity_id, thought_id, user_id, created_at AS linked_at, category, lifecycle, created_at + INTERVAL 30 DAY AS completed_at FROM v_mention JOIN v_thought ON id = thought_id WHERE source = 'manual')
, e AS (SELECT DISTINCT thought_id FROM v_event WHERE end_at < {_THEN} OR start_at < {_THEN})
, n AS (SELECT user_id, entity_id, count(*) FILTER (linked_at >= {_SINCE} AND lifecycle IN ('open', 'completed')) AS new_thoughts, count(*) FILTER (category = 'task' AND lifecycle = 'completed' AND completed_at >= {_SINCE}) AS tasks_done, count(*) FILTER (category = 'task' AND lifecycle = 'open' AND thought_id IN (FROM e)) AS overdue_tasks FROM l GROUP BY 1, 2)
, m AS (SELECT user_id, entity_id, count(*) FILTER (created_at >= {_SINCE}) AS milestones_added, count(*) FILTER (created_at < {_SINCE}) AS milestones_changed FROM v_mention JOIN v_thought ON id = thought_id WHERE source = 'ingest' AND entity_id % 7 = 0 AND created_at + INTERVAL 20 DAY >= {_SINCE} GROUP BY 1, 2)
, a AS (SELECT user_id, entity_id, coalesce(new_thoughts, 0) AS new_thoughts, coalesce(tasks_done, 0) AS tasks_done, coalesce(overdue_tasks, 0) AS overdue_tasks, coalesce(milestones_added, 0) AS milestones_added, coalesce(milestones_changed, 0) AS milestones_changed FROM n FULL JOIN m USING (user_id, entity_id))
, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY new_thoughts + tasks_done DESC, overdue_tasks DESC, entity_id)::INT AS place FROM a WHERE new_thoughts + tasks_done + overdue_tasks + milestones_added + milestones_changed > 0)
SELECT *, place <= 3 AND new_thoughts + tasks_done > 0 AS top FROM r""")
def project_digest(spark, d):
    t = v.thoughts(spark, d).withColumn("completed_at", c.plus_days(F.col("created_at"), 30))
    owned = v.mentions(spark, d).drop("salience").join(t.select(F.col("id").alias("thought_id"), "user_id", "created_at"), "thought_id")
    links = owned.where("source = 'manual'").select("entity_id", "thought_id", "user_id", F.col("created_at").alias("linked_at"))
    stones = owned.where("source = 'ingest' and entity_id % 7 = 0").select("user_id", "entity_id", "created_at", c.plus_days(F.col("created_at"), 20).alias("updated_at"))
    return op.project_digest(links, t, v.events(spark, d), stones, "2000-01-01", "2000-02-01")


@BOOK.query(_E + f"""
, p AS (SELECT id AS entity_id, id % 50 AS user_id, TIMESTAMP '2001-08-01' + to_days((id % 90)::INT) AS target_date, CASE WHEN id % 3 = 0 THEN id END AS next_action FROM v_entity WHERE project_status = 'active')
, early AS (SELECT DISTINCT entity_id FROM v_mention JOIN v_thought ON id = thought_id WHERE lifecycle = 'open' AND created_at < TIMESTAMP '1995-03-01')
, s AS (SELECT *, CASE WHEN target_date < {_NOW} THEN 'deadline' WHEN entity_id IN (FROM early) THEN 'milestone' WHEN entity_id % 5 = 0 AND next_action IS NULL THEN 'no_next_action' END AS reason FROM p)
, l AS (SELECT entity_id, count(DISTINCT thought_id) AS n FROM v_mention WHERE thought_id IN (SELECT e.thought_id FROM v_event e JOIN v_thought t ON t.id = e.thought_id WHERE category = 'task' AND lifecycle = 'open' AND e.end_at < {_NOW}) GROUP BY 1)
, u AS (SELECT id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS n FROM v_thought WHERE category = 'task' AND lifecycle = 'open' AND id NOT IN (SELECT thought_id FROM v_mention WHERE source = 'manual'))
SELECT user_id, 'stalled' AS kind, entity_id AS id, NULL::BIGINT AS n, reason AS note FROM s WHERE reason IS NOT NULL
UNION ALL SELECT user_id, 'no_next_action', entity_id, NULL, NULL FROM s WHERE reason IS NULL AND next_action IS NULL
UNION ALL SELECT user_id, 'overdue_tasks', entity_id, n, NULL FROM p JOIN l USING (entity_id)
UNION ALL SELECT user_id, 'unthreaded', NULL, count(*), NULL FROM u GROUP BY 1
UNION ALL SELECT user_id, 'unthreaded_recent', id, n, NULL FROM u WHERE n <= 3""")
def digest_cleanup(spark, d):
    """What the digest asks for: stalled projects, missing next actions, overdue tasks, tasks in no project."""
    k, m, t = F.col("id"), v.mentions(spark, d), v.thoughts(spark, d)
    projects = v.entities(spark, d).where("project_status = 'active'").select(k.alias("entity_id"), (k % 50).alias("user_id"), "project_status", c.plus_days(c.at("2001-08-01"), k % 90).alias("target_date"), F.when(k % 3 == 0, k).alias("next_action"))
    early = t.where((F.col("lifecycle") == "open") & (F.col("created_at") < c.at("1995-03-01"))).select(F.col("id").alias("thought_id"), "created_at")
    stones = m.join(early, "thought_id").select(F.col("entity_id").alias("project_id"), F.col("created_at").alias("target_date"), F.lit(None).cast("timestamp_ntz").alias("completed_at"))
    # Only some projects are asked for a next action by the stalled rule; the others come under their own heading.
    asked = projects.withColumn("next_action", F.when(F.col("entity_id") % 5 == 0, F.col("next_action")).otherwise(F.col("entity_id")))
    why = op.stalled(asked.withColumnRenamed("entity_id", "project_id"), stones, ORDER_NOW)
    open_ = t.where("category = 'task' and lifecycle = 'open'")
    passed = op.overdue(v.events(spark, d), ORDER_NOW).select("thought_id").distinct()
    late = m.join(open_.select(F.col("id").alias("thought_id")), "thought_id", "left_semi").join(passed, "thought_id", "left_semi")
    loose = open_.join(m.where("source = 'manual'").select(F.col("thought_id").alias("id")), "id", "left_anti")
    return op.cleanup(projects, why, late, loose)


@BOOK.query(_E + """, p AS (SELECT id AS entity_id, id % 50 AS user_id, CASE WHEN id % 3 <> 0 THEN 'a' || (id % 7) END AS now, CASE WHEN id % 4 <> 0 THEN 'a' || (id % 14) END AS was FROM v_entity WHERE project_status = 'active' AND id % 5 <> 0)
SELECT * FROM p WHERE now IS DISTINCT FROM was""")
def next_action_changes(spark, d):
    k = F.col("id")
    said = lambda n, of: F.when(k % n != 0, F.concat(F.lit("a"), (k % of).cast("string"))).alias("next_action")
    active = v.entities(spark, d).where("project_status = 'active'")
    one = lambda rows, next_action: rows.select(k.alias("entity_id"), (k % 50).alias("user_id"), next_action)
    return op.next_action_changes(one(active, said(3, 7)), one(active.where("id % 5 <> 0"), said(4, 14)))


_LAYER = "CASE WHEN {0} % 3 = 0 THEN 'user' ELSE 'apikey:' || ({0} % 3) END AS layer"


@BOOK.query(_E + f"""
, p AS (SELECT id, label, project_status, CASE id % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'grounding' END AS project_source, {_LAYER.format("id")}, TIMESTAMP '2001-08-01' + to_days((id % 90)::INT) AS target_date, CASE WHEN id % 5 = 0 THEN id END AS next_action FROM v_entity WHERE project_status IS NOT NULL)
, t AS (SELECT id, category, lifecycle, created_at, {_LAYER.format("user_id")} FROM v_thought), l AS (SELECT thought_id, entity_id FROM v_mention WHERE source = 'manual'), x AS (SELECT DISTINCT entity_id AS id, layer FROM l JOIN t ON t.id = thought_id)
, o AS (SELECT entity_id AS id, count(*) AS open_tasks FROM l JOIN t ON t.id = thought_id WHERE category = 'task' AND lifecycle = 'open' GROUP BY 1)
, g AS (SELECT entity_id AS id, count(*) AS milestones, count(*) FILTER (lifecycle = 'completed') AS milestones_done, count(*) FILTER (lifecycle <> 'completed' AND created_at < {_NOW}) AS late FROM v_mention JOIN t ON t.id = thought_id WHERE created_at < TIMESTAMP '1995-03-01' GROUP BY 1)
, s AS (SELECT 'all' AS scope, * FROM p UNION ALL SELECT 'user', * FROM p WHERE project_source IS NOT NULL OR id IN (SELECT id FROM x WHERE layer = 'user') UNION ALL SELECT 'apikey:1', * FROM p WHERE layer = 'apikey:1' OR id IN (SELECT id FROM x WHERE layer = 'apikey:1'))
SELECT scope, s.id, label, project_status, coalesce(open_tasks, 0) AS open_tasks, coalesce(milestones, 0) AS milestones, coalesce(milestones_done, 0) AS milestones_done, CASE WHEN project_status <> 'active' THEN NULL WHEN target_date < {_NOW} THEN 'deadline' WHEN late > 0 THEN 'milestone' WHEN next_action IS NULL THEN 'no_next_action' END AS stalled
, CASE WHEN project_status = 'active' AND next_action IS NULL THEN 0 WHEN project_status = 'active' THEN 1 WHEN project_status = 'someday' THEN 2 ELSE 3 END AS sort_rank FROM s LEFT JOIN o USING (id) LEFT JOIN g USING (id)""")
def catalog_scopes(spark, d):
    layer = lambda n: F.when(F.col(n) % 3 == 0, "user").otherwise(F.concat(F.lit("apikey:"), (F.col(n) % 3).cast("string")))
    k, t = F.col("id"), v.thoughts(spark, d).withColumn("layer", layer("user_id"))
    projects = v.entities(spark, d).where("project_status is not null").select("id", "label", "project_status", F.when(k % 4 == 0, "manual").when(k % 4 == 1, "grounding").alias("project_source"), layer("id").alias("layer"), c.plus_days(c.at("2001-08-01"), k % 90).alias("target_date"), F.when(k % 5 == 0, k).alias("next_action"))
    m, early = v.mentions(spark, d), t.where(F.col("created_at") < c.at("1995-03-01"))
    stones = m.join(early, F.col("thought_id") == k).select(F.col("entity_id").alias("project_id"), F.col("created_at").alias("target_date"), F.when(F.col("lifecycle") == "completed", F.col("created_at")).alias("completed_at"))
    parts = [op.catalog(projects, m.where("source = 'manual'"), t, stones, ORDER_NOW, scope).withColumn("scope", F.lit(scope)) for scope in ("all", "user", "apikey:1")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@BOOK.query(_E + """, t AS (SELECT * FROM v_thought WHERE category = 'task' AND lifecycle = 'open' AND id % 9 <> 0), f AS (SELECT thought_id, min(start_at) AS first_event FROM v_event GROUP BY 1)
SELECT id, salience, first_event, (SELECT count(*) FROM t) AS total FROM t LEFT JOIN f ON thought_id = id ORDER BY salience DESC, id LIMIT 40""")
def now_candidates(spark, d):
    t = v.thoughts(spark, d)
    return op.now_candidates(t, v.events(spark, d), t.where("id % 9 = 0").select("id"), 40)


_SEC = f"CASE WHEN start_at::DATE = {_NOW}::DATE THEN 'today' WHEN end_at < {_NOW} THEN 'past' WHEN start_at::DATE = {_NOW}::DATE + 1 THEN 'tomorrow' WHEN start_at::DATE < {_NOW}::DATE + 7 THEN 'this_week' ELSE 'later' END"
_NEAR = ", near AS (SELECT * REPLACE (start_at + INTERVAL 60 DAY AS start_at, end_at + INTERVAL 60 DAY AS end_at) FROM v_event)"


def near(spark, d):
    """All events, sixty days on, so that some stand about the clock."""
    return v.events(spark, d).withColumns({t: c.plus_days(F.col(t), 60) for t in ("start_at", "end_at")})


@BOOK.query(_E + _NEAR + f"SELECT section, count(*) AS n, min(start_at) AS first_at FROM (SELECT *, {_SEC} AS section FROM near) GROUP BY 1")
def agenda_sections(spark, d):
    rows = near(spark, d).withColumn("section", op.section(F.col("start_at"), F.col("end_at"), ORDER_NOW))
    return rows.groupBy("section").agg(F.count("*").alias("n"), F.min("start_at").alias("first_at"))


@BOOK.query(_E + _NEAR + f""", s AS (SELECT *, {_SEC} AS section FROM near), g AS (SELECT *, (CASE section WHEN 'today' THEN 100 WHEN 'tomorrow' THEN 300 WHEN 'this_week' THEN 500 WHEN 'later' THEN 800 ELSE 1000 END - CASE WHEN kind = 'deadline' THEN 50 ELSE 0 END - CASE WHEN coalesce(minutes, 60) <= 15 THEN 30 ELSE 0 END)::INT AS focus FROM s)
SELECT event_id, section, focus, row_number() OVER (PARTITION BY user_id ORDER BY focus, start_at NULLS LAST, event_id)::INT AS place, row_number() OVER (PARTITION BY user_id ORDER BY focus, start_at NULLS LAST, event_id) <= 3 AS now FROM g""")
def focus_rank(spark, d):
    return op.focus_rank(near(spark, d), ORDER_NOW, 3).select("event_id", "section", "focus", "place", "now")


@BOOK.query(_E + _NEAR + ", days AS (SELECT DATE '2001-09-01' + i::INT AS day FROM range(7) r(i)) SELECT day::VARCHAR AS day, count(*) AS n, count(*) FILTER (start_at::DATE = day) AS starting FROM near JOIN days ON start_at < day + 1 AND day < end_at GROUP BY 1")
def events_on_day(spark, d):
    days = spark.range(7).select(F.date_add(F.lit("2001-09-01").cast("date"), F.col("id").cast("int")).alias("day"))
    return op.on_days(near(spark, d), days).groupBy("day").agg(F.count("*").alias("n"), F.count_if(F.to_date("start_at") == F.col("day")).alias("starting")).withColumn("day", F.col("day").cast("string"))


@BOOK.query(_E + ", q AS (SELECT CASE kind WHEN 'deadline' THEN 'do' WHEN 'appointment' THEN 'plan' END AS quadrant FROM v_event) SELECT k AS quadrant, count(q.k2) AS n FROM (VALUES ('do'), ('plan'), ('delegate'), ('drop'), ('unclassified')) t(k) LEFT JOIN (SELECT coalesce(quadrant, 'unclassified') AS k2 FROM q) q ON k2 = k GROUP BY 1")
def matrix_quadrants(spark, d):
    rows = v.events(spark, d).withColumn("quadrant", F.when(F.col("kind") == "deadline", "do").when(F.col("kind") == "appointment", "plan"))
    return op.matrix(rows, ["do", "plan", "delegate", "drop"])


@BOOK.query(_E + "SELECT event_id, minutes FROM v_event WHERE minutes <= 20 AND (kind = 'deadline' OR user_id % 5 = 2) AND thought_id % 3 IN (0, 1)")
def engage_filter(spark, d):
    tags = F.array(F.col("kind"), F.concat(F.lit("t"), (F.col("user_id") % 5).cast("string")))
    rows = v.events(spark, d).withColumn("tags", tags).withColumn("energy", F.element_at(F.array(*map(F.lit, ("low", "mid", "high"))), (F.col("thought_id") % 3 + 1).cast("int")))
    return op.engage(rows, ["deadline", "t2"], ["low", "mid"], 20).select("event_id", "minutes")


@BOOK.query(_E + f", l AS (SELECT thought_id, max(end_at) AS end_at FROM v_event GROUP BY 1), i AS (SELECT t.*, end_at, coalesce(end_at < {_NOW}, false) AS late FROM v_thought t LEFT JOIN l ON thought_id = id) SELECT user_id, count(*) FILTER (lifecycle = 'open') AS open, count(*) FILTER (lifecycle = 'completed') AS done, count(*) FILTER (lifecycle = 'open' AND late) AS overdue, count(*) FILTER (lifecycle = 'open' AND NOT late) AS todo FROM i GROUP BY 1")
def tab_counts(spark, d):
    last = v.events(spark, d).groupBy(F.col("thought_id").alias("id")).agg(F.max("end_at").alias("end_at"))
    return op.tab_counts(v.thoughts(spark, d).join(last, "id", "left"), ORDER_NOW)


@BOOK.query(_E + """, f AS (SELECT entity_id, count(*) AS items, count(*) FILTER (lifecycle = 'open') AS open_items, max(created_at) AS newest FROM v_mention JOIN v_thought ON id = thought_id WHERE source = 'manual' GROUP BY 1)
SELECT id, label, coalesce(items, 0) AS items, coalesce(open_items, 0) AS open_items, newest, row_number() OVER (ORDER BY newest DESC NULLS LAST, label, id)::INT AS place FROM v_entity LEFT JOIN f ON entity_id = id WHERE project_status IS NOT NULL""")
def project_cards(spark, d):
    return op.project_cards(v.mentions(spark, d).where("source = 'manual'"), v.thoughts(spark, d), v.entities(spark, d).where("project_status is not null"))


@BOOK.query(_E + """, o AS (SELECT entity_id, count(*) AS open_tasks FROM v_mention JOIN v_thought ON id = thought_id WHERE source = 'manual' AND category = 'task' AND lifecycle = 'open' GROUP BY 1)
SELECT id, label, project_status, coalesce(open_tasks, 0) AS open_tasks, CASE project_status WHEN 'active' THEN 0 ELSE 1 END AS sort_rank FROM v_entity LEFT JOIN o ON entity_id = id WHERE project_status IS NOT NULL""")
def project_catalog(spark, d):
    tasks = v.thoughts(spark, d).where("category = 'task' and lifecycle = 'open'").select(F.col("id").alias("thought_id"))
    counted = v.mentions(spark, d).where("source = 'manual'").join(tasks, "thought_id", "left_semi").groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("open_tasks"))
    return v.entities(spark, d).where("project_status is not null").join(counted, "id", "left").select("id", "label", "project_status", F.coalesce("open_tasks", F.lit(0).cast("long")).alias("open_tasks"), F.when(F.col("project_status") == "active", 0).otherwise(1).alias("sort_rank"))


@BOOK.query(_E + """, g AS (SELECT user_id, min(start_at) AS lo, max(end_at) AS hi FROM v_event GROUP BY 1), p AS (SELECT event_id, 100.0::DOUBLE * (epoch_us(start_at) - epoch_us(lo)) / (epoch_us(hi) - epoch_us(lo)) AS l, 100.0::DOUBLE * (epoch_us(end_at) - epoch_us(lo)) / (epoch_us(hi) - epoch_us(lo)) AS r FROM v_event JOIN g USING (user_id))
SELECT event_id, round(least(greatest(l, 0.0), 100.0), 6) AS "left", round(greatest(least(greatest(r, 0.0), 100.0) - least(greatest(l, 0.0), 100.0), 0.5), 6) AS width FROM p""")
def gantt_bars(spark, d):
    return op.gantt(v.events(spark, d), "user_id").select("event_id", "left", "width")


@BOOK.query("SELECT i::INT AS cell, (DATE '2024-01-29' + i::INT)::VARCHAR AS day, month(DATE '2024-01-29' + i::INT) = 2 AS inside FROM range(42) r(i)")
def month_grid(spark, d):
    return op.month_grid(spark, 2024, 2).withColumn("day", F.col("day").cast("string"))


@BOOK.query(_E + """, n AS (SELECT entity_id, count(DISTINCT thought_id) AS n FROM v_mention WHERE thought_id % 5 = 0 GROUP BY 1 ORDER BY n DESC, entity_id LIMIT 60)
SELECT DISTINCT a.entity_id AS a, b.entity_id AS b FROM v_mention a JOIN v_mention b ON a.thought_id = b.thought_id AND a.entity_id < b.entity_id WHERE a.entity_id IN (SELECT entity_id FROM n) AND b.entity_id IN (SELECT entity_id FROM n)""")
def pattern_graph(spark, d):
    m = v.mentions(spark, d)
    return op.pattern_graph(m.select("thought_id").distinct().where("thought_id % 5 = 0"), m, graph.comentions(m), 60)


_SEQ = ", q AS (SELECT entity_id AS project_id, thought_id, lifecycle, row_number() OVER (PARTITION BY entity_id ORDER BY created_at, thought_id)::INT AS rank FROM v_mention JOIN v_thought ON id = thought_id WHERE source = 'manual')"


def sequence(spark, d):
    rows = v.mentions(spark, d).where("source = 'manual'").join(v.thoughts(spark, d).select(F.col("id").alias("thought_id"), "lifecycle", "created_at"), "thought_id")
    return rows.select(F.col("entity_id").alias("project_id"), "thought_id", "lifecycle", F.row_number().over(Window.partitionBy("entity_id").orderBy("created_at", "thought_id")).alias("rank"))


@BOOK.query(_E + _SEQ + "SELECT project_id, thought_id, (SELECT min_by(x.thought_id, x.rank) FROM q x WHERE x.project_id = q.project_id AND x.rank > q.rank AND x.lifecycle = 'open') AS next_open FROM q WHERE lifecycle = 'completed'")
def task_sequence_next(spark, d):
    return op.next_after(sequence(spark, d))


@BOOK.query(_E + """, a AS (SELECT entity_id AS project_id, thought_id, lifecycle, source, row_number() OVER (PARTITION BY entity_id ORDER BY created_at, thought_id) AS place FROM v_mention JOIN v_thought ON id = thought_id)
, q AS (SELECT *, place AS rank FROM a WHERE source = 'manual')
SELECT d.project_id, d.thought_id, min_by(x.thought_id, x.rank) AS next_open FROM a d LEFT JOIN q o ON o.project_id = d.project_id AND o.thought_id = d.thought_id LEFT JOIN q x ON x.project_id = d.project_id AND x.lifecycle = 'open' AND x.rank > coalesce(o.rank, 0) WHERE d.lifecycle = 'completed' GROUP BY 1, 2""")
def task_sequence_next_any(spark, d):
    """The task to go on with after each finished one, whether it is in its project's sequence or not."""
    t = v.thoughts(spark, d).select(F.col("id").alias("thought_id"), "lifecycle", "created_at")
    rows = v.mentions(spark, d).join(t, "thought_id").withColumnRenamed("entity_id", "project_id")
    return op.next_of(sequence(spark, d), rows.where("lifecycle = 'completed'"))


@BOOK.query(_E + _SEQ + ", s AS (SELECT project_id, thought_id, rank FROM q WHERE rank <= 3) SELECT * FROM s UNION ALL SELECT project_id, thought_id, (coalesce((SELECT max(rank) FROM s WHERE s.project_id = q.project_id), 0) + row_number() OVER (PARTITION BY project_id ORDER BY thought_id))::INT FROM q WHERE rank > 3")
def task_sequence_append(spark, d):
    s = sequence(spark, d)
    return op.appended(s.where("rank <= 3"), s.select("project_id", "thought_id"))


@BOOK.query(_E + "SELECT thought_id, CASE WHEN entity_id % 10 = 9 THEN entity_id - 9 ELSE entity_id END AS entity_id, max(salience) AS salience FROM v_mention GROUP BY 1, 2")
def merged_projects(spark, d):
    merges = v.entities(spark, d).where("id % 10 = 9").select(F.col("id").alias("old_id"), (F.col("id") - 9).alias("new_id"))
    return op.merged_projects(v.mentions(spark, d), merges)


@BOOK.query(_E + "SELECT thought_id, CASE WHEN entity_id % 10 = 9 AND entity_id % 3 <> 0 THEN entity_id - 9 ELSE entity_id END AS entity_id, max(salience) AS salience FROM v_mention GROUP BY 1, 2")
def merged_projects_auto(spark, d):
    e = v.entities(spark, d)
    merges = e.where("id % 10 = 9").select(F.col("id").alias("old_id"), (F.col("id") - 9).alias("new_id"))
    return op.merged_projects(v.mentions(spark, d), merges, e.where("id % 3 = 0").select("id"))


@BOOK.query(_E + _SEQ + ", o AS (SELECT * FROM q WHERE lifecycle = 'open') SELECT project_id, thought_id, row_number() OVER (PARTITION BY project_id ORDER BY rank)::INT AS rank FROM o")
def task_sequence_prune(spark, d):
    return op.without_completed(sequence(spark, d))


@BOOK.query(_E + _SEQ + """
, m AS (SELECT project_id, max(thought_id) AS moved, CASE WHEN project_id % 3 = 0 THEN 2 END AS r, CASE WHEN project_id % 3 = 1 THEN min(thought_id) END AS a FROM q GROUP BY 1)
, w AS (SELECT q.project_id, q.thought_id, row_number() OVER (PARTITION BY q.project_id ORDER BY rank) AS i, count(*) OVER (PARTITION BY q.project_id) AS n FROM q JOIN m USING (project_id) WHERE thought_id <> moved)
, k AS (SELECT m.project_id, moved, CASE WHEN r IS NOT NULL THEN least(coalesce(max(n), 0), r - 1) ELSE coalesce(max(i) FILTER (thought_id = a), max(n), 0) END AS ahead FROM m LEFT JOIN w USING (project_id) GROUP BY m.project_id, moved, r)
SELECT w.project_id, w.thought_id, (i + CASE WHEN i > ahead THEN 1 ELSE 0 END)::INT AS rank FROM w JOIN k USING (project_id) UNION ALL SELECT project_id, moved, (ahead + 1)::INT FROM k""")
def task_sequence_reorder(spark, d):
    s, p = sequence(spark, d), F.col("project_id")
    ends = s.groupBy("project_id").agg(F.max("thought_id").alias("thought_id"), F.min("thought_id").alias("least"))
    moves = ends.select("project_id", "thought_id", F.when(p % 3 == 0, 2).alias("to_rank"), F.when(p % 3 == 1, F.col("least")).alias("after_id"))
    return op.reordered(s.select("project_id", "thought_id", "rank"), moves)


@BOOK.query()
def week_plan(spark, d):
    """Events without a date, every seventh of them here, put between the others of a week."""
    e = v.events(spark, d)
    n = F.col("thought_id") % 7
    undated = e.where(n == 0).select("user_id", "event_id", (F.col("minutes") * 10).alias("minutes"), (F.col("thought_id") % 100).alias("focus"))
    return planner.plan_week(undated, e.where(n != 0), "2000-06-05")
