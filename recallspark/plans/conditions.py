"""Shared conditions, reminders and due questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallspark.functions import filters, predicates as p
from recallspark.plans.book import Book
from recallspark.sources import views as v
from recallspark.sources.views import ORDER_NOW, ctes

BOOK = Book()

_META = """, m AS (SELECT *, CASE id % 5 WHEN 0 THEN '{"status":"completed"}' WHEN 1 THEN '{"status":"open"}' WHEN 2 THEN '{"neverStale":true}' END AS metadata FROM v_thought)"""


def _marked(spark, d):
    k = F.col("id") % 5
    meta = F.when(k == 0, '{"status":"completed"}').when(k == 1, '{"status":"open"}').when(k == 2, '{"neverStale":true}')
    return v.thoughts(spark, d).withColumn("metadata", meta)


@BOOK.query(ctes("v_thought") + _META + "SELECT id FROM m WHERE lifecycle = 'open' AND coalesce(json_extract_string(metadata, '$.status'), '') NOT IN ('completed', 'archived')")
def active_thoughts(spark, d):
    return _marked(spark, d).where(p.is_active(F.col("lifecycle"), F.col("metadata"))).select("id")


@BOOK.query(ctes("v_thought") + _META + f"SELECT id, created_at + INTERVAL 365 DAY < TIMESTAMP '{ORDER_NOW}' AND id % 5 <> 2 AS stale FROM m")
def stale_thoughts(spark, d):
    return _marked(spark, d).select("id", p.is_stale(F.col("created_at"), F.col("category"), F.col("metadata"), ORDER_NOW, 365).alias("stale"))


def _authored(spark, d):
    i = F.col("id")
    author = F.when((i % 3 == 0) | (i % 7 == 0), "agent").otherwise("user")
    return _marked(spark, d).withColumns({"author": author, "author_key": F.when(i % 3 == 0, (i % 4).cast("string")), "author_label": F.when(i % 7 == 0, F.lit("bot"))})


_AUTHORED = ctes("v_thought") + _META + ", au AS (SELECT *, CASE WHEN id % 3 = 0 OR id % 7 = 0 THEN 'agent' ELSE 'user' END AS author, CASE WHEN id % 3 = 0 THEN (id % 4)::VARCHAR END AS author_key, CASE WHEN id % 7 = 0 THEN 'bot' END AS author_label, lifecycle = 'open' AND coalesce(json_extract_string(metadata, '$.status'), '') NOT IN ('completed', 'archived') AS active FROM m) "


@BOOK.query(_AUTHORED + "SELECT id, created_at FROM au WHERE active AND category = 'task' AND created_at >= TIMESTAMP '1996-03-01' AND created_at <= TIMESTAMP '1997-09-01' ORDER BY created_at DESC, id DESC LIMIT 100")
def thoughts_by_dates(spark, d):
    return filters.thoughts(_authored(spark, d), 500, category="task", date_from="1996-03-01", date_to="1997-09-01", author=None).select("id", "created_at")


@BOOK.query(_AUTHORED + "SELECT id, created_at FROM au WHERE active AND author <> 'user' AND author_key = '2' AND (created_at < TIMESTAMP '1997-05-05' OR created_at = TIMESTAMP '1997-05-05' AND id < 7000) ORDER BY created_at DESC, id DESC LIMIT 50")
def thoughts_after_page(spark, d):
    return filters.thoughts(_authored(spark, d), 50, layer="apikey:2", cursor=("1997-05-05", 7000)).select("id", "created_at")


@BOOK.query(_AUTHORED + "SELECT id, created_at FROM au WHERE author <> 'user' AND author_key IS NULL AND author_label = 'bot' AND user_id = 7 ORDER BY created_at DESC, id DESC LIMIT 20")
def thoughts_of_a_label(spark, d):
    return filters.thoughts(_authored(spark, d), layer="label:bot", tenant=7, active=False).select("id", "created_at")


@BOOK.query(ctes("v_thought") + "SELECT CASE WHEN id % 3 = 0 THEN 'apikey:' || (id % 4) WHEN id % 7 = 0 THEN 'label:bot' ELSE 'user' END AS layer, count(*) AS n FROM v_thought GROUP BY 1")
def thoughts_by_author(spark, d):
    i = F.col("id")
    layer = p.author_layer(F.lit("user"), F.when(i % 3 == 0, (i % 4).cast("string")), F.when(i % 7 == 0, F.lit("bot")))
    return v.thoughts(spark, d).groupBy(layer.alias("layer")).agg(F.count("*").alias("n"))


@BOOK.query(ctes("v_thought") + "SELECT id, CASE WHEN id % 2 = 0 THEN created_at - to_minutes(id % 60) WHEN created_at < date_trunc('day', created_at) + INTERVAL 9 HOUR THEN date_trunc('day', created_at) + INTERVAL 9 HOUR ELSE date_trunc('day', created_at) + INTERVAL 33 HOUR END::TIMESTAMP AS fire_at FROM v_thought")
def reminder_times(spark, d):
    i = F.col("id")
    fire = p.reminder_at(F.when(i % 2 == 0, F.col("created_at")), i % 60, F.col("created_at"), "UTC")
    return v.thoughts(spark, d).select("id", fire.alias("fire_at"))


@BOOK.query(ctes("v_thought") + f", n AS (SELECT user_id, count(*) AS notes, max(created_at) FILTER (id % 4 = 0) AS last FROM v_thought GROUP BY 1) SELECT user_id FROM n WHERE notes % 10 = 0 AND (last IS NULL OR last + INTERVAL 7 DAY <= TIMESTAMP '{ORDER_NOW}')")
def questions_due(spark, d):
    rows = v.thoughts(spark, d).groupBy("user_id").agg(F.count("*").alias("notes"), F.max(F.when(F.col("id") % 4 == 0, F.col("created_at"))).alias("last"))
    return rows.where(p.question_due(F.col("notes"), F.col("last"), ORDER_NOW)).select("user_id")
