"""Usage, cost, quality, agreement, queue and chat queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallspark.operators import rollups as op
from recallspark.plans.book import Book
from recallspark.sources import views as v
from recallspark.sources.views import EVENT_NOW, ctes

BOOK = Book()
BAND = "CASE WHEN {0} < 0.5 THEN '<0.5' WHEN {0} < 0.7 THEN '0.5-0.7' WHEN {0} < 0.9 THEN '0.7-0.9' ELSE '>=0.9' END"


@BOOK.query(ctes("v_account", "v_call", "v_ledger") + """
, c AS (SELECT user_id, count(*) AS calls, sum(cost_usd) AS cost, max(created_at) AS last_call_at FROM v_call GROUP BY 1 HAVING sum(cost_usd) > 0)
, g AS (SELECT user_id, sum(abs(amount))::BIGINT AS credits FROM v_ledger WHERE kind = 'usage_debit' GROUP BY 1)
SELECT user_id, name, account_kind, coalesce(calls, 0)::BIGINT AS calls, coalesce(round(cost::DOUBLE, 6), 0.0)::DOUBLE AS cost_usd, last_call_at, coalesce(credits, 0)::BIGINT AS credits
FROM v_account LEFT JOIN c USING (user_id) LEFT JOIN g USING (user_id) WHERE account_kind = 'production'""")
def spend_by_user(spark, d):
    return op.spend_by_user(v.accounts(spark, d), v.calls(spark, d), v.ledger(spark, d))


@BOOK.query(ctes("v_call") + "SELECT count(*) AS calls, count(DISTINCT user_id) AS users, coalesce(round(sum(cost_usd)::DOUBLE, 6), 0.0)::DOUBLE AS cost_usd FROM v_call")
def spend_totals(spark, d):
    return op.spend_totals(v.calls(spark, d))


def _series(unit: str) -> str:
    step = {"day": "1 day", "week": "7 days", "month": "1 month"}[unit]
    return ctes("v_call") + f"""
, b AS (SELECT date_trunc('{unit}', created_at)::TIMESTAMP AS bucket, count(*) AS calls, sum(cost_usd) AS cost FROM v_call GROUP BY 1)
, e AS (SELECT date_trunc('{unit}', min(created_at))::TIMESTAMP AS a, date_trunc('{unit}', max(created_at))::TIMESTAMP AS z, count(*) AS n, count(DISTINCT group_id) AS g FROM v_call)
, t AS (SELECT unnest(generate_series(a, z, INTERVAL {step})) AS bucket, n, g FROM e)
SELECT t.bucket, coalesce(calls, 0)::BIGINT AS calls, coalesce(round(cost::DOUBLE, 6), 0.0)::DOUBLE AS cost_usd, floor(coalesce(calls, 0) * g::DOUBLE / n + 0.5)::BIGINT AS groups FROM t LEFT JOIN b USING (bucket)"""


@BOOK.query("""WITH c AS (SELECT o_custkey % 4 AS account, DATE '1995-01-03' + (o_orderkey * 7 % [10, 100, 400, 1][(o_custkey % 4 + 1)::INT])::INT AS day, o_totalprice::DECIMAL(18,6) AS cost FROM orders)
, s AS (SELECT account, min(day) AS a, max(day) AS b, CASE WHEN max(day) - min(day) <= 31 THEN 'day' WHEN max(day) - min(day) <= 180 THEN 'week' ELSE 'month' END AS unit FROM c GROUP BY 1)
, g AS (SELECT account, unit, unnest(CASE unit WHEN 'day' THEN generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY) WHEN 'week' THEN generate_series(date_trunc('week', a)::TIMESTAMP, date_trunc('week', b)::TIMESTAMP, INTERVAL 7 DAY) ELSE generate_series(date_trunc('month', a)::TIMESTAMP, date_trunc('month', b)::TIMESTAMP, INTERVAL 1 MONTH) END) AS bucket FROM s)
, n AS (SELECT account, date_trunc(unit, day)::TIMESTAMP AS bucket, count(*) AS calls, sum(cost) AS cost FROM c JOIN s USING (account) GROUP BY 1, 2)
SELECT account, unit, bucket, coalesce(calls, 0)::BIGINT AS calls, coalesce(round(cost::DOUBLE, 6), 0) AS cost_usd FROM g LEFT JOIN n USING (account, bucket)""")
def spend_series_adaptive(spark, d):
    # Accounts whose calls lie within ten, a hundred, four hundred days and one.
    span = F.element_at(F.array(*map(F.lit, (10, 100, 400, 1))), (F.col("o_custkey") % 4 + 1).cast("int"))
    day = F.date_add(F.lit("1995-01-03").cast("date"), (F.col("o_orderkey") * 7 % span).cast("int"))
    calls = v.table(spark, d, "orders").select((F.col("o_custkey") % 4).alias("account"), day.cast("timestamp_ntz").alias("created_at"), F.col("o_totalprice").cast("decimal(18,6)").alias("cost_usd"))
    return op.spend_series_by(calls, "account")


@BOOK.query(_series("day"))
def spend_series_day(spark, d):
    return op.spend_series(v.calls(spark, d), "day")


@BOOK.query(_series("week"))
def spend_series_week(spark, d):
    return op.spend_series(v.calls(spark, d), "week")


@BOOK.query(_series("month"))
def spend_series_month(spark, d):
    return op.spend_series(v.calls(spark, d), "month")


@BOOK.query(ctes("v_call") + "SELECT call_id, user_id, operation, round(cost_usd::DOUBLE, 6) AS cost_usd, (SELECT count(*) FROM v_call) AS total, 3::INT AS page FROM v_call ORDER BY created_at DESC, call_id DESC LIMIT 50 OFFSET 100")
def calls_page(spark, d):
    rows = v.calls(spark, d)
    return op.page(rows, [F.desc("created_at"), F.desc("call_id")], 50, 3).select("call_id", "user_id", "operation", op.usd(F.col("cost_usd")).alias("cost_usd"), "total", "page")


@BOOK.query(ctes("v_call") + "SELECT call_id, user_id, operation, created_at, row_number() OVER (ORDER BY created_at DESC, call_id DESC)::INT AS place, true AS has_more FROM v_call WHERE created_at < TIMESTAMP '2024-01-20' OR (created_at = TIMESTAMP '2024-01-20' AND call_id < 0) ORDER BY created_at DESC, call_id DESC LIMIT 40")
def calls_keyset(spark, d):
    return op.keyset_page(v.calls(spark, d), "created_at", "call_id", ("2024-01-20 00:00:00", 0), 40).select("call_id", "user_id", "operation", "created_at", "place", "has_more")


@BOOK.query(ctes("v_call") + """
, g AS (SELECT 'g:' || group_id AS group_key, min(created_at) AS first_at, count(*) AS calls, round(sum(cost_usd)::DOUBLE, 6) AS cost_usd FROM v_call GROUP BY 1)
SELECT *, (SELECT count(*) FROM g) AS total, 2::INT AS page FROM g ORDER BY first_at DESC, group_key LIMIT 20 OFFSET 20""")
def activity_groups(spark, d):
    return op.activity_groups(v.calls(spark, d), 20, 2)


@BOOK.query(ctes("v_call") + "SELECT operation, count(*) AS calls, round(sum(cost_usd)::DOUBLE, 6) AS cost_usd, round(sum(cost_usd * 1.2::DECIMAL(3,1))::DOUBLE, 6) AS charged_usd FROM v_call GROUP BY 1")
def cost_by_operation(spark, d):
    return op.cost_by_operation(v.calls(spark, d))


@BOOK.query(ctes("v_review") + """
SELECT count(*) AS reviews, count(*) FILTER (verdict = 'up') AS up, count(*) FILTER (verdict = 'down') AS down, count(reason) AS with_reason,
  count(*) FILTER (score::FLOAT >= 0.9::FLOAT) AS high, count(*) FILTER (score::FLOAT < 0.5::FLOAT) AS low,
  count(*) FILTER (score::FLOAT < 0.5::FLOAT AND verdict = 'up') AS low_but_up, count(*) FILTER (score::FLOAT >= 0.9::FLOAT AND verdict = 'down') AS high_but_down FROM v_review""")
def quality_totals(spark, d):
    return op.quality_totals(v.reviews(spark, d))


@BOOK.query(ctes("v_review") + f"SELECT {BAND.format('score')} AS band, count(*) AS reviews, count(*) FILTER (verdict = 'up') AS up, count(reason) AS with_reason FROM v_review GROUP BY 1")
def quality_bands(spark, d):
    return op.quality_bands(v.reviews(spark, d))


@BOOK.query(ctes("v_part") + f", m AS (SELECT review_id, part, min(probability) AS p FROM v_part GROUP BY 1, 2) SELECT part, {BAND.format('p')} AS band, count(*) AS reviews FROM m GROUP BY 1, 2")
def part_bands(spark, d):
    return op.part_bands(v.reviews(spark, d))


@BOOK.query(ctes("v_part") + ", m AS (SELECT *, min(probability) OVER (PARTITION BY review_id) AS least FROM v_part) SELECT part, count(DISTINCT review_id) AS reviews, round(avg(probability), 6) AS mean_probability FROM m WHERE probability = least GROUP BY 1")
def weakest_part(spark, d):
    return op.weakest_part(v.reviews(spark, d))


@BOOK.query(ctes("v_decision") + "SELECT kind, count(*) AS n, count(agree) AS compared, count(*) FILTER (agree IS TRUE) AS agreed, count(*) FILTER (agree IS FALSE) AS disagreed, count(error) AS errored, round(count(*) FILTER (agree IS TRUE)::DOUBLE / nullif(count(agree), 0), 6) AS rate FROM v_decision GROUP BY 1")
def agreement_by_kind(spark, d):
    return op.agreement_by_kind(v.decisions(spark, d))


@BOOK.query(ctes("v_decision") + "SELECT kind, model_choice, rule_choice, count(*) AS n FROM v_decision WHERE agree IS FALSE GROUP BY 1, 2, 3 ORDER BY n DESC, 1, 2, 3 LIMIT 25")
def confusion_pairs(spark, d):
    return op.confusion_pairs(v.decisions(spark, d))


@BOOK.query(ctes("v_decision") + "SELECT kind, (list(engine ORDER BY created_at DESC, event_id DESC))[1] AS engine, max(created_at) AS at FROM v_decision GROUP BY 1")
def latest_engine(spark, d):
    return op.latest_engine(v.decisions(spark, d))


@BOOK.query(ctes("v_job") + """
SELECT count(*) FILTER (status = 'pending' AND run_after <= TIMESTAMP '2024-01-15') AS due, count(*) FILTER (status = 'pending' AND run_after > TIMESTAMP '2024-01-15') AS later,
  count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'failed') AS failed,
  (epoch(TIMESTAMP '2024-01-15') - floor(epoch(min(run_after) FILTER (status = 'pending' AND run_after <= TIMESTAMP '2024-01-15'))))::BIGINT AS oldest_seconds FROM v_job""")
def queue_health(spark, d):
    return op.queue_health(v.jobs(spark, d), "2024-01-15 00:00:00")


@BOOK.query(ctes("v_job") + "SELECT job_type, status, count(*) AS n FROM v_job GROUP BY 1, 2")
def status_rollup(spark, d):
    return op.status_rollup(v.jobs(spark, d))


@BOOK.query(ctes("v_job") + "SELECT job_id, status, run_after, (list_position(['running', 'pending', 'failed', 'completed'], status) - 1)::INT AS status_rank FROM v_job ORDER BY status_rank, run_after NULLS LAST, job_id LIMIT 60")
def job_list(spark, d):
    return op.job_list(v.jobs(spark, d), 60).select("job_id", "status", "run_after", "status_rank")


@BOOK.query(ctes("v_chat") + "SELECT session_id, count(content) AS messages, substr(max(content) FILTER (role = 'user'), 1, 80) AS preview, substr(arg_min(content, turn) FILTER (role = 'user'), 1, 80) AS first_message FROM v_chat GROUP BY 1")
def chat_sessions(spark, d):
    return op.chat_sessions(v.chats(spark, d))


@BOOK.query(ctes("v_ledger") + """
, t AS (SELECT user_id, max(created_at) AS since FROM v_ledger WHERE kind = 'top_up' AND amount > 0 GROUP BY 1)
, u AS (SELECT l.user_id, -sum(amount)::BIGINT AS used FROM v_ledger l LEFT JOIN t USING (user_id) WHERE kind = 'usage_debit' AND (since IS NULL OR created_at > since) GROUP BY 1)
SELECT user_id, since, coalesce(used, 0)::BIGINT AS used FROM (SELECT DISTINCT user_id FROM v_ledger) LEFT JOIN t USING (user_id) LEFT JOIN u USING (user_id)""")
def credit_meter(spark, d):
    return op.credit_meter(v.ledger(spark, d))


@BOOK.query(ctes("v_call") + """
, m AS (SELECT call_id, user_id, round(cost_usd::DOUBLE * 1000)::BIGINT AS micro, created_at FROM v_call)
, s AS (SELECT *, sum(micro) OVER (PARTITION BY user_id ORDER BY created_at, call_id ROWS UNBOUNDED PRECEDING)::BIGINT AS s FROM m)
SELECT call_id, user_id, micro, (s // 1000 - (s - micro) // 1000)::BIGINT AS credits, (s % 1000)::BIGINT AS carry FROM s""")
def micro_usd_carry(spark, d):
    return op.micro_carry(v.calls(spark, d))


@BOOK.query("""
WITH v AS (SELECT doc_id % 50 AS idea_id, doc_id AS voter_id, CASE WHEN quality = 1 THEN 1 ELSE -1 END AS vote FROM labels)
, s AS (SELECT idea_id, sum(vote)::BIGINT AS score, count(*) AS votes FROM v GROUP BY 1), o AS (SELECT idea_id, max(vote) AS own_vote FROM v WHERE voter_id = 1 GROUP BY 1)
SELECT item_id AS idea_id, substr(text, 1, 20) AS title, coalesce(score, 0)::BIGINT AS score, coalesce(votes, 0)::BIGINT AS votes, own_vote FROM benchmark LEFT JOIN s ON s.idea_id = item_id LEFT JOIN o ON o.idea_id = item_id""")
def board_scores(spark, d):
    votes = v.table(spark, d, "labels").select((F.col("doc_id") % 50).alias("idea_id"), F.col("doc_id").alias("voter_id"), F.when(F.col("quality") == 1, 1).otherwise(-1).alias("vote"))
    ideas = v.table(spark, d, "benchmark").select(F.col("item_id").alias("idea_id"), F.substring("text", 1, 20).alias("title"))
    return op.board_scores(votes, ideas, 1)


@BOOK.query(_series("day").replace("SELECT t.bucket, coalesce(calls, 0)::BIGINT AS calls", ", z AS (SELECT t.bucket, coalesce(calls, 0)::BIGINT AS calls") + """)
, p AS (SELECT calls, row_number() OVER (ORDER BY bucket) AS r, count(*) OVER () AS n, calls - lag(calls) OVER (ORDER BY bucket) AS step FROM z)
SELECT round(avg(calls) FILTER (r <= n // 2), 6) AS first_half, round(avg(calls) FILTER (r > n // 2), 6) AS second_half, round(avg(step), 6) AS mean_step FROM p""")
def spend_trend(spark, d):
    return op.trend(op.spend_series(v.calls(spark, d), "day"), "bucket", "calls")


@BOOK.query(ctes("v_account") + "SELECT user_id, name, available_credits FROM v_account WHERE name ILIKE '%0001%' OR account_kind ILIKE '%harn%1' ORDER BY available_credits DESC NULLS FIRST, user_id LIMIT 25")
def account_search(spark, d):
    rows = v.accounts(spark, d).where(F.col("name").ilike("%0001%") | F.col("account_kind").ilike("%harn%1"))
    return rows.select("user_id", "name", "available_credits").orderBy(F.desc_nulls_first("available_credits"), "user_id").limit(25)
