"""The engine's tables over the driver's Parquet tables, and the same definitions as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallspark.sources.tables import table

#: The clocks of the examples; operators take the time as a parameter and never ask a machine for it.
EVENT_NOW, ORDER_NOW = "2024-02-01 00:00:00", "2001-09-01 00:00:00"


def accounts(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("c_mktsegment") == "MACHINERY", "harness").otherwise("production")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), kind.alias("account_kind"), F.floor("c_acctbal").cast("long").alias("available_credits"))


def events_k(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def calls(spark: SparkSession, d: str) -> DataFrame:
    e = events_k(spark, d)
    return e.select(F.col("event_id").alias("call_id"), "user_id", F.col("event_type").alias("operation"), F.col("value").cast("decimal(18,6)").alias("cost_usd"), F.col("k").cast("string").alias("group_id"), F.col("ts").alias("created_at"))


def ledger(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where(F.col("event_type").isin("purchase", "signup"))
    debit = F.col("event_type") == "purchase"
    amount = F.round("value").cast("long")
    return e.select(F.col("event_id").alias("entry_id"), "user_id", F.when(debit, "usage_debit").otherwise("top_up").alias("kind"), F.when(debit, -amount).otherwise(amount).alias("amount"), F.col("ts").alias("created_at"))


def decisions(spark: SparkSession, d: str) -> DataFrame:
    e = events_k(spark, d)
    agree = F.when(F.col("k") % 3 == 0, F.lit(None).cast("boolean")).otherwise(F.col("k") % 3 == 1)
    model = F.concat(F.lit("c"), (F.col("k") % 4).cast("string"))
    other = F.concat(F.lit("c"), ((F.col("k") + 1) % 4).cast("string"))
    return e.select("event_id", "user_id", F.col("event_type").alias("kind"), agree.alias("agree"), model.alias("model_choice"), F.when(F.coalesce(agree, F.lit(True)), model).otherwise(other).alias("rule_choice"), F.when(F.col("value") < 100, "chat").otherwise("model").alias("engine"), F.when(F.col("k") % 10 == 0, "timeout").alias("error"), F.col("ts").alias("created_at"))


def jobs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    status = F.element_at(F.array(*map(F.lit, ("pending", "running", "completed", "failed"))), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(F.col("event_id").alias("job_id"), "user_id", F.col("event_type").alias("job_type"), status.alias("status"), F.col("ts").alias("run_after"), F.concat(F.col("user_id").cast("string"), F.lit("-"), F.col("event_type")).alias("dedupe_key"), (F.col("event_id") % 5).cast("int").alias("attempts"))


def reviews(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "labels")
    part = lambda name, n: F.struct(F.lit(name).alias("part"), ((F.col("doc_id") % n) / F.lit(float(n))).alias("probability"))
    return r.select(F.col("doc_id").alias("review_id"), ((F.col("doc_id") % 100) / 100.0).alias("score"), F.when(F.col("quality") == 1, "up").otherwise("down").alias("verdict"), F.when(F.col("toxic") == 1, "tone").alias("reason"), F.array(part("entity", 10), part("time", 7)).alias("parts"))


def chats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"))


def notes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("tenant"), F.col("lang").alias("category"), "text")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def thoughts(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "completed").otherwise("archived")
    kind = F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2"), "task").otherwise("note")
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("created_at"), status.alias("lifecycle"), kind.alias("category"), F.col("o_totalprice").alias("price"), (F.col("o_totalprice") / 70001).alias("salience"))


def entities(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("p_size") <= 5, "active").when(F.col("p_size") <= 10, "someday")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_brand").alias("entity_type"), status.alias("project_status"), F.col("p_type").alias("l1"), F.concat_ws("/", "p_type", "p_brand").alias("l2"))


def mentions(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("thought_id"), F.col("l_partkey").alias("entity_id"))
    return g.agg((1 - F.max("l_discount")).alias("salience"), F.when(F.min("l_linenumber") == 1, "manual").otherwise("ingest").alias("source"))


def events(spark: SparkSession, d: str) -> DataFrame:
    """Dated events: lines that ship after their order's date, with a number within the order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount")
    l = table(spark, d, "lineitem").withColumn("n", F.row_number().over(order))  # noqa: E741
    o = table(spark, d, "orders")
    kind = F.when(F.col("l_returnflag") == "A", "deadline").when(F.col("l_returnflag") == "N", "appointment").otherwise("period")
    joined = l.join(o, l.l_orderkey == o.o_orderkey).where(F.col("l_shipdate") > F.col("o_orderdate"))
    return joined.select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("n").cast("string")).alias("event_id"), F.col("l_orderkey").alias("thought_id"), F.col("o_custkey").alias("user_id"), kind.alias("kind"), F.col("o_orderdate").alias("start_at"), F.col("l_shipdate").alias("end_at"), F.col("l_quantity").cast("int").alias("minutes"))


#: The same views in SQL, by name.
SQL: dict[str, str] = {
    "v_account": "SELECT c_custkey AS user_id, c_name AS name, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'harness' ELSE 'production' END AS account_kind, floor(c_acctbal)::BIGINT AS available_credits FROM customer",
    "v_k": "SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events",
    "v_call": "SELECT event_id AS call_id, user_id, event_type AS operation, value::DECIMAL(18,6) AS cost_usd, json_extract_string(props, '$.k') AS group_id, ts AS created_at FROM events",
    "v_ledger": "SELECT event_id AS entry_id, user_id, CASE WHEN event_type = 'purchase' THEN 'usage_debit' ELSE 'top_up' END AS kind, CASE WHEN event_type = 'purchase' THEN -round(value)::BIGINT ELSE round(value)::BIGINT END AS amount, ts AS created_at FROM events WHERE event_type IN ('purchase', 'signup')",
    "v_decision": "SELECT event_id, user_id, event_type AS kind, CASE WHEN k % 3 = 0 THEN NULL ELSE k % 3 = 1 END AS agree, 'c' || (k % 4) AS model_choice, CASE WHEN k % 3 = 2 THEN 'c' || ((k + 1) % 4) ELSE 'c' || (k % 4) END AS rule_choice, CASE WHEN value < 100 THEN 'chat' ELSE 'model' END AS engine, CASE WHEN k % 10 = 0 THEN 'timeout' END AS error, ts AS created_at FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events)",
    "v_job": "SELECT event_id AS job_id, user_id, event_type AS job_type, ['pending', 'running', 'completed', 'failed'][(event_id % 4 + 1)::INT] AS status, ts AS run_after, user_id || '-' || event_type AS dedupe_key, (event_id % 5)::INT AS attempts FROM events",
    "v_review": "SELECT doc_id AS review_id, (doc_id % 100) / 100.0::DOUBLE AS score, CASE WHEN quality = 1 THEN 'up' ELSE 'down' END AS verdict, CASE WHEN toxic = 1 THEN 'tone' END AS reason FROM labels",
    "v_part": "SELECT doc_id AS review_id, 'entity' AS part, (doc_id % 10) / 10.0::DOUBLE AS probability FROM labels UNION ALL SELECT doc_id, 'time', (doc_id % 7) / 7.0::DOUBLE FROM labels",
    "v_chat": "SELECT conv_id AS session_id, turn, role, text AS content FROM conversations",
    "v_note": "SELECT doc_id AS id, source AS tenant, lang AS category, text FROM documents",
    "v_vec": "SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label FROM embeddings",
    "v_thought": "SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate AS created_at, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'completed' ELSE 'archived' END AS lifecycle, CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'task' ELSE 'note' END AS category, o_totalprice AS price, o_totalprice / 70001 AS salience FROM orders",
    "v_entity": "SELECT p_partkey AS id, p_name AS label, p_brand AS entity_type, CASE WHEN p_size <= 5 THEN 'active' WHEN p_size <= 10 THEN 'someday' END AS project_status, p_type AS l1, p_type || '/' || p_brand AS l2 FROM part",
    "v_mention": "SELECT l_orderkey AS thought_id, l_partkey AS entity_id, 1 - max(l_discount) AS salience, CASE WHEN min(l_linenumber) = 1 THEN 'manual' ELSE 'ingest' END AS source FROM lineitem GROUP BY 1, 2",
    "v_event": "SELECT l_orderkey || '-' || n AS event_id, l_orderkey AS thought_id, o_custkey AS user_id, CASE l_returnflag WHEN 'A' THEN 'deadline' WHEN 'N' THEN 'appointment' ELSE 'period' END AS kind, o_orderdate AS start_at, l_shipdate AS end_at, l_quantity::INT AS minutes FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount) AS n FROM lineitem) JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate",
}


def ctes(*names: str) -> str:
    """A WITH clause of these views, to put more after it."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({SQL[n]})" for n in names)
