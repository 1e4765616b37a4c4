"""Vector queries. Distances round to 6 digits; thresholds fit the driver's vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallspark.operators import vector
from recallspark.plans.book import Book
from recallspark.sources import views as v
from recallspark.sources.views import ctes

BOOK = Book()


def query_vector(spark, d, number: int = 0) -> list[float]:
    """The stored vector of one row, the query of the examples: one row reaches the driver."""
    return v.vectors(spark, d).where(F.col("id") == number).select("vec").first()[0]


_Q = "(SELECT vec FROM v_vec WHERE id = 0)"


@BOOK.query(ctes("v_vec") + f"SELECT id AS vec_id, round(list_cosine_distance(vec, {_Q}), 6) AS distance FROM v_vec WHERE id <> 0 ORDER BY list_cosine_distance(vec, {_Q}), id LIMIT 30")
def vector_topk(spark, d):
    found = vector.top_k(v.vectors(spark, d).where("id <> 0"), "id", "vec", query_vector(spark, d), 30)
    return found.select(F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"))


@BOOK.query(ctes("v_vec") + f"SELECT id AS vec_id, label, round(list_cosine_distance(vec, {_Q}), 6) AS distance, round(greatest(0, 1 - list_cosine_distance(vec, {_Q})), 6) AS similarity FROM v_vec WHERE id <> 0 AND label = 3 AND list_cosine_distance(vec, {_Q}) <= 0.95 ORDER BY list_cosine_distance(vec, {_Q}), id LIMIT 12")
def vector_topk_filtered(spark, d):
    found = vector.top_k(v.vectors(spark, d).where("id <> 0 and label = 3"), "id", "vec", query_vector(spark, d), 12, floor=0.95)
    return found.select(F.col("id").alias("vec_id"), F.lit(3).cast("int").alias("label"), F.round("distance", 6).alias("distance"), F.round(vector.similarity(F.col("distance")), 6).alias("similarity"))


@BOOK.query(ctes("v_vec") + f"SELECT id, round(list_cosine_distance(vec, {_Q}), 6) AS distance FROM v_vec WHERE id % 9 <> 1 AND label % 4 < 2 ORDER BY list_cosine_distance(vec, {_Q}), id LIMIT 20")
def open_duplicates(spark, d):
    status = F.element_at(F.array(*map(F.lit, ("open", "planned", "shipped", "rejected"))), (F.col("label") % 4 + 1).cast("int"))
    ideas = v.vectors(spark, d).withColumns({"status": status, "hidden": F.col("id") % 9 == 1})
    return vector.duplicate_candidates(ideas, query_vector(spark, d), 50).withColumn("distance", F.round("distance", 6))


_KNN = """, p AS (SELECT a.id, b.id AS other_id, list_cosine_distance(a.vec, b.vec) AS distance FROM v_vec a JOIN v_vec b ON a.id <> b.id {0} WHERE list_cosine_distance(a.vec, b.vec) <= 0.75)
SELECT id, other_id, round(distance, 6) AS distance, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, other_id)::INT AS k FROM p) WHERE k <= {1}"""


@BOOK.query(ctes("v_vec") + _KNN.format("AND a.id % 20 = 0", 3))
def vector_knn_join(spark, d):
    rows = v.vectors(spark, d)
    return vector.knn_join(rows.where("id % 20 = 0"), rows, 3, 0.75).withColumn("distance", F.round("distance", 6))


@BOOK.query(ctes("v_vec") + _KNN.format("AND a.id % 20 = 0 AND a.label = b.label", 1))
def nearest_same_type(spark, d):
    rows = v.vectors(spark, d)
    return vector.knn_join(rows.where("id % 20 = 0"), rows, 1, 0.75, same="label").withColumn("distance", F.round("distance", 6))


@BOOK.query(ctes("v_vec") + "SELECT id, round(list_sum(list_transform(vec, lambda x: x * x)) , 6) AS norm2, round(sqrt(list_sum(list_transform(list_transform(vec, lambda x: x * 3 / sqrt(list_sum(list_transform(vec, lambda y: y * y * 9)))), lambda z: z * z))), 6) AS unit_norm FROM v_vec")
def l2_normalize(spark, d):
    tripled = F.transform("vec", lambda x: x * 3)
    return v.vectors(spark, d).withColumn("u", vector.unit(tripled)).select("id", F.round(vector.dot(F.col("vec"), F.col("vec")), 6).alias("norm2"), F.round(vector.norm(F.col("u")), 6).alias("unit_norm"))
