"""Places in a global order, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallspark.session import written


def placed(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``rows`` with their place under an order, from 1, equal ones in any order.

    Rows are dealt by ranges of the order and numbered within each; the one row a range that tells how many
    stand before it is all that meets in one task.
    """
    dealt = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sums.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn(name, within).join(F.broadcast(before), "_range").withColumn(name, (F.col("_before") + F.col(name)).cast("int")).drop("_range", "_before")
