"""Streams over a folder of event files: buckets, dedupe, late rows, queues."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.session import new_folder


def event_stream(spark: SparkSession, path: str, schema, files_a_trigger: int = 16) -> DataFrame:
    """A stream of the Parquet files that appear in a folder; ``ts`` becomes a time with zone for watermarks."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day", late: str = "24 hours") -> DataFrame:
    """Count and value by bucket and type; rows later than the watermark are dropped."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,6)")).alias("total")).select(F.col("w.start").alias("bucket"), "event_type", "n", "total")


def active_once(jobs: DataFrame, late: str = "24 hours") -> DataFrame:
    """One active job of each key within the watermark."""
    return jobs.withWatermark("ts", late).dropDuplicatesWithinWatermark(["dedupe_key"])


def not_late(events: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """Reminders that are due and no more than a day late."""
    age = F.unix_timestamp(F.lit(now)) - F.unix_timestamp("ts")
    return events.where((age >= 0) & (age <= hours * 3600))


def to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and returns what it wrote; files and progress are in the shared folder.

    A run that is started again goes on from the progress that was kept.
    """
    spark = stream.sparkSession
    path = new_folder(spark, name)
    if mode == "complete":
        def put(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(path)

        stream.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", path + "-progress").trigger(availableNow=True).start().awaitTermination()
    else:
        appended(stream, path, path + "-progress")
    return spark.read.schema(stream.schema).parquet(path)


def appended(stream: DataFrame, path: str, progress: str) -> None:
    """Runs a stream over what is there now, from where ``progress`` says, and adds what it gives to the files at ``path``."""
    stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()


def claimed(queue: DataFrame, now: str, limit: int, stale_minutes: int = 10) -> DataFrame:
    """The next due jobs in order, those that have been running for too long among them, marked as running."""
    at = F.lit(now).cast("timestamp_ntz")
    stale = (F.col("status") == "running") & (F.col("run_after") < at - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(stale_minutes)))
    due = queue.where(((F.col("status") == "pending") & (F.col("run_after") <= at)) | stale)
    return due.orderBy("run_after", "job_id").limit(limit).withColumn("status", F.lit("running")).withColumn("attempts", F.col("attempts") + 1)


def by_batches(stream: DataFrame, refresh: Callable[[DataFrame, int], None], progress: str) -> None:
    """Hands each micro-batch to ``refresh``, which has to be idempotent by batch number."""
    stream.writeStream.foreachBatch(refresh).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()


def reminder_tick(schedule: DataFrame, now: str, limit: int = 200, catch_up: str = "24 HOURS") -> DataFrame:
    """The oldest due reminders of one tick as ``sent``, or ``skipped``: too late, already begun, or no longer open."""
    at = F.lit(now).cast("timestamp_ntz")
    due = schedule.where(F.col("fire_at") <= at).orderBy("fire_at", "job_id").limit(limit)
    late = F.col("fire_at") < at - F.expr(f"INTERVAL {catch_up}")
    begun = F.coalesce(F.col("start_at") <= at, F.lit(False))
    return due.withColumn("status", F.when((F.col("lifecycle") != "open") | begun | late, "skipped").otherwise("sent"))


def next_attempts(jobs: DataFrame, limit: int = 20, most: int = 3) -> DataFrame:
    """Pending jobs that have attempts left, the oldest first."""
    return jobs.where((F.col("status") == "pending") & (F.col("attempts") < most)).orderBy("run_after", "job_id").limit(limit)


def after_attempt(taken: DataFrame, most: int = 3) -> DataFrame:
    """Jobs after an attempt (``ok``): completed, pending again, or failed for good at the last attempt."""
    tried = F.col("attempts") + 1
    return taken.withColumns({"status": F.when(F.col("ok"), "completed").when(tried >= most, "failed").otherwise("pending"), "attempts": tried})
