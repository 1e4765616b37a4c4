"""Streams whose batches are arrivals: late rows set apart, and tables that a batch is merged into once."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.session import deleted, new_folder


def arriving(rows: DataFrame, chunk: Column, chunks: int, run: Callable[[DataFrame, str], None], name: str = "arrivals") -> None:
    """Puts the chunks of ``rows`` into a folder one after the other, and after each lets ``run`` take what is new.

    ``run`` gets the stream over the folder and a place to keep its progress, and goes on where it was.
    """
    spark, path = rows.sparkSession, new_folder(rows.sparkSession, name)
    for n in range(chunks):
        rows.where(chunk == n).write.mode("append").parquet(path)
        run(spark.readStream.schema(rows.schema).parquet(path), path + "-progress")


def taken(stream: DataFrame, each: Callable[[DataFrame, int], None], progress: str) -> None:
    """Hands what is there now to ``each``, batch by batch. A batch whose end was not kept comes again, with its number."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()


class Lateness:
    """Rows on time and late ones, in tables by batch, under a watermark that is kept from batch to batch.

    A row is late if its time lies before the watermark: the greatest time of all earlier batches less
    ``hours``. Rows without a time are late. A batch that comes again replaces what it wrote.
    """

    def __init__(self, spark: SparkSession, column: str, hours: int, path: str) -> None:
        self.spark, self.column, self.hours, self.path = spark, column, hours, path

    def __call__(self, batch: DataFrame, number: int) -> None:
        before = None if number == 0 else self.spark.read.schema("mark timestamp").parquet(f"{self.path}/marks/{number - 1}").first()[0]
        at = F.col(self.column)
        late = at.isNull() if before is None else F.coalesce(at.cast("timestamp") < F.lit(before) - F.make_dt_interval(F.lit(0), F.lit(self.hours)), F.lit(True))
        for name, rows in (("on_time", batch.where(~late)), ("late", batch.where(late))):
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")
        most = F.greatest(F.max(at.cast("timestamp")), F.lit(before).cast("timestamp"))
        batch.agg(most.alias("mark")).write.mode("overwrite").parquet(f"{self.path}/marks/{number}")

    def rows(self, name: str, schema) -> DataFrame:
        """``on_time`` or ``late`` rows with the number of their batch."""
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}/*").withColumn("batch", F.regexp_extract(F.input_file_name(), r"/batch=(\d+)/", 1).cast("long"))


class Versioned:
    """A table of sums by key in numbered versions; version n holds all batches up to n.

    A batch is added up, merged with the version before its number, and written as the version of its number.
    Coming again, it is merged with the same version and writes the same rows, so nothing counts twice. Only
    whole versions are read, and the last ``keep`` stay.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], sums: Iterable[str] = (), most: Iterable[str] = (), keep: int = 3) -> None:
        self.spark, self.path, self.keys, self.keep = spark, path, keys, keep
        self.merge = [F.sum(c).alias(c) for c in sums] + [F.max(c).alias(c) for c in most]

    def versions(self) -> list[int]:
        """Numbers of the versions that were written to the end."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(int(f.getPath().getParent().getName()) for f in found or [])

    def version(self, number: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{number}")

    def now(self) -> DataFrame:
        return self.version(self.versions()[-1])

    def add(self, delta: DataFrame, number: int) -> None:
        """Merges a batch's rows (keys, sums and greatest values, of any number of rows a key)."""
        known = self.versions()
        before = [v for v in known if v < number]
        rows = delta.groupBy(*self.keys).agg(*self.merge)
        if before:
            rows = self.version(before[-1]).unionByName(rows).groupBy(*self.keys).agg(*self.merge)
        rows.write.mode("overwrite").parquet(f"{self.path}/{number}")
        for old in before[: 1 - self.keep] if self.keep > 1 else before:
            deleted(self.spark, f"{self.path}/{old}")
