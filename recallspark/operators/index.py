"""A kept index for lexical search: which texts hold a word, and how often, refreshed by batches.

A segment holds a batch's postings (``token, id, n``), dealt over ``buckets`` by a hash of the word that
readers can work out, and sorted by word in each file; and the ids that the batch put or took away. Of the
segments that name an id the newest counts. A search reads the buckets of its own words only, and the ids of
the segments after the oldest it found. Cues are searched with the text, as if they stood after it.

A batch that comes again replaces its segment. ``merged`` puts all segments into one, without what is
outdated.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.functions import text as t

POSTINGS, IDS = "token string, id long, n int, seg int, bucket int", "id long, seg int"


class Postings:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets

    def _bucket(self, token: Column) -> Column:
        return F.pmod(F.crc32(token.cast("binary")), F.lit(self.buckets)).cast("int")

    def _write(self, postings: DataFrame, ids: DataFrame, number: int) -> None:
        rows = postings.withColumn("bucket", self._bucket(F.col("token")))
        # A bucket's rows of a common word go to several files; each file is sorted, so that readers skip most of it.
        rows.repartition("bucket", F.pmod(F.hash("id"), F.lit(8))).sortWithinPartitions("bucket", "token", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/seg={number}")
        ids.write.mode("overwrite").parquet(f"{self.path}/ids/seg={number}")

    def put(self, notes: DataFrame, number: int, gone: DataFrame | None = None) -> None:
        """Segment ``number``: ``notes`` (id, text, and cues, an array, if there are any) as they are now; ``gone`` (id) are no more.

        A text that comes several times in a batch counts once, the longest (then the greatest) of them.
        """
        said = F.coalesce(F.col("text"), F.lit(""))
        if "cues" in notes.columns:
            said = F.concat_ws(" ", said, F.coalesce(F.col("cues"), F.array().cast("array<string>")))
        rows = notes.where("id is not null").select("id", said.alias("said")).groupBy("id").agg(F.max(F.struct(F.char_length("said"), "said")).alias("s"))
        if gone is not None:
            rows = rows.join(gone.select("id").distinct(), "id", "left_anti")
        tokens = rows.select("id", F.explode(t.tokens(F.col("s.said"))).alias("token")).groupBy("token", "id").agg(F.least(F.count("*"), F.lit(t.MOST_POSITIONS)).cast("int").alias("n"))
        ids = rows.select("id") if gone is None else rows.select("id").unionByName(gone.select("id").where("id is not null").distinct())
        self._write(tokens, ids, number)

    def _read(self, kind: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{kind}")

    def postings(self, wanted: Sequence[str] | None = None) -> DataFrame:
        """``token, id, n`` that count now, of all words or of those wanted."""
        rows = self._read("postings", POSTINGS)
        if wanted is not None:
            words = list(dict.fromkeys(wanted))
            rows = rows.where(F.col("bucket").isin(sorted({zlib.crc32(w.encode()) % self.buckets for w in words})) & F.col("token").isin(words))
        named = self._read("ids", IDS).groupBy("id").agg(F.max("seg").alias("newest"))
        return rows.join(named, "id").where("seg = newest").select("token", "id", "n")

    def search(self, wanted: Sequence[str], k: int) -> DataFrame:
        """``id, raw, rank`` of the k best texts that hold a wanted word, as ``lexical.search`` over the texts themselves."""
        weigh = F.create_map(*[F.lit(x) for w in dict.fromkeys(wanted) for x in (w, list(wanted).count(w))]) if wanted else None
        if weigh is None:
            return self.postings([]).select("id", F.lit(0.0).alias("raw"), F.lit(0.0).alias("rank")).limit(0)
        found = self.postings(wanted).groupBy("id").agg((t.A_POSITION * F.sum(F.col("n") * F.element_at(weigh, F.col("token"))).cast("double")).alias("raw"))
        return found.withColumn("rank", t.normal_rank(F.col("raw"))).orderBy(F.desc("raw"), "id").limit(k)

    def merged(self, path: str) -> Postings:
        """The same index with one segment, at another place."""
        other = Postings(self.spark, path, self.buckets)
        rows = self.postings()
        other._write(rows, rows.select("id").distinct(), 0)
        return other
