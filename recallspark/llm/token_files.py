"""Token ids as ORC files: sorted by document, pruned by stripe and row-group metadata.

Ids are integers under ORC's run-length encoding. Files hold ascending ranges of ``doc_id``, with row
indexes and a Bloom filter on it, so that a reader of some documents skips files, stripes and row
groups; large files are read by several tasks, stripe by stripe.

Rules for odd input: a null text is the empty text, which is the end id alone. Rows whose ``doc_id`` is
null stand first; rows of equal ``doc_id`` all stay, next to each other. An empty table makes files
without rows. Other columns of the input are not written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallspark.llm.chunks import ColumnChunks, packed
from recallspark.llm.rows import batches, together

SCHEMA = "doc_id long, row long, start_in_file long, n_tokens long, ids array<int>"


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ColumnChunks:
    """The library's tokenizer, one a process, giving ids as 32-bit integers."""
    return ColumnChunks(path)


def write(docs: DataFrame, tokenizer_path: str, end_id: int, path: str, *, stripe_bytes: int = 16 << 20, rows_a_group: int = 1000) -> None:
    """Encodes each text, appends ``end_id`` and writes the files.

    Texts are range-partitioned before they are encoded, so that no row is encoded twice for the sake
    of the ranges. ``row`` rises over all files; its upper bits name the file's partition.
    """

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, before, end = tokenizer(tokenizer_path), 0, packed([end_id])
        for some in together(found):
            sizes, values = coder.parts(pa.concat_arrays([x.column("text") for x in some])).ids(end)
            at = np.r_[0, np.cumsum(sizes)]
            starts, row = before + at[:-1], 0
            before += int(at[-1])
            for batch in some:
                here = slice(row, row := row + batch.num_rows)
                a, b = at[here.start], at[here.stop]
                ids = pa.ListArray.from_arrays(pa.array((at[here.start : here.stop + 1] - a).astype(np.int32)), pa.array(values[a:b]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(starts[here]), pa.array(sizes[here]), ids], ["doc_id", "row", "start_in_file", "n_tokens", "ids"])

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = ["doc_id", F.xxhash64("text")]
    dealt = batches(wanted).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id())
    (
        dealt.mapInArrow(run, SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(rows_a_group))
        .option("orc.stripe.size", str(stripe_bytes))
        .option("compression", "zstd")
        .orc(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows ``doc_id, row, start_in_file, n_tokens, ids``; filters on ``doc_id`` reach the ORC reader."""
    return spark.read.schema(SCHEMA).orc(path)


def summary(spark: SparkSession, path: str) -> DataFrame:
    """Per document ``doc_id, start, n_tokens, ids_crc32``, from the files.

    ``start`` is the number of ids before it over all files: its place in its file plus the ids of the
    files before, of which there is one row a file.
    """

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer.cache_clear()  # a worker that wrote the files still has its table of chunks
        for batch in found:
            ids = batch.column("ids")
            ends, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crcs = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            sizes = np.diff(ends).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), batch.column("start_in_file"), pa.array(sizes), pa.array(crcs, pa.int64())], ["doc_id", "row", "start_in_file", "n_tokens", "ids_crc32"])

    file = F.shiftright("row", 33)
    rows = batches(read(spark, path).select("doc_id", "row", "start_in_file", "ids")).mapInArrow(run, "doc_id long, row long, start_in_file long, n_tokens long, ids_crc32 long")
    totals = read(spark, path).groupBy(file.alias("file")).agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.withColumn("file", file).join(F.broadcast(offsets), "file").select("doc_id", (F.col("before") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32")
