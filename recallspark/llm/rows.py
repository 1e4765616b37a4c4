"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than blank, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Documents that one Arrow batch holds at most; long texts make batches large.
ROWS_A_BATCH = 256

#: Bytes that one Arrow batch holds at most, but for a single longer document.
BYTES_A_BATCH = 16 << 20


#: Arrow batches, and about how many bytes of them, that are encoded together; each goes back to the JVM by itself,
#: where large ones take room.
BATCHES_A_COLUMN, BYTES_A_COLUMN = 8, 8 << 20


def batches(df: DataFrame, rows: int = ROWS_A_BATCH) -> DataFrame:
    """Sets the session's Arrow batches to numbers of rows and bytes that also suit long texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_A_BATCH))
    return df


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The batch's texts; a null text is the empty text."""
    return ["" if x is None else x for x in batch.column(column).to_pylist()]


def together(found: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches in lists, one after another."""
    held: list[pa.RecordBatch] = []
    for batch in found:
        held.append(batch)
        if len(held) == BATCHES_A_COLUMN or sum(x.nbytes for x in held) >= BYTES_A_COLUMN:
            yield held
            held = []
    if held:
        yield held


def rebatched(columns: Iterable[tuple], schema: pa.Schema, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Row tuples as record batches."""
    held: list[tuple] = []
    for row in columns:
        held.append(row)
        if len(held) == rows:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(column, type=field.type) for column, field in zip(zip(*held), schema)], schema=schema)


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that are made and run inside go when the query ends, not when the driver collects its garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def word_count(text) -> "F.Column":
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
