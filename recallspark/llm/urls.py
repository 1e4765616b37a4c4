"""URL verdicts from a list of hosts and path prefixes: a blocked Bloom filter, then an exact hash join.

A listed rule is a host and the beginning of a path; it fits its host and all subdomains, and of the rules
that fit the longest decides. A page is looked up under every pair of a suffix of its host, at a dot, and a
beginning of its path, of a length that some listed path has. The Bloom filter, whose blocks are one
64-byte line each, answers most look-ups in the scan; keys that may be listed go to the join, which drops
false hits. A page that no rule fits is not listed and gets ``allow``.

Rules for odd input: a null url or one without ``://`` has empty host and path. Hosts are lower-cased in
A-Z only. Of a very long host only as many labels are looked up as the longest listed host has. Repeated rows are judged each for itself. A list without rules allows every page; of rules equal
in host and path the blocking one holds. An empty table gives an empty result. Other columns are carried
through by ``judged``; those named like a result are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallspark.llm.rows import batches
from recallspark.session import new_folder, written

#: Bits of one block, and bits set in it for each key.
BLOCK_BITS, KEY_BITS = 512, 8

#: Look-ups that make a key hot, and hot keys that are sent to all tasks at most.
HOT, SENT = 10_000, 50_000

#: Blocks a filter has at most: 64 MB, which is what is sent to the executors however long the list is.
MOST_BLOCKS = 1 << 20


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(after, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules ``(verdict, host, path)`` as a table; lists of any length may come from files instead."""
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def canonical(host: Column, path: Column) -> Column:
    """The key of a listed rule or of a look-up: no host holds a slash, so the first one parts the two."""
    return F.concat(host, F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("\x00"), path)))


def _places(keys: list[bytes], blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Each key's block and the bits set in it."""
    h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
    block = (h >> np.uint64(32)) % np.uint64(blocks)
    low, step = h & np.uint64(0xFFFFFFFF), ((h >> np.uint64(17)) | np.uint64(1)) & np.uint64(0xFFFFFFFF)
    bits = (low[:, None] + step[:, None] * np.arange(KEY_BITS, dtype=np.uint64)) % np.uint64(BLOCK_BITS)
    return block.astype(np.int64), bits.astype(np.int64)


def bloom(rules: DataFrame, false_hits: float = 0.01) -> np.ndarray:
    """The filter over ``key`` as rows of 64-bit words, one row a block.

    Its size follows the list up to ``MOST_BLOCKS``; beyond, more look-ups pass to the join, which is
    exact anyway. Blocks are put together by a grouped bit-wise or, so that tasks send each block once.
    """
    n = rules.count()
    wanted = math.ceil(max(1, n) * -math.log(false_hits) / math.log(2) ** 2 * 1.5 / BLOCK_BITS)
    blocks = min(MOST_BLOCKS, 1 << (wanted - 1).bit_length() if wanted > 1 else 1)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            block, bits = _places([k.encode() for k in batch.column("key").to_pylist()], blocks)
            word = np.repeat(block, KEY_BITS) * (BLOCK_BITS // 64) + (bits // 64).ravel()
            mask = (np.uint64(1) << (bits % 64).ravel().astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask)], ["word", "mask"])

    lines = np.zeros(blocks * (BLOCK_BITS // 64), dtype=np.uint64)
    made = rules.select("key").mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    lines[made.column("word").to_numpy()] = made.column("mask").to_numpy().astype(np.uint64)
    return lines.reshape(blocks, -1)


def may_hold(lines: np.ndarray, keys: list[bytes]) -> np.ndarray:
    if not keys:
        return np.zeros(0, dtype=bool)
    block, bits = _places(keys, len(lines))
    words = lines[block[:, None], bits // 64]
    return ((words >> (bits % 64).astype(np.uint64)) & np.uint64(1)).all(axis=1)


def lookups(host: str, path: str, lengths: Sequence[int], labels: int = 127) -> list[str]:
    """Keys under which a page may be listed, the longest first; no listed host has more than ``labels`` labels."""
    if not host:
        return []
    # What is left of the last labels stays in one piece, and is a label more only where that is the whole host.
    last = host.rsplit(".", labels)
    last = last[1:] if len(last) > labels else last
    hosts = [".".join(last[i:]) for i in range(len(last))]
    starts = [path[:n] for n in lengths if n <= len(path)]
    found = [h + (p if p.startswith("/") else "\x00" + p) for h in hosts for p in starts]
    return sorted(found, key=len, reverse=True)


def _told(hits: DataFrame, listed: DataFrame) -> DataFrame:
    """Look-ups that hit the list. Rules that very many look-ups hit are sent to where these are, the others joined by shuffle.

    A look-up that hits nothing is dropped. There are at most as many hot keys as look-ups over ``HOT``; the
    commonest ``SENT`` of them are sent.
    """
    hot = written(hits.groupBy("key").count().where(F.col("count") > HOT).orderBy(F.desc("count"), "key").limit(SENT).select("key"), "hot")
    if hot.isEmpty():
        return hits.join(listed, "key")
    rules = F.broadcast(hot.join(listed, "key", "left"))
    marked = hits.join(rules, "key").where(F.col("rule").isNotNull())
    return marked.unionByName(hits.join(F.broadcast(hot), "key", "left_anti").join(listed, "key"))


def judged(pages: DataFrame, rules: DataFrame, *, url: str = "url") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``."""
    spark = pages.sparkSession
    listed = rules.select(canonical(F.col("host"), F.col("path")).alias("key"), F.concat("host", "path").alias("rule"), F.char_length("path").alias("n"), "verdict")
    listed = listed.groupBy("key").agg(F.max_by(F.struct("rule", "verdict"), F.col("verdict") == "block").alias("r"), F.first("n").alias("n")).select("key", "r.rule", "r.verdict", "n")
    # One number for each length that listed paths have, none beyond the longest path.
    lengths = sorted((r[0] for r in listed.select("n").distinct().collect()), reverse=True)
    labels = rules.agg(F.coalesce(F.max(F.regexp_count(F.coalesce("host", F.lit("")), F.lit("[.]"))), F.lit(0)) + 1).first()[0]
    lines = spark.sparkContext.broadcast(bloom(listed))
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    inner = [f"c{i}" for i in range(len(names))]
    rows = pages.select(*[F.col(c).alias(x) for c, x in zip(names, inner)])
    said = F.col(inner[names.index(url)])
    rows = rows.withColumn("host", host_of(said)).withColumn("path", path_of(said))

    def passed(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            of = [lookups(h, p, lengths, labels) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            hit = may_hold(lines.value, [k.encode() for keys in of for k in keys])
            at, hits = 0, []
            for keys in of:
                hits.append([k for k, there in zip(keys, hit[at : at + len(keys)]) if there])
                at += len(keys)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, pa.list_(pa.string()))], [*batch.schema.names, "keys"])

    schema = T.StructType([*rows.schema.fields, T.StructField("keys", T.ArrayType(T.StringType()))])
    path_ = new_folder(spark, "pages")
    batches(rows, 2048).mapInArrow(passed, schema).withColumn("row", F.monotonically_increasing_id()).write.parquet(path_)
    marked = spark.read.schema(T.StructType([*schema.fields, T.StructField("row", T.LongType())])).parquet(path_)
    hits = marked.where(F.size("keys") > 0).select("row", F.posexplode("keys").alias("place", "key"))
    best = _told(hits, listed.select("key", "rule", "verdict")).groupBy("row").agg(F.min_by(F.struct("rule", "verdict"), F.struct(-F.char_length("rule"), F.col("place"))).alias("r"))
    ruled = marked.where(F.size("keys") > 0).join(best, "row", "left").withColumn("rule", F.col("r.rule")).withColumn("verdict", F.coalesce("r.verdict", F.lit("allow"))).drop("r")
    rest = marked.where(F.size("keys") == 0).withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit("allow"))
    out = ruled.unionByName(rest)
    return out.select(*[F.col(x).alias(c) for x, c in zip(inner, names)], "host", "path", "rule", "verdict")
