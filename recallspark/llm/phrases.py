"""Collocations: phrases of two to four words that occur far more often than their parts let expect.

Texts are cut into pieces at punctuation, pieces into words. Each task puts the words of its texts, by
language, into shards of about ``SHARD`` words, numbered in byte order. A shard's count trie is grown one
level at a time: nodes of depth d are the phrases of d words with their counts. It is serialised in the order
of its paths, and all shards' levels are merged by ranges of paths: each range is one task's, which reads its
sorted rows and adds up equal paths as they go by. Depth is limited by ``longest``.

Most paths are too rare to be kept, and paths are long. So before a level is serialised, counts are added up
over 40-bit hashes of paths: a hash of fewer than ``least`` occurrences has no path of more. Filters of bounded
size tell which hashes are left; they let some others pass, which the exact counts then drop, and lose none.
The next level grows only where the path without its last word and that without its first word both pass.

Walking down from the root gives a node the counts of its left parts: its own and those of its parent. Suffix
links, from a path to the path without its first word, give the counts of its right parts in the same way.
Both are joins of a level with the level above it. Every cut of a phrase is scored by
``floor(2000000 a / (l + r))`` in decimals of 38 digits.

Rules for odd input: a null text is empty, a null language is ``und``. Very long texts are read whole, over
several shards if need be (a phrase that crosses from one shard to the next is counted by the first). Repeated
rows count repeatedly. A-Z alone are lower-cased. An empty table, or one without a frequent phrase, gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallspark.llm.rows import batches, freed
from recallspark.session import dropped, written

#: Words that a task holds at most before it makes the fullest language's a shard.
SHARD = 1 << 19

#: How shards, rows of megabytes, are written: pages of one row and row groups of few, else Parquet looks at their
#: size after a hundred rows only, and a reader holds all of a file's rows at once.
AS_WRITTEN = {"compression": "zstd", "parquet.page.row.count.limit": "1", "parquet.page.size.row.check.min": "1", "parquet.block.size": str(8 << 20)}

#: Rows of short columns that one Arrow batch holds; of shards it holds one.
SHORT_ROWS = 1 << 14

#: Bits of a path's hash that are dropped before hashes are moved; 40 are left.
DROPPED_BITS = np.uint64(24)

#: Words of 64 bits of a filter at most: 64 MB is sent, however many paths are kept.
MOST_WORDS = 1 << 23

_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9)


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of each piece. Blanks and tabs alone part words: the other blanks end pieces."""
    for piece in text.translate(_FOLD).split(b"\n"):
        if words := piece.split():
            yield words


def _shards(docs: DataFrame, lang: str, text: str, depth: int) -> DataFrame:
    """``lang, words, hashes, ids, own, n``: words in byte order, the texts as their numbers with -1 after each piece.

    Words are joined by blanks, hashes and numbers are 64 and 32 bits each, so that a row is a few strings of bytes.
    Phrases that begin at one of the first ``own`` places, of which ``n`` are words, are the shard's; the
    places after them are the beginning of the next shard of the same piece.
    """

    def shard(lang: str, words: defaultdict[bytes, int], ids: list[int], own: int) -> pa.RecordBatch:
        words.default_factory = None  # else it holds itself, and waits for the collector of cycles
        known = sorted(words)
        rank = np.empty(len(known) + 1, np.int32)
        rank[[words[w] for w in known]] = np.arange(len(known), dtype=np.int32)
        rank[-1] = -1  # what -1 picks
        seed = xxhash.xxh3_64_intdigest(lang)
        hashes = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in known], np.uint64)
        numbers = rank[np.array(ids, np.int64)]
        binary = [pa.array([x], pa.binary()) for x in (b" ".join(known), hashes.tobytes(), numbers.tobytes())]
        counts = [pa.array([x], pa.int64()) for x in (own, int((numbers[:own] >= 0).sum()))]
        return pa.RecordBatch.from_arrays([pa.array([lang]), *binary, *counts], ["lang", "words", "hashes", "ids", "own", "n"])

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[dict[bytes, int], list[int]]] = {}
        total = 0

        def of(lang: str) -> tuple[dict[bytes, int], list[int]]:
            if lang not in held:
                number: dict[bytes, int] = defaultdict()
                number.default_factory = number.__len__
                held[lang] = number, []
            return held[lang]

        for batch in found:
            for lang, data in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary())):
                for words in pieces(data.as_py() or b""):
                    for a in range(0, len(words), SHARD):
                        number, ids = of(lang)
                        part, begin, last = words[a : a + SHARD + depth - 1], len(ids), a + SHARD >= len(words)
                        ids.extend(map(number.__getitem__, part))
                        ids.append(-1)
                        total += len(ids) - begin
                        if last and total < SHARD:
                            continue
                        full = max(held, key=lambda x: len(held[x][1])) if last else lang
                        number, ids = held.pop(full)
                        total -= len(ids)
                        yield shard(full, number, ids, len(ids) if last else begin + SHARD)
        for one, (number, ids) in held.items():
            yield shard(one, number, ids, len(ids))

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    return batches(rows).mapInArrow(run, "lang string, words binary, hashes binary, ids binary, own long, n long")


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _joined(hashes: list[np.ndarray]) -> np.ndarray:
    """Hashes of 40 bits of paths from the hashes of their words, each an array of one place."""
    out = np.zeros_like(hashes[0])
    for h in hashes:
        out = (out ^ h) * _MIX
        out ^= out >> np.uint64(29)
    return out >> DROPPED_BITS


def _places(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The filter's word of each path, and the four bits set in it."""
    mixed, bits = hashes * _MIX, np.zeros_like(hashes)
    for i in range(4):
        bits |= np.uint64(1) << ((hashes >> np.uint64(6 * i)) & np.uint64(63))
    return ((mixed >> np.uint64(32)) % np.uint64(words)).astype(np.int64), bits


def _passing(lines: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    word, bits = _places(hashes, len(lines))
    return (lines[word] & bits) == bits


def _filter(kept: DataFrame) -> np.ndarray:
    """A Bloom filter of the numbers in ``hash``: a word of 64 bits for each of them up to ``MOST_WORDS``, bits of one word each."""
    words = min(MOST_WORDS, max(1, kept.count()))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            at, bits = _places(batch.column("hash").to_numpy().view(np.uint64), words)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits.view(np.int64))], ["at", "bits"])

    made = batches(kept.select("hash"), SHORT_ROWS).mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    lines = np.zeros(words, np.uint64)
    lines[made.column("at").to_numpy()] = made.column("bits").to_numpy().view(np.uint64)
    return lines


def _begins(ids: np.ndarray, own: int, depth: int) -> np.ndarray:
    """Where the shard's paths of one depth begin."""
    n = max(0, min(own, len(ids) - depth + 1))
    there = np.ones(n, bool)
    for i in range(depth):
        there &= ids[i : i + n] >= 0
    return np.flatnonzero(there)


def hashes_of(ids: np.ndarray, own: int, hashes: np.ndarray, depth: int, above: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shard's nodes of one depth and their counts; ``above`` tells which paths of one word less may be kept."""
    at = _begins(ids, own, depth)
    if above is not None:
        for skip in (0, 1):
            at = at[_passing(above, _joined([hashes[ids[at + i]] for i in range(skip, depth - 1 + skip)]))]
    return np.unique(_joined([hashes[ids[at + i]] for i in range(depth)]), return_counts=True)


def level_of(ids: np.ndarray, own: int, hashes: np.ndarray, depth: int, lines: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Those nodes of one depth that pass, in order: the numbers of their words, each place by itself, and their counts."""
    at = _begins(ids, own, depth)
    at = at[_passing(lines, _joined([hashes[ids[at + i]] for i in range(depth)]))]
    columns = [ids[at + i].astype(np.int64) for i in range(depth)]
    key = columns[0]
    for more in columns[1:]:
        _, key = np.unique(key, return_inverse=True)
        key = key * (int(ids.max(initial=0)) + 1) + more
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    return [c[first] for c in columns], counts


def _each(shards: DataFrame, columns: list[str], schema: str, made: Callable[..., Iterator[pa.RecordBatch]]) -> DataFrame:
    """What ``made`` gives for the columns of each shard, which are sent one by one."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for at in range(batch.num_rows):
                yield from made(*(batch.column(c)[at].as_py() for c in columns))

    return batches(shards.select(*columns), 1).mapInArrow(run, schema)


def _hashed(shards: DataFrame, depth: int, above: np.ndarray | None) -> DataFrame:
    """``hash, f``: hashes of the shards' nodes of one depth."""
    sent = None if above is None else shards.sparkSession.sparkContext.broadcast(above)

    def made(hashes: bytes, ids: bytes, own: int) -> Iterator[pa.RecordBatch]:
        found, counts = hashes_of(np.frombuffer(ids, np.int32), own, np.frombuffer(hashes, np.uint64), depth, None if sent is None else sent.value)
        for a in range(0, len(found), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(found[a : a + (1 << 17)].view(np.int64)), pa.array(counts[a : a + (1 << 17)], pa.int64())], ["hash", "f"])

    return _each(shards, ["hashes", "ids", "own"], "hash long, f long", made)


def _level(shards: DataFrame, depth: int, lines: np.ndarray) -> DataFrame:
    """``lang, path, f``: the shards' nodes of one depth that pass, each shard's in order."""
    sent = shards.sparkSession.sparkContext.broadcast(lines)

    def made(lang: str, joined: bytes, hashes: bytes, ids: bytes, own: int) -> Iterator[pa.RecordBatch]:
        columns, counts = level_of(np.frombuffer(ids, np.int32), own, np.frombuffer(hashes, np.uint64), depth, sent.value)
        words = pa.array(joined.split(b" "), pa.binary()).cast(pa.string())
        for a in range(0, len(counts), 1 << 16):
            names = [words.take(pa.array(c[a : a + (1 << 16)])) for c in columns]
            path = names[0] if depth == 1 else pc.binary_join_element_wise(*names, " ")
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(path)), path, pa.array(counts[a : a + (1 << 16)], pa.int64())], ["lang", "path", "f"])

    return _each(shards, ["lang", "words", "hashes", "ids", "own"], "lang string, path string, f long", made)


def _merged(tries: DataFrame) -> DataFrame:
    """Nodes of all shards' tries, equal paths added up: sorted rows of a range of paths go by one after the other."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in found:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if not batch.num_rows:
                continue
            lang, path, f = (batch.column(c) for c in ("lang", "path", "f"))
            new = np.ones(len(path), bool)
            new[1:] = pc.or_(pc.not_equal(path[1:], path[:-1]), pc.not_equal(lang[1:], lang[:-1])).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(new)
            at = pa.array(first)
            out = pa.RecordBatch.from_arrays([lang.take(at), path.take(at), pa.array(np.add.reduceat(f.to_numpy(), first))], ["lang", "path", "f"])
            # The last path may go on in the next batch.
            held = out.slice(out.num_rows - 1)
            if out.num_rows > 1:
                yield out.slice(0, out.num_rows - 1)
        if held is not None:
            yield held

    return batches(tries, SHORT_ROWS).repartitionByRange("lang", "path").sortWithinPartitions("lang", "path").mapInArrow(run, "lang string, path string, f long")


def levels(docs: DataFrame, least: int, longest: int, *, lang: str = "lang", text: str = "text") -> tuple[list[DataFrame], DataFrame]:
    """Kept nodes by depth from 1 on (``lang, path, f, lefts, rights``), and ``lang, n``, all words of a language.

    ``lefts`` holds the counts of the path's beginnings, from the first word to the whole, ``rights`` those
    of its ends, from the last word to the whole.
    """
    spark = docs.sparkSession
    shards = written(_shards(docs, lang, text, longest), "shards", **AS_WRITTEN)
    found: list[DataFrame] = []
    lines = None
    for depth in range(1, longest + 1):
        some = written(_hashed(shards, depth, lines).groupBy("hash").agg(F.sum("f").alias("f")).where(F.col("f") >= least).select("hash"), "hashes")
        lines = _filter(some)
        tries = written(_level(shards, depth, lines), "tries")
        kept = _merged(tries).where(F.col("f") >= least)
        if depth == 1:
            kept = kept.withColumns({"lefts": F.array("f"), "rights": F.array("f")})
        else:
            above = found[-1]
            parent = F.expr("left(path, length(path) - length(substring_index(path, ' ', -1)) - 1)")
            link = F.expr("substring(path, length(substring_index(path, ' ', 1)) + 2)")
            kept = kept.withColumns({"parent": parent, "link": link}).join(above.select("lang", F.col("path").alias("parent"), "lefts"), ["lang", "parent"]).join(above.select("lang", F.col("path").alias("link"), "rights"), ["lang", "link"])
            kept = kept.select("lang", "path", "f", F.concat("lefts", F.array("f")).alias("lefts"), F.concat("rights", F.array("f")).alias("rights"))
        found.append(written(kept, "nodes"))
        dropped(spark, tries)
        dropped(spark, some)
    words = written(shards.groupBy("lang").agg(F.sum("n").alias("n")), "words")
    dropped(spark, shards)
    batches(docs)  # the usual batches again
    return found, words


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, first: int = 2000, *, covered: int = 80, lang: str = "lang", text: str = "text") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``first`` phrases of two to ``longest`` words.

    A phrase needs ``least`` occurrences. It is dropped for a longer one of as many, that holds it and has at
    least ``covered`` percent of its occurrences.
    """
    with freed(docs.sparkSession):
        found, words = levels(docs, least, longest, lang=lang, text=text)
    rows = None
    for depth, nodes in enumerate(found[1:], 2):
        rows = nodes.withColumn("m", F.lit(depth)) if rows is None else rows.unionByName(nodes.withColumn("m", F.lit(depth)))
    # Cut after k words: l is the k-th beginning, r the end of m - k words. A product may pass 64 bits.
    score = lambda k: F.expr(f"CAST(2000000 AS DECIMAL(20,0)) * CAST(f AS DECIMAL(18,0)) div (CAST(lefts[{k - 1}] AS DECIMAL(19,0)) + CAST(rights[m - {k} - 1] AS DECIMAL(19,0)))")
    cuts = F.array(*[F.when(F.col("m") > k, F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.expr(f"lefts[{k - 1}]").alias("l"), F.expr(f"rights[m - {k} - 1]").alias("r"))) for k in range(1, longest)])
    scored = rows.withColumn("cut", F.array_min(F.filter(cuts, lambda c: c.isNotNull()))).select("lang", "path", "m", F.col("f").alias("a"), "cut.*")
    # Of all longer phrases that hold a phrase, the most frequent one decides.
    inner = F.expr("flatten(transform(sequence(2, m - 1), s -> transform(sequence(1, m - s + 1), i -> array_join(slice(split(path, ' '), i, s), ' '))))")
    within = rows.where("m > 2").select("lang", F.explode(inner).alias("path"), "f").groupBy("lang", "path").agg(F.max("f").alias("most"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    stays = scored.join(within, ["lang", "path"], "left").where(F.col("most").isNull() | (wide("most") * 100 < wide("a") * covered))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "path")
    ranked = stays.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), F.col("path").alias("phrase"), "a", "l", "r", "n", "score")
