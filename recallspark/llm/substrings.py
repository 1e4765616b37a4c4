"""Passages that repeat across documents, by level-wise doubling of window lengths.

A level looks at windows of one length and counts, by a 96-bit hash, in how many documents each starts.
Windows that start in one document alone are dropped there; of the others, two that stand behind one another
make a window of twice the length, which the next level counts. A window so goes on only if both its halves
repeat. Levels go on until no candidate survives or the asked length is reached; lengths are halves of it,
rounded up, so the two halves of a window of odd length share a word. The hash of a window is made of the
hashes of its halves.

Before the first level, documents of equal word sequence are folded, as the later ones repeat the earliest
as a whole, and places are thinned without loss: of the shortest windows inside a window of the asked length
the one of least hash is its anchor, the same wherever the window stands, so a window can repeat only if its
anchor does. About one place in twenty is an anchor; the first level looks only at places inside windows
whose anchor repeats.

A level moves hashes and keys of rows (a hash of number and text), never texts. Counts are grouped sums with
map-side combination, and each row is told what to drop by a list made of these sums, so a passage that a
third of all documents share meets in no single task, and no list is longer than one text's windows, however
many rows have one number or none.

Rules for odd input: a null text has no words, nothing of it is removed and what is kept is the empty
text. Documents shorter than the window lose nothing. Rows of equal ``doc_id`` are one document to the
question where a window starts, and are otherwise cut each for itself. A null ``doc_id`` is smaller than
every other, so its rows lose nothing. An empty table gives an empty result. Columns of the input may have
any names; those named like an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallspark.llm.rows import batches, texts
from recallspark.session import dropped, packed, written

#: Words a process remembers the hashes of; a full table starts anew.
REMEMBERED = 400_000

#: Stands for a null doc_id, below all others.
LEAST = -(1 << 63)

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)

_known: dict[bytes, int] = {}


def words_of(text: str) -> list[bytes]:
    """Runs of characters other than the six ASCII spaces, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


def digest_of(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def word_hashes(words: list[bytes]) -> np.ndarray:
    found = list(map(_known.get, words))
    if None in found:
        for i, h in enumerate(found):
            if h is None:
                found[i] = h = xxhash.xxh3_64_intdigest(words[i])
                if len(_known) >= REMEMBERED:
                    _known.clear()
                _known[words[i]] = h
    return np.array(found, dtype=np.uint64)


def _stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of windows from those of their two parts; rows of one or two 64-bit lanes, each for itself."""
    return np.stack([_stirred(a * _B + _stirred(b + c)) for a, b, c in zip(left, right, (_A, _C))])


def window_hashes(singles: np.ndarray, length: int, lanes: int = 2) -> np.ndarray:
    """Lanes of hashes of all windows of so many words, by doubling along the bits of the length."""
    words = np.stack([singles, _stirred(singles ^ _C)]) if lanes == 2 else singles[None]
    level = words
    for bit in bin(length)[3:]:
        half = level
        size = len(singles) - half.shape[1] + 1
        level = joined(half[:, : max(0, half.shape[1] - size)], half[:, size:])
        if bit == "1":
            one = words[:, 2 * size :]
            n = min(level.shape[1], one.shape[1])
            level = joined(level[:, :n], one[:, :n])
    return level


def anchors(keys: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` keys the place of the least one, the last of equal ones."""
    if len(keys) < span:
        return np.zeros(0, dtype=np.int64)
    # Least of blocks of doubling length; two overlapping blocks make up the span.
    place, size = np.arange(len(keys)), 1
    better = lambda a, b: np.where(keys[b] <= keys[a], b, a)
    while 2 * size <= span:
        place = better(place[: len(place) - size], place[size:])
        size *= 2
    return better(place[: len(keys) - span + 1], place[span - size : span - size + len(keys) - span + 1])


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int64))


def _listed(rows: list, kind: pa.DataType) -> pa.Array:
    """Arrays as one list column."""
    offsets = np.cumsum([0, *(len(x) for x in rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0), kind))


def lengths(window: int, start: int) -> list[int]:
    """Lengths of the levels: the asked one and its halves, rounded up, down to the first of at most ``start`` words."""
    found = [window]
    while found[-1] > max(1, start):
        found.append(-(-found[-1] // 2))
    return found[::-1]


def doubled(at: np.ndarray, hashes: np.ndarray, old: int, new: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the longer windows both whose halves stand in ``at``, which is sorted."""
    other = np.searchsorted(at, at + (new - old))
    there = other < len(at)
    there[there] = at[other[there]] == at[there] + (new - old)
    return at[there], joined(hashes[:, there], hashes[:, other[there]])


def _first_level(docs: DataFrame, window: int, first: int) -> DataFrame:
    """``doc, key, digest, n_words`` and the anchors' hashes, one row a document."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            digests, sizes, hashes = [], [], []
            for text in texts(batch):
                words = words_of(text)
                digests.append(digest_of(words))
                sizes.append(len(words))
                keys = window_hashes(word_hashes(words), first, 1)[0] if len(words) >= window else np.zeros(0, np.uint64)
                hashes.append(np.unique(keys[anchors(keys, window - first + 1)]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("key"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), _listed(hashes, pa.int64())], ["doc", "key", "digest", "n_words", "hashes"])

    return docs.mapInArrow(run, "doc long, key long, digest binary, n_words int, hashes array<long>")


#: What a document carries from level to level: sorted places of windows and two lanes of their hashes.
STATE = "doc long, key long, digest binary, at array<int>, h array<long>, g array<long>"


def _states(rows: list[tuple[int, int, bytes, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    docs, keys, digests, places, hashes = zip(*rows) if rows else ((), (), (), (), ())
    columns = [pa.array(docs, pa.int64()), pa.array(keys, pa.int64()), pa.array(digests, pa.binary()), _listed([p.astype(np.int32) for p in places], pa.int32())]
    columns += [_listed([x[lane].astype(np.int64) for x in hashes], pa.int64()) for lane in (0, 1)]
    return pa.RecordBatch.from_arrays(columns, ["doc", "key", "digest", "at", "h", "g"])


def _placed(docs: DataFrame, window: int, first: int) -> DataFrame:
    """State of the first level, of ``docs`` (``doc, key, text, own, dead``) that stand for their words.

    ``dead`` are anchors that start in no other row.
    """

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            rows = []
            for doc, key, text, own, dead in zip(batch.column("doc").to_pylist(), batch.column("key").to_pylist(), texts(batch), batch.column("own").to_pylist(), batch.column("dead")):
                words = words_of(text)
                if len(words) < window or (digest := digest_of(words)) not in own:
                    continue
                hashes = window_hashes(word_hashes(words), first)
                alive = hashes[0][anchors(hashes[0], window - first + 1)].astype(np.int64)
                if dead.is_valid:
                    alive = ~np.isin(alive, dead.values.to_numpy())
                else:
                    alive = np.ones(len(alive), bool)
                inside = np.cumsum(np.r_[alive, np.zeros(window - first, bool)].astype(np.int64) - np.r_[np.zeros(window - first + 1, np.int64), alive[:-1]][: hashes.shape[1]]) > 0
                at = np.flatnonzero(inside)
                if len(at):
                    rows.append((doc, key, digest, at, hashes[:, at]))
            yield _states(rows)

    return docs.mapInArrow(run, STATE)


def _next_level(state: DataFrame, old: int, new: int) -> DataFrame:
    """State of the next level of ``state`` with ``dead``, the hashes that start in no other row."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            rows = []
            for doc, key, digest, at, h, g, dead in zip(*(batch.column(c).to_pylist() for c in ("doc", "key", "digest")), *(batch.column(c) for c in ("at", "h", "g", "dead"))):
                at, h, g = at.values.to_numpy(), h.values.to_numpy(), g.values.to_numpy()
                if dead.is_valid:
                    live = ~np.isin(h, dead.values.to_numpy())
                    at, h, g = at[live], h[live], g[live]
                at, hashes = doubled(at, np.stack([h, g]).astype(np.uint64), old, new)
                if len(at):
                    rows.append((doc, key, digest, at, hashes))
            yield _states(rows)

    return state.mapInArrow(run, STATE)


def _gone(state: DataFrame) -> DataFrame:
    """``key, digest, at``: places of windows of ``state`` that are not among ``keeps``, those that start nowhere before."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            rows, digests, places = [], [], []
            for key, digest, at, h, g, keeps in zip(batch.column("key").to_pylist(), batch.column("digest").to_pylist(), *(batch.column(c) for c in ("at", "h", "g", "keeps"))):
                at, pair = at.values.to_numpy(), np.stack([h.values.to_numpy(), g.values.to_numpy()])
                if keeps.is_valid:
                    fields = keeps.values
                    held = np.stack([fields.field("h").to_numpy(), fields.field("g").to_numpy()])
                    # Equal columns of both lanes get equal numbers.
                    _, number = np.unique(np.hstack([pair, held]), axis=1, return_inverse=True)
                    number = number.ravel()
                    at = at[~np.isin(number[: len(at)], number[len(at) :])]
                if len(at):
                    rows.append(key)
                    digests.append(digest)
                    places.append(at.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(digests, pa.binary()), _listed(places, pa.int32())], ["key", "digest", "at"])

    return state.mapInArrow(run, "key long, digest binary, at array<int>")


def _keeps(state: DataFrame, stood: DataFrame) -> DataFrame:
    """``key, keeps``: the windows of each row that start in no document of smaller number.

    A window is told to the least row that has it. Other texts of the same number are told by a join, which
    needs only those numbers that have several texts.
    """
    windows = lambda rows: rows.select("doc", "key", F.explode(F.arrays_zip("h", "g")).alias("x")).select("doc", "key", "x.h", "x.g")
    first = windows(state).groupBy("h", "g").agg(F.min(F.struct("doc", "key")).alias("f")).select("f.doc", "f.key", "h", "g")
    crowded = written(packed(stood.where(F.col("doc") > LEAST).groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc")), "crowded")
    if not crowded.isEmpty():
        first = written(first, "first")
        others = windows(state.join(crowded, "doc", "left_semi")).join(first.select("doc", "h", "g"), ["doc", "h", "g"])
        first = first.unionByName(others).distinct()
    return first.where(F.col("doc") > LEAST).groupBy("key").agg(F.collect_list(F.struct("h", "g")).alias("keeps"))


def repeated_windows(rows: DataFrame, long: DataFrame, stood: DataFrame, window: int, start: int) -> DataFrame:
    """``key, digest, at``: where windows start that also start in a document of smaller number.

    ``rows``: doc, key, text. ``long``: key, digest, hashes of anchors. ``stood``: doc, key, digest and
    number of anchors of the rows that stand for their words.
    """
    spark, levels = rows.sparkSession, lengths(window, start)
    own = stood.groupBy("key").agg(F.collect_list("digest").alias("own"), F.sum("anchors").alias("anchors"))
    alone = lambda df, h: df.groupBy(h).agg(F.min("key").alias("key"), F.max("key").alias("high")).where("key = high").groupBy("key").agg(F.collect_list(h).alias("dead"))
    dead = alone(long.join(stood, ["key", "digest"], "left_semi").select("key", F.explode("hashes").alias("a")), "a")
    # A text all of whose anchors start nowhere else has no candidate and is not read again.
    asked = own.join(dead, "key", "left").where(F.col("dead").isNull() | (F.size("dead") < F.col("anchors"))).drop("anchors")
    state = written(packed(_placed(batches(rows.join(asked, "key")), window, levels[0])), "windows")
    for old, new in zip(levels, levels[1:]):
        if state.isEmpty():
            break
        dead = alone(state.select("key", F.explode(F.array_distinct("h")).alias("h")), "h")
        longer = written(packed(_next_level(batches(state.join(dead, "key", "left")), old, new)), "windows")
        dropped(spark, state)
        state = longer
    # Documents without a number are smaller than all others and lose nothing: they need not be told.
    return _gone(batches(state.where(F.col("doc") > LEAST).join(_keeps(state, stood), "key", "left")))


def removed_words(docs: DataFrame, window: int = 50, *, start: int = 16) -> DataFrame:
    """``docs`` (``doc_id``, ``text`` and any others) with ``n_words, n_removed, kept``.

    ``kept`` is the words that stay, joined by one blank. A word goes if a window of ``window`` words over
    it also starts in a document of smaller ``doc_id``. The first level has at most ``start`` words.
    """
    added = ["n_words", "n_removed", "kept"]
    docs = docs.drop(*added)
    names = [c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]
    rows = docs.toDF(*names).withColumn("doc", F.coalesce(F.col(names[docs.columns.index("doc_id")]).cast("long"), F.lit(LEAST))).withColumn("key", F.xxhash64("doc", "text"))
    texts_ = rows.select("doc", "key", "text")
    first = written(packed(_first_level(batches(texts_), window, lengths(window, start)[0])), "anchors")
    long = first.where(F.col("n_words") >= window)
    # Documents that stand for their word sequence; the others repeat them from the first word to the last.
    least = long.groupBy("digest").agg(F.min("doc").alias("doc"))
    stood = written(packed(long.select("doc", "key", "digest", F.size("hashes").alias("anchors")).join(least, ["doc", "digest"]).distinct()), "own")
    gone = repeated_windows(texts_, long, stood, window, start).groupBy("key").agg(F.collect_set(F.struct("digest", "at")).alias("gone"))
    told = stood.groupBy("key").agg(F.collect_list("digest").alias("own")).join(gone, "key", "left")

    def cut(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            sizes, lost, stays = [], [], []
            for text, doc, own, gone in zip(texts(batch), batch.column("doc").to_pylist(), batch.column("own").to_pylist(), batch.column("gone")):
                words = words_of(text)
                n = 0
                if len(words) >= window and doc != LEAST:
                    digest = digest_of(words)
                    if digest not in (own or ()):
                        n, words_left = len(words), []
                    elif gone.is_valid:
                        at = next((x["at"].values.to_numpy() for x in gone if x["digest"].as_py() == digest), None)
                        if at is not None:
                            mask = np.zeros(len(words) + 1, dtype=np.int64)
                            mask[at] += 1
                            mask[at + window] -= 1
                            mask = np.cumsum(mask[:-1]) > 0
                            n, words_left = int(mask.sum()), [w for w, m in zip(words, mask.tolist()) if not m]
                sizes.append(len(words))
                lost.append(n)
                stays.append(b" ".join(words_left if n else words))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sizes, pa.int64()), pa.array(lost, pa.int64()), pa.array(stays, pa.binary()).cast(pa.string())], [*names, *added])

    schema = T.StructType([*(T.StructField(n, f.dataType, f.nullable) for n, f in zip(names, docs.schema.fields)), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return batches(rows).join(told, "key", "left").select(*names, "doc", "own", "gone").mapInArrow(cut, schema).toDF(*docs.columns, *added)


def without_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """``docs`` without the repeated words, with the columns of ``docs``.

    A text that loses nothing stays as it is; of others the kept words are joined by one blank, and
    ``n_chars``, where there is such a column, is counted anew. Rows without any word left stay, empty.
    """
    inner = {c: {"doc_id": "doc_id", "text": "text"}.get(c, f"c{i}") for i, c in enumerate(docs.columns)}
    found = removed_words(docs.toDF(*inner.values()), window)
    changed = F.col("n_removed") > 0
    now = {"text": F.when(changed, F.col("kept")).otherwise(F.col("text"))}
    if "n_chars" in inner:
        old = F.col(inner["n_chars"])
        now["n_chars"] = F.when(changed, F.char_length("kept")).otherwise(old).cast(docs.schema["n_chars"].dataType)
    return found.select(*[now.get(c, F.col(name)).alias(c) for c, name in inner.items()])
