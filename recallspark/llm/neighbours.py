"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is turned by fast pseudo-rotations (random signs, then a Hadamard transform, three times)
and hashed to the signed axis it is nearest to. A table joins several such hashes, each with turns of its
own, to one bucket: as many whole ones as the number of rows asks for, and a last one over a few axes, so
that a bucket holds about ``ROWS_A_BUCKET`` rows however many there are. A query probes, in each of several
tables, the buckets to whose axes it is nearest in sum; the rows in these are its candidates. Probes grow as
the number of buckets to the power of 0.6, so the share of all rows that a query is compared with falls.

Rows and queries meet by table, part (a range of buckets) and slice. Parts of many rows or many queries are
sliced on both sides, so that no task holds more than a slice of either. What a query sends to its parts are
its number and its buckets there; its vector is not shuffled. The queries' vectors are broadcast, in rounds of
``BYTES_A_ROUND``, and meet the buckets where these have arrived. Meetings compare unit vectors of
single precision and keep what may be among a query's best; these are ranked by the exact cosine of the
original vectors, which are fetched by id. Of rows with the same vector only the few smallest ids can be
answers, and only they are indexed.

Rules for odd input: vectors that are null, empty, zero, or hold null or non-finite parts take no part, nor
do those of another length than the commonest (the longer of equally common ones, or ``dim`` where it is
given). Rows of equal id are one vector, at its best score; a query has no candidate of its own id, and ties
go to the smaller id. Rows whose id is null take no part. A query that finds too few in its buckets is
compared with all rows. Fewer rows give fewer answers, an empty table none. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallspark.llm.rows import batches
from recallspark.session import written

#: Rows of one bucket, about, and buckets of one part.
ROWS_A_BUCKET, SPAN = 16, 2048

#: Bytes of the vectors of one slice of a part's rows or queries, about, and of the queries of one round, at most about.
BYTES_A_SLICE, BYTES_A_ROUND = 8 << 20, 32 << 20

#: Sums of nearness that are held at once when probes are chosen.
SUMS = 1 << 20

#: Single precision may be off by so much in a cosine; what is that near to the k-th best is compared exactly.
MARGIN = 2e-5

#: Candidate pairs that a meeting holds before it keeps the best of each query.
PAIRS = 1 << 20

#: Small tables up to this many rows are sent to every task, larger ones are joined by shuffle.
SENT = 200_000

SEED, ROUNDS = 11, 3


def turns(dim: int, hashes: int, table: int) -> np.ndarray:
    """Signs by hash and round of one table, for vectors filled up to a power of two."""
    wide = 1 << max(1, (dim - 1).bit_length())
    return np.random.default_rng([SEED, table]).choice([-1.0, 1.0], size=(hashes, ROUNDS, wide))


def widths(dim: int, rows: int) -> list[int]:
    """Axes of each hash of a table: whole ones, then one of as many as the number of rows still asks for."""
    wide = 1 << max(1, (dim - 1).bit_length())
    found, left = [wide], rows / ROWS_A_BUCKET / (2 * wide)
    while left > 1:
        found.append(min(wide, 1 << max(0, int(np.ceil(np.log2(left / 2))))))
        left /= 2 * found[-1]
    return found


def buckets_of(axes: list[int]) -> int:
    return int(np.prod([2 * w for w in axes], dtype=np.int64))


def probes_for(buckets: int) -> int:
    """How many buckets of a table a query probes."""
    return min(buckets, int(np.ceil(0.4 * buckets**0.6)))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows."""
    rows, wide = x.shape
    size = 1
    while size < wide:
        pairs = x.reshape(rows, wide // (2 * size), 2, size)
        x = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(rows, wide)
        size *= 2
    return x / np.sqrt(wide)


def turned(vectors: np.ndarray, signs: np.ndarray) -> np.ndarray:
    x = np.zeros((len(vectors), signs.shape[1]))
    x[:, : vectors.shape[1]] = vectors
    for by in signs:
        x = hadamard(x * by)
    return x


def usable(vector: Column) -> Column:
    """The vector in doubles, or null if it can take no part."""
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.when(fine, v)


def signed_axes(x: np.ndarray, width: int) -> np.ndarray:
    """Nearness of each row to the signed axes: the first ``width`` ones, then their opposites."""
    return np.hstack([x[:, :width], -x[:, :width]])


def own_bucket(x: np.ndarray, axes: list[int], signs: np.ndarray) -> np.ndarray:
    """Each row's bucket: the nearest signed axis of each hash."""
    found = np.zeros(len(x), np.int64)
    for width, by in zip(axes, signs):
        found = found * (2 * width) + signed_axes(turned(x, by), width).argmax(axis=1)
    return found


def pairs_within(count: int, first: int, second: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in two descending lists of so many numbers whose sums may be among the ``count`` largest.

    The sum at (i, j) has (i + 1) * (j + 1) - 1 others that are not below it, so pairs with more than that drop out.
    """
    reach = np.minimum(second, count // np.arange(1, min(first, count) + 1))
    one = np.repeat(np.arange(len(reach)), reach)
    return one, np.arange(len(one)) - np.repeat(np.cumsum(reach) - reach, reach)


def probed(x: np.ndarray, axes: list[int], signs: np.ndarray, probes: int) -> np.ndarray:
    """The buckets of largest summed nearness, for each row, ``probes`` of them or all.

    Hash by hash, the best sums so far are paired with the best axes of the next. Rows are taken so many at a
    time that at most about ``SUMS`` sums are held.
    """
    known, plans = 1, []
    for width in axes:
        plans.append(pairs_within(probes, known, 2 * width))
        known = min(probes, len(plans[-1][0]))
    step = max(1, SUMS // max(len(one) for one, _ in plans))
    return np.concatenate([_probed(x[at : at + step], axes, signs, probes, plans) for at in range(0, max(1, len(x)), step)])


def _probed(x: np.ndarray, axes: list[int], signs: np.ndarray, probes: int, plans: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    found, total = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for width, by, (one, other) in zip(axes, signs, plans):
        near = signed_axes(turned(x, by), width)
        best = np.argsort(-near, axis=1, kind="stable")
        sums = total[:, one] + np.take_along_axis(near, best, 1)[:, other]
        order = np.argsort(-sums, axis=1, kind="stable")[:, :probes]
        total = np.take_along_axis(sums, order, 1)
        found = np.take_along_axis(found, one[order], 1) * (2 * width) + np.take_along_axis(best, other[order], 1)
    return found


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _vectors(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return unit(batch.column("vec").flatten().to_numpy().reshape(batch.num_rows, dim))


def _singles(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.astype(np.float32).ravel()))


def _flat(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("unit").flatten().to_numpy().reshape(batch.num_rows, -1)


def _indexed(rows: DataFrame, dim: int, axes: list[int], tables: int) -> DataFrame:
    """``id, unit, buckets``: the bucket of each table."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = [turns(dim, len(axes), t) for t in range(tables)]
        for batch in found:
            if batch.num_rows:
                x = _vectors(batch, dim)
                codes = np.stack([own_bucket(x, axes, s) for s in signs], axis=1)
                listed = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, tables, dtype=np.int32), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), _singles(x), listed], ["id", "unit", "buckets"])

    return batches(rows.select("id", "vec"), 2048).mapInArrow(run, "id long, unit array<float>, buckets array<long>")


def _units(queries: DataFrame, dim: int) -> DataFrame:
    """``q, id, unit``: each query with a number of its own, as ids may repeat."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("id"), _singles(_vectors(batch, dim))], ["q", "id", "unit"])

    once = queries.select("id", "vec").distinct().withColumn("q", F.monotonically_increasing_id())
    return batches(once, 2048).mapInArrow(run, "q long, id long, unit array<float>")


def _asked(units: DataFrame, dim: int, axes: list[int], tables: int, probes: int) -> DataFrame:
    """``table, part, q, probes``: a query's number once for each part it probes, with its buckets there.

    Without any probes a query asks all parts of table 0; its list of buckets is empty, which means all.
    """
    parts = -(-buckets_of(axes) // SPAN)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = [turns(dim, len(axes), t) for t in range(tables)]
        for batch in found:
            if not batch.num_rows:
                continue
            x, numbers = _flat(batch).astype(np.float64), batch.column("q").to_numpy()
            for table in range(tables):
                if probes:
                    codes = np.sort(probed(x, axes, signs[table], probes), axis=1)
                    part = codes // SPAN
                    starts = np.flatnonzero(np.c_[np.ones(len(x), bool), part[:, 1:] != part[:, :-1]].ravel())
                    row, part = starts // codes.shape[1], part.ravel()[starts]
                    listed = pa.ListArray.from_arrays(np.r_[starts, codes.size].astype(np.int32), pa.array(codes.ravel()))
                else:
                    row, part = np.repeat(np.arange(len(x)), parts), np.tile(np.arange(parts), len(x))
                    listed = pa.ListArray.from_arrays(np.zeros(len(row) + 1, np.int32), pa.array([], pa.int64()))
                columns = [pa.array(np.full(len(row), table, np.int32)), pa.array(part.astype(np.int64)), pa.array(numbers[row]), listed]
                yield pa.RecordBatch.from_arrays(columns, ["table", "part", "q", "probes"])

    return batches(units.select("q", "unit"), 256).mapInArrow(run, "table int, part long, q long, probes array<long>")


def best_pairs(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the pairs that may be among a query's k best ids: those not below its k-th by more than the margin."""
    if not len(query):
        return np.zeros(0, np.int64)
    order = np.lexsort((-score, ids, query))
    first = np.r_[True, (query[order][1:] != query[order][:-1]) | (ids[order][1:] != ids[order][:-1])]
    order = order[first]
    order = order[np.lexsort((ids[order], -score[order], query[order]))]
    starts = np.flatnonzero(np.r_[True, query[order][1:] != query[order][:-1]])
    sizes = np.diff(np.r_[starts, len(order)])
    bound = np.where(sizes >= k, score[order[np.minimum(starts + k - 1, len(order) - 1)]] - MARGIN, -np.inf)
    return order[score[order] >= np.repeat(bound, sizes)]


def meeting(rows: np.ndarray, ids: np.ndarray, buckets: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, probes: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, ids and rough scores of what may be among the best, bucket by bucket.

    ``probes`` are the queries' lists of buckets one after another, ``sizes`` says how long each is.
    """
    order = np.argsort(buckets, kind="stable")
    codes, starts = np.unique(buckets[order], return_index=True)
    stops = np.r_[starts[1:], len(order)]
    all_of = np.flatnonzero(sizes == 0)
    flat = np.r_[probes, np.tile(codes, len(all_of))]
    who = np.r_[np.repeat(np.arange(len(sizes)), sizes), np.repeat(all_of, len(codes))]
    by_code = np.argsort(flat, kind="stable")
    flat, who = flat[by_code], who[by_code]
    lows, highs = np.searchsorted(flat, codes), np.searchsorted(flat, codes, side="right")
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    count = 0

    def pruned() -> None:
        query, at, score = (np.concatenate(x) for x in zip(*held))
        keep = best_pairs(query, ids[at], score, k)
        held[:] = [(query[keep], at[keep], score[keep])]

    for low, high, a, b in zip(lows, highs, starts, stops):
        own = order[a:b]
        step = max(1, PAIRS // len(own))
        for lo in range(low, high, step):
            asking = who[lo : min(high, lo + step)]
            score = queries[asking] @ rows[own].T
            query, at = np.repeat(asking, len(own)), np.tile(own, len(asking))
            other = query_ids[query] != ids[at]
            held.append((query[other], at[other], score.ravel()[other]))
            count += len(query)
            if count > PAIRS:
                pruned()
                count = 0
    if not held:
        return query_ids[:0], ids[:0], np.zeros(0)
    pruned()
    query, at, score = held[0]
    return query_ids[query], ids[at], score.astype(np.float64)


def _found(index: DataFrame, asked: DataFrame, units: DataFrame, dim: int, k: int) -> DataFrame:
    """``query_id, vec_id, rough``: what each meeting keeps. ``units`` are one round's queries, which are broadcast."""
    keys = ["table", "part"]
    most = max(256, BYTES_A_SLICE // (4 * dim))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    pieces = lambda df, n: df.groupBy(*keys).agg(F.ceil(F.count("*") / most).cast("int").alias(n))
    # A row a table and part: of SPAN buckets each, so about one for each 32768 rows of the index and table.
    plan = written(pieces(index, "slices").join(pieces(asked, "turns"), keys), "meetings")
    side = F.broadcast(plan) if plan.count() <= SENT else plan
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(side, keys).withColumn("slice", place("id", "slices")).withColumn("turn", every("turns"))
    right = asked.join(side, keys).withColumn("turn", place("q", "turns")).withColumn("slice", every("slices"))
    keys = [*keys, "slice", "turn"]
    # Vectors join behind the shuffle, which the groups below use as it is.
    right = right.select(*keys, "q", "probes").repartition(*keys).join(F.broadcast(units), "q")

    def meet(one: pa.Table, other: pa.Table) -> pa.Table:
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if one.num_rows and other.num_rows:
            asked = other.column("probes").combine_chunks()
            flat = lambda t: t.column("unit").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
            found = meeting(flat(one), one.column("id").to_numpy(), one.column("bucket").to_numpy(), flat(other), other.column("id").to_numpy(), asked.flatten().to_numpy(), asked.value_lengths().to_numpy(), k)
        return pa.table(dict(zip(("query_id", "vec_id", "rough"), map(pa.array, found))))

    return left.select(*keys, "id", "unit", "bucket").groupBy(*keys).cogroup(right.select(*keys, "id", "unit", "probes").groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, rough double")


def cosine(a: Column, b: Column) -> Column:
    """Exact cosine; both are scaled by a power of two first, which changes no digit and keeps sums of squares finite and above zero."""
    largest = lambda v: F.array_max(F.transform(v, F.abs))
    # As an array beside the vector, the power is worked out once, not for each component.
    scaled = lambda v: F.zip_with(v, F.array_repeat(F.pow(F.lit(2.0), F.floor(F.log2(largest(v)))), F.size(v)), lambda x, p: x / p)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return dot(scaled(a), scaled(b)) / (F.sqrt(dot(scaled(a), scaled(a))) * F.sqrt(dot(scaled(b), scaled(b))))


def _uncrowded(rows: DataFrame, k: int) -> DataFrame:
    """Rows without those that k + 1 smaller ids with the very same vector go before: these can be no answer."""
    keys = [F.xxhash64("vec").alias("h"), F.hash("vec").alias("g")]
    order = Window.partitionBy("h", "g").orderBy("id")
    first = rows.select(*keys, "id").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 2)
    crowded = written(first.groupBy("h", "g").agg(F.count("*").alias("n"), F.max(F.when(F.col("n") == k + 1, F.col("id"))).alias("last")).where(F.col("n") > k + 1).drop("n"), "crowded")
    many = crowded.count()
    if not many:
        return rows
    side = F.broadcast(crowded) if many <= SENT else crowded
    return rows.withColumns({"h": keys[0], "g": keys[1]}).join(side, ["h", "g"], "left").where("last is null or id <= last").select("id", "vec")


def search(rows: DataFrame, queries: DataFrame, k: int = 5, *, tables: int = 12, dim: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best found of ``rows`` for each of ``queries``."""
    clean = lambda df: df.select(F.col(id_col).cast("long").alias("id"), usable(F.col(vector_col)).alias("vec")).where("id is not null and vec is not null")
    lengths = clean(rows).groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"))
    if dim is not None:
        lengths = lengths.where(F.col("dim") == dim)
    chosen = lengths.orderBy(F.desc("n"), F.desc("dim")).first()
    if chosen is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = chosen
    kept, asked = clean(rows).where(F.size("vec") == dim), clean(queries).where(F.size("vec") == dim)
    axes = widths(dim, n)
    index = written(_indexed(_uncrowded(kept, k), dim, axes, tables), "buckets").select("id", "unit", F.posexplode("buckets").alias("table", "bucket"))
    index = index.withColumn("part", F.floor(F.col("bucket") / SPAN))

    def near(units: DataFrame, only: DataFrame, tables: int, probes: int) -> DataFrame:
        """The k best of those found, by their exact scores."""
        probing = written(_asked(units, dim, axes, tables, probes), "probes")
        rough = _found(only, probing, units, dim, k).groupBy("query_id", "vec_id").agg(F.max("rough").alias("rough"))
        by = Window.partitionBy("query_id").orderBy(F.desc("rough"), "vec_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        close = rough.withColumn("bound", F.nth_value("rough", k).over(by)).where(F.col("bound").isNull() | (F.col("rough") >= F.col("bound") - MARGIN))
        pairs = close.join(kept.select(F.col("id").alias("vec_id"), "vec"), "vec_id").join(asked.select(F.col("id").alias("query_id"), F.col("vec").alias("own")), "query_id")
        once = pairs.select("query_id", "vec_id", cosine(F.col("own"), F.col("vec")).alias("score")).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def in_rounds(units: DataFrame, *how) -> DataFrame:
        """``near`` of all queries, so many at a time that their vectors can be sent to every executor."""
        rounds = -(-units.count() * 4 * dim // BYTES_A_ROUND)
        if rounds <= 1:
            return written(near(units, *how), "nearest")
        number = F.pmod(F.xxhash64("q"), F.lit(rounds))
        parts = [written(near(units.where(number == at), *how), "nearest") for at in range(rounds)]
        # Vectors of one id may be in several rounds; each gave its best, and the best of these count.
        once = reduce(DataFrame.unionByName, parts).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return written(once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "nearest")

    units = written(_units(asked, dim), "queries")
    first = in_rounds(units, index, tables, probes_for(buckets_of(axes)))
    enough = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = written(units.join(enough, "id", "left_anti"), "short")
    if not short.isEmpty():
        more = in_rounds(short, index.where(F.col("table") == 0), 1, 0)
        first = first.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(more.select(*first.columns))
    return first.select("query_id", "rank", "vec_id", "score")
