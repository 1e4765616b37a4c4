"""Exact top-k by inner product over a bit-sliced index.

Components are quantised to whole numbers, ``floor(scale * x)``. The index holds blocks of up to ``BLOCK``
rows, each in order of ids; of every attribute (a place in the vectors) a block keeps the least value and,
for each bit above it, one bitmap over its rows. A query's score is a sum of the attributes' slices, each
shifted by a set bit of the query's own number (complemented where that is negative), and is added for all
rows of a block at once: bitmaps of equal weight are taken three at a time into a sum and a carry until one
of each weight is left. The best rows are then selected from the most significant slice downward: rows whose
bit is set go first, as long as they are no more than asked for. Once few rows are open, or all slices are
used up, the rows at the boundary are resolved exactly, by their scores and ids.

Every query meets every block once: groups of queries are sent, some at a time, to the tasks that read blocks.
A query's k best of each block are brought together, and the k best of these are the answer. So nothing is
missed, and a task holds a block and a group, whose sizes are bounded, however often a vector repeats.

Rules for odd input: vectors that are null or hold null or non-finite components, or a component of 2^43 and
more in size, take no part, nor do rows with a null id. The empty vector scores 0 against others like it. A
query meets vectors of its own length only. Every row counts by itself: of equal rows each is a candidate, and
a query is not its own, but a row equal to it is. Scores that do not fit a long are given as its limits. Fewer candidates give fewer
answers, an empty table none. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallspark.llm.rows import batches
from recallspark.session import written

#: Rows of a block of the index, and queries of a group, at most; small tables still make several blocks.
BLOCK, GROUP, BLOCKS = 16384, 4096, 16

#: Components of all rows of a block or group at most, and bytes of the groups that are sent at a time.
COMPONENTS, SENT = 1 << 21, 64 << 20

#: So many rows are open at most when they are resolved by their scores before all slices are used.
OPEN = 64

#: Scores beyond this size are given as this.
LIMIT = (1 << 63) - 1

#: Components of this size and more are not quantised exactly.
TOO_LARGE = float(1 << 43)


def quantised(vector: Column, scale: int = 256) -> Column:
    """Whole numbers of the components; null where the vector takes no part."""
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < TOO_LARGE, F.lit(False)))
    return F.when(fine, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


class Block:
    """Rows' bitmaps: ``bits`` slices of each attribute, above its least value; bit r of a bitmap is row r."""

    def __init__(self, low: np.ndarray, slices: np.ndarray, rows: int) -> None:
        self.low, self.rows, self.bits = low, rows, slices.shape[1]
        self.both = np.stack([slices, ~slices])
        full = np.full(slices.shape[2], ~np.uint64(0))
        if rows % 64:
            full[-1] = np.uint64((1 << (rows % 64)) - 1)
        self.all = full

    @staticmethod
    def sliced(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least value of each attribute, and the slices above it."""
        rows, dim = values.shape
        low = values.min(axis=0) if rows else np.zeros(dim, np.int64)
        above = (values - low).T
        bits = max(1, int(above.max(initial=0)).bit_length())
        room = -(-rows // 64) * 64
        out = np.zeros((dim, bits, room // 64), np.uint64)
        for b in range(bits):
            flags = np.zeros((dim, room), np.uint8)
            flags[:, :rows] = (above >> b) & 1
            out[:, b] = np.packbits(flags, axis=1, bitorder="little").view("<u8")
        return low, out

    def scores(self, query: np.ndarray) -> tuple[np.ndarray, int]:
        """Slices of every row's score, the least significant first, above a number that all rows share."""
        size, negative = np.abs(query), (query < 0).astype(np.int64)
        base = dot(query, self.low) - int(size[query < 0].sum()) * ((1 << self.bits) - 1)
        columns: list[list[np.ndarray]] = [[] for _ in range(int(size.max(initial=0)).bit_length() + self.bits)]
        for t in range(len(columns) - self.bits):
            at = np.flatnonzero((size >> t) & 1)
            if len(at):
                picked = self.both[negative[at], at]
                for b in range(self.bits):
                    columns[t + b].append(picked[:, b])
        return added(columns, self.all.shape[0]), base

    def best(self, query: np.ndarray, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Rows with the k highest scores but for row ``but``, ties to the earlier row, and these scores."""
        slices, base = self.scores(query)
        open_ = self.all.copy()
        if but >= 0:
            open_[but // 64] &= ~(np.uint64(1) << np.uint64(but % 64))
        sure = np.zeros_like(open_)
        n_sure, n_open, left = 0, count(open_), len(slices)
        while left and n_sure < k and n_sure + n_open > max(k, OPEN):
            left -= 1
            high = open_ & slices[left]
            n = count(high)
            if n_sure + n > k:
                open_, n_open = high, n
            else:
                sure |= high
                n_sure, open_ = n_sure + n, open_ & ~slices[left]
                n_open -= n
        at = members(open_)
        if not left:  # all slices are used up: open rows are equal, the first of them are the ones
            at = at[: k - n_sure]
        at = np.concatenate([members(sure), at if n_sure < k else at[:0]])
        bit = (slices[:, at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1)
        if len(slices) < 63 and abs(base) < 1 << 62:
            scores = (bit << np.arange(len(slices), dtype=np.uint64)[:, None]).sum(axis=0, dtype=np.uint64).astype(np.int64) + base
        else:
            exact = (base + sum(1 << int(w) for w in np.flatnonzero(b)) for b in bit.T)
            scores = np.array([max(-LIMIT, min(LIMIT, x)) for x in exact], np.int64)
        order = np.lexsort((at, -scores))[:k]
        return at[order], scores[order]


def dot(a: np.ndarray, b: np.ndarray) -> int:
    """The inner product, exactly."""
    if int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * len(a) < 1 << 62:
        return int((a * b).sum())
    return sum(x * y for x, y in zip(a.tolist(), b.tolist()))


def added(columns: list[list[np.ndarray]], words: int) -> np.ndarray:
    """The sum, as slices, of bitmaps given by weight: full adders over stacks of them, weight by weight."""
    out, carried, w = [], [], 0
    while w < len(columns) or carried:
        parts = carried + (columns[w] if w < len(columns) else [])
        stack = np.concatenate(parts) if parts else np.zeros((1, words), np.uint64)
        carried = []
        while len(stack) > 2:
            m = len(stack) // 3
            a, b, c = stack[:m], stack[m : 2 * m], stack[2 * m : 3 * m]
            either = a ^ b
            carried.append((a & b) | (either & c))
            stack = np.concatenate([either ^ c, stack[3 * m :]])
        if len(stack) == 2:
            carried.append(stack[:1] & stack[1:])
            stack = stack[:1] ^ stack[1:]
        out.append(stack[0])
        w += 1
    return np.array(out) if out else np.zeros((0, words), np.uint64)


def count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def members(bitmap: np.ndarray) -> np.ndarray:
    """Rows whose bit is set, in order."""
    words = np.flatnonzero(bitmap)
    bits = np.unpackbits(bitmap[words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    word, bit = np.nonzero(bits)
    return words[word] * 64 + bit


def _stacks(found: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``dim, uid, id, values`` of up to ``most`` rows at a time, of one length, in order of ids."""
    held: dict[int, list] = {}

    def stack(dim: int, rows: list) -> tuple:
        uid, id_, values = (np.concatenate(x) for x in zip(*rows))
        order = np.lexsort((uid, id_))
        return dim, uid[order], id_[order], values[order]

    for batch in found:
        uid, id_ = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("uid", "id"))
        sizes = np.diff(batch.column("q").offsets.to_numpy())
        flat, begins = batch.column("q").flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
        for dim in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == dim)
            values = flat[begins[at][:, None] + np.arange(dim)] if dim else np.zeros((len(at), 0), np.int64)
            for a in range(0, len(at), most):
                rows = held.setdefault(dim, [])
                rows.append((uid[at[a : a + most]], id_[at[a : a + most]], values[a : a + most]))
                if sum(len(x) for x, *_ in rows) >= most:
                    dim_, *made = stack(dim, held.pop(dim))
                    for b in range(0, len(made[0]), most):
                        yield dim_, *(x[b : b + most] for x in made)
    for dim, rows in held.items():
        yield stack(dim, rows)


def fitting(rows: int, parts: int, most: int, dim: int) -> int:
    """Rows of a part: so that there are ``parts`` of them, between 1024 and ``most``, fewer if vectors are long."""
    return max(1, min(max(1024, -(-rows // parts)), most, COMPONENTS // max(1, dim)))


def _blocks(rows: DataFrame, most: int) -> DataFrame:
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, uid, id_, values in _stacks(found, most):
            low, slices = Block.sliced(values)
            columns = [pa.array([x]) for x in (dim, len(uid), uid.tobytes(), id_.tobytes(), low.tobytes(), slices.tobytes())]
            yield pa.RecordBatch.from_arrays(columns, ["dim", "n", "uids", "ids", "low", "slices"])

    return rows.mapInArrow(run, "dim long, n long, uids binary, ids binary, low binary, slices binary")


def _groups(queries: DataFrame, most: int) -> DataFrame:
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, uid, id_, values in _stacks(found, most):
            columns = [pa.array([x]) for x in (dim, uid.tobytes(), id_.tobytes(), np.ascontiguousarray(values).tobytes())]
            yield pa.RecordBatch.from_arrays(columns, ["dim", "asked_uids", "asked_ids", "asked"])

    return queries.mapInArrow(run, "dim long, asked_uids binary, asked_ids binary, asked binary")


def _met(pairs: DataFrame, k: int) -> DataFrame:
    """``asked_uid, query_id, vec_id, score``: the k best of a block for each query of a group."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
                dim, n = row["dim"], row["n"]
                longs = lambda name: np.frombuffer(row[name], np.int64)  # noqa: B023, E731
                uids, ids, asked_uids, asked_ids = map(longs, ("uids", "ids", "asked_uids", "asked_ids"))
                words = -(-n // 64)
                block = Block(longs("low"), np.frombuffer(row["slices"], np.uint64).reshape(dim, -1 if dim else 1, words), n)
                place = {u: i for i, u in enumerate(uids.tolist())}
                out = []
                for uid, id_, query in zip(asked_uids.tolist(), asked_ids.tolist(), longs("asked").reshape(len(asked_uids), dim)):
                    best, scores = block.best(query, k, place.get(uid, -1))
                    out.append((np.full(len(best), uid), np.full(len(best), id_), ids[best], scores))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["asked_uid", "query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, "asked_uid long, query_id long, vec_id long, score long")


def top(rows: DataFrame, asked: Column, k: int = 5, *, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of highest score for each row that meets ``asked``."""
    kept = rows.withColumn("_asked", F.coalesce(asked, F.lit(False)))
    kept = kept.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("q"), "_asked").where("id is not null and q is not null")
    kept = written(kept.withColumn("uid", F.monotonically_increasing_id()), "quantised")
    n, many, dim = kept.agg(F.count("*"), F.count_if("_asked"), F.coalesce(F.max(F.size("q")), F.lit(1))).first()
    rows_a_block, rows_a_group = fitting(n, BLOCKS, BLOCK, dim), fitting(many, 1, GROUP, dim)
    parts = -(-many // rows_a_group)
    blocks = written(_blocks(kept.select("uid", "id", "q").repartition(max(1, -(-n // rows_a_block))), rows_a_block), "blocks")
    groups = _groups(kept.where("_asked").select("uid", "id", "q").repartition(max(1, parts)), rows_a_group)
    groups = written(groups.withColumn("part", F.spark_partition_id()), "groups")
    # Groups are sent to the tasks that read blocks, SENT bytes at a time; blocks do not move.
    at_once = max(1, SENT // (2 * rows_a_group * (8 * dim + 16)))
    near = None
    for first in range(0, max(1, parts), at_once):
        some = groups.where(F.col("part").between(first, first + at_once - 1)).drop("part")
        found = _met(batches(blocks.join(F.broadcast(some), "dim")), k)
        near = found if near is None else near.unionByName(found)
    order = Window.partitionBy("asked_uid").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
