"""Periodic runs of words: stretches that repeat themselves at least three times over.

A run is a stretch of consecutive words with smallest period q (words q apart are the same), of at least
``shortest`` words and ``3 q``, that no neighbouring word extends. Every such run of period q holds two
blocks of q words in a row, at points of the grid 0, q, 2q, ..., that are equal. The grids of all periods of
a text, n/1 + n/2 + ... points, are harmonic: n log n pairs of a period and a grid point. Pairs are compared
many at a time, in NumPy: by the blocks' end words, then by hashes of blocks taken from prefix sums. The
first pair of each chain of equal blocks is extended to both sides by binary search over these hashes, for
all pairs at once. Runs that several periods find are kept under the smallest.

Hashes only ever overrate equality. Each run is verified word by word, and so is what a false equality could
have hidden (a first block that does not extend over itself); a text that fails is done anew with another
base. Texts are put together in groups of up to ``WORDS`` words; a longer text is a group by itself, and
pairs are made at most ``PAIRS`` at a time, so that memory stays a small multiple of a text's words.

Rules for odd input: a null text is empty and has no runs; neither have texts of fewer words than
``shortest``. Very long texts are taken whole. Each row is judged by itself, equal ones and those without an
id too. An empty table gives an empty result. Other columns are carried through; those named like a result
are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from recallspark.llm.rows import batches

#: Words of texts that are put together, and pairs of a period and a grid point that are compared at a time.
WORDS, PAIRS = 1 << 18, 1 << 20

#: Modulus of the hashes: products of two remainders fit 64 bits.
PRIME = np.uint64((1 << 31) - 1)

#: Times that a run's period fits into it at least.
TIMES = 3

Run = tuple[int, int, int]
Edit = Callable[[int | None, list[bytes]], list[bytes]]


class Hashes:
    """Hashes of all stretches of ``ids``, from sums of their prefixes."""

    def __init__(self, ids: np.ndarray, attempt: int) -> None:
        rng = np.random.default_rng([13, attempt])
        value = rng.integers(1, int(PRIME), size=int(ids.max(initial=0)) + 1, dtype=np.uint64)[ids]
        power = np.ones(len(ids) + 1, np.uint64)
        power[1:2] = rng.integers(1 << 20, int(PRIME), dtype=np.uint64)
        done = 2
        while done < len(power):
            part = power[done : 2 * done - 1]
            part[:] = power[1 : 1 + len(part)] * power[done - 1] % PRIME
            done += len(part)
        self.power = power
        self.sums = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(value * power[:-1] % PRIME, out=self.sums[1:])
        self.sums %= PRIME

    def equal(self, a: np.ndarray, q: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ``size`` words from ``a`` on and those from ``a + q`` on have equal hashes."""
        s, b = self.sums, a + q
        left, right = s[a + size] + PRIME - s[a], s[b + size] + PRIME - s[b]
        return left % PRIME * self.power[q] % PRIME == right % PRIME

    def longest(self, a: np.ndarray, q: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How far the stretches that begin (``back``: end) at ``a`` and ``a + q`` are equal, at most ``most``."""
        low, high = np.zeros_like(a), most.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            size = (low[open_] + high[open_] + 1) >> 1
            begin = a[open_] - size if back else a[open_]
            same = self.equal(begin, q[open_], size)
            low[open_] = np.where(same, size, low[open_])
            high[open_] = np.where(same, high[open_], size - 1)
        return low


def _pairs(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, period and grid point of all pairs, some at a time, each text's and period's points in order."""
    most = sizes // TIMES
    text = np.repeat(np.arange(len(sizes)), most)
    q = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    points = sizes[text] // q - 1
    ends = np.cumsum(points)
    total = int(ends[-1]) if len(ends) else 0
    for lo in range(0, total, PAIRS):
        hi = min(total, lo + PAIRS)
        a, b = np.searchsorted(ends, [lo, hi - 1], side="right")
        begin = ends[a : b + 1] - points[a : b + 1]
        kept = np.minimum(ends[a : b + 1], hi) - np.maximum(begin, lo)
        entry = np.repeat(np.arange(b - a + 1), kept)
        step = np.arange(lo, hi) - begin[entry]
        entry += a
        yield text[entry], q[entry], step * q[entry]


def runs_of(texts: list[np.ndarray], shortest: int = 24) -> list[list[Run]]:
    """``start, length, period`` of all runs of each text, given as numbers of words, by start and period."""
    out: list[list[Run]] = [[] for _ in texts]
    todo, attempt = [i for i, x in enumerate(texts) if len(x) >= shortest], 0
    while todo:
        found, failed = _tried([texts[i] for i in todo], shortest, attempt)
        for i, runs in zip(todo, found):
            out[i] = runs
        todo, attempt = [todo[i] for i in failed], attempt + 1
    return out


def _tried(texts: list[np.ndarray], shortest: int, attempt: int) -> tuple[list[list[Run]], list[int]]:
    """Runs by one set of hashes, and the texts for which these told unequal stretches equal."""
    sizes = np.array([len(x) for x in texts])
    ends = np.cumsum(sizes)
    begins, ids = ends - sizes, np.concatenate(texts)
    hashes = Hashes(ids, attempt)
    kept, failed = [], set()
    for text, q, point in _pairs(sizes):
        at = begins[text] + point
        same = np.flatnonzero((ids[at] == ids[at + q]) & (ids[at + q - 1] == ids[at + 2 * q - 1]))
        same = same[hashes.equal(at[same], q[same], q[same])]
        text, q, point, at = text[same], q[same], point[same], at[same]
        # Equal blocks in a row are of one run: the first of each chain stands for it.
        first = np.ones(len(at), bool)
        first[1:] = (text[1:] != text[:-1]) | (q[1:] != q[:-1]) | (point[1:] != point[:-1] + q[1:])
        text, q, point, at = text[first], q[first], point[first], at[first]
        after = hashes.longest(at, q, ends[text] - at - q, False)
        failed.update(text[after < q].tolist())
        size = hashes.longest(at, q, point, True)
        start, size = point - size, size + q + after
        enough = size >= np.maximum(shortest, TIMES * q)
        kept.append(np.stack([text[enough], start[enough], size[enough], q[enough]]))
    text, start, size, q = np.concatenate(kept, axis=1) if kept else np.zeros((4, 0), np.int64)
    order = np.lexsort((q, size, start, text))
    text, start, size, q = text[order], start[order], size[order], q[order]
    first = np.ones(len(text), bool)
    first[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (size[1:] != size[:-1])
    out: list[list[Run]] = [[] for _ in texts]
    for t, s, n, p in zip(*(x[first].tolist() for x in (text, start, size, q))):
        if t in failed:
            continue
        words = texts[t]
        fits = np.array_equal(words[s : s + n - p], words[s + p : s + n])
        if fits and (s == 0 or words[s - 1] != words[s - 1 + p]) and (s + n == len(words) or words[s + n] != words[s + n - p]):
            out[t].append((s, n, p))
        else:
            failed.add(t)
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out], sorted(failed)


def best_of(runs: list[Run]) -> Run | None:
    """The run with the greatest ratio of length to period, compared exactly; ties to the first, then the shortest period."""
    best = None
    for run in runs:  # by start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that stay when each run keeps its first period only, joined by one blank."""
    if not runs:
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    for start, size, period in runs:
        depth[start + period] += 1
        depth[start + size] -= 1
    return b" ".join([w for w, d in zip(words, np.cumsum(depth).tolist()) if not d])


def found(docs: DataFrame, shortest: int = 24, *, edit: Edit | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (by start, then period), ``best`` (null without runs) and ``collapsed``.

    ``edit`` may change the words, which it gets with the row's id, before runs are looked for.
    """
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    added = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run)), T.StructField("best", run), T.StructField("collapsed", T.StringType())]
    docs = docs.drop(*[f.name for f in added])
    names = [f"c{i}" for i in range(len(docs.columns))]
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    kind = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
    told = lambda r: None if r is None else dict(zip(("start", "length", "period"), r))

    def searched(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            at = 0
            for words in _grouped(batch, id_at, text_at, edit):
                number: dict[bytes, int] = defaultdict()
                number.default_factory = number.__len__
                numbers = [np.array([number[w] for w in x], np.int64) for x in words]
                number.default_factory = None  # else it holds itself, and waits for the collector of cycles
                runs = runs_of(numbers, shortest)
                part = batch.slice(at, len(words))
                at += len(words)
                made = [pa.array([len(x) for x in words], pa.int64()), pa.array([[told(r) for r in x] for x in runs], pa.list_(kind)), pa.array([told(best_of(x)) for x in runs], kind), pa.array([collapsed(x, r) for x, r in zip(words, runs)], pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [*names, *(f.name for f in added)])

    schema = T.StructType([*(T.StructField(n, f.dataType, f.nullable) for n, f in zip(names, docs.schema.fields)), *added])
    return batches(docs.toDF(*names)).mapInArrow(searched, schema).toDF(*docs.columns, *(f.name for f in added))


def _grouped(batch: pa.RecordBatch, id_at: int, text_at: int, edit: Edit | None) -> Iterator[list[list[bytes]]]:
    """The words of the batch's texts in order, by groups of texts."""
    held, size = [], 0
    data = batch.column(text_at).cast(pa.binary())
    for at in range(batch.num_rows):
        text = data[at].as_py()
        # Bytes are split at exactly the blanks that part words: 20 and 09 to 0D.
        words = text.split() if text else []
        if edit is not None:
            words = edit(batch.column(id_at)[at].as_py(), words)
        if held and size + len(words) > WORDS:
            yield held
            held, size = [], 0
        held.append(words)
        size += len(words)
    if held:
        yield held
