"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its score comes from what it and its two neighbours look like, and from how
labels follow one another; forward-backward gives the probability that it is good, and a document's score
is the mean of these, weighted by length, turned into a probability by a logistic curve of that mean. Weights
are learned from documents of known quality,
whose lines all take the document's label.

Documents are worked on in groups bounded by lines, filling included, so a very long text stands alone;
of such a text only three numbers a line are held, not all that its lines look like.

Rules for odd input: a null or empty text is one empty line. Rows of equal ``doc_id`` are scored each for
itself, and one of them, that of least text hash, is learned from; a null ``doc_id`` is never learned from
and is not held out. Labels other than 0 and 1 are not learned from; of several labels of one document the
least counts. Without any label every score is one half; with labels of one kind alone scores lean to it.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallspark.llm.rows import batches, texts
from recallspark.session import written

#: Documents that are learned from at most: those whose ids hash lowest.
SAMPLE = 3000

#: Lines of one document that are learned from at most, as even runs of ``RUN`` lines over the whole text.
MOST_LINES, RUN = 2000, 250

#: Lines of all documents that are learned from at most.
SAMPLE_LINES = 250_000

#: Lines, filling included, that one group of documents has at most, but for a single longer one.
CELLS = 1 << 16

SYMBOLS = "#*$%&|<>"

#: Length of what one line looks like.
LOOKS = 13


class Lines:
    """The lines of a text, and what each looks like."""

    def __init__(self, text: str):
        self.lines = text.split("\n")
        every = text.split()
        windows = Counter(zip(every, every[1:], every[2:]))
        self.repeated = {w for w, n in windows.items() if n > 1} if len(windows) < len(every) - 2 else ()
        self.copies = Counter(self.lines)

    def __len__(self) -> int:
        return len(self.lines)

    def sizes(self) -> np.ndarray:
        """Each line's length in characters plus one."""
        return np.fromiter(map(len, self.lines), float, len(self.lines)) + 1.0

    def looks(self, start: int, stop: int) -> np.ndarray:
        """What these lines look like, one row a line; places beyond the ends are rows of zeros."""
        out = np.zeros((stop - start, LOOKS))
        for i in range(max(0, start), min(stop, len(self.lines))):
            self._look(self.lines[i], out[i - start])
        return out

    def _look(self, line: str, out: np.ndarray) -> None:
        own, chars = line.split(), len(line)
        n = len(own)
        if not n:
            out[0] = 1.0
            return
        again = sum(w in self.repeated for w in zip(own, own[1:], own[2:])) if self.repeated else 0
        marks, symbols = line.count("!"), sum(map(line.count, SYMBOLS))
        capitals, figures = sum(map(str.isupper, own)), sum(map(str.isdigit, own))
        mean = (chars - n) / n
        out[1:] = (
            1.0,
            min(1.0, math.log1p(n) / 6),
            min(1.0, symbols / n),
            symbols > 0.2 * n,
            min(1.0, marks / n),
            marks > 0.2 * n,
            capitals / n,
            figures / n,
            min(1.0, again / max(1, n - 2)),
            self.copies[line] > 1,
            len(set(own)) / n,
            min(1.0, abs(mean - 4.5) / 5),
        )

    def with_neighbours(self, start: int, stop: int) -> np.ndarray:
        """Each line beside the one before and the one after."""
        return beside(self.looks(start - 1, stop + 1))

    def scores(self, weights: np.ndarray, step: int = 4096) -> np.ndarray:
        """Each line's score for good, some lines at a time."""
        return np.concatenate([self.with_neighbours(a, min(a + step, len(self))) @ weights for a in range(0, len(self), step)])


def beside(x: np.ndarray) -> np.ndarray:
    """All but the first and last of these lines, each beside the one before and the one after."""
    return np.hstack([x[1:-1], x[:-2], x[2:]])


def runs(n: int, most: int = MOST_LINES, run: int = RUN) -> list[tuple[int, int]]:
    """The whole of n lines, or even runs over them that come to ``most``."""
    if n <= most:
        return [(0, n)]
    return [(a, a + run) for a in np.linspace(0, n - run, most // run).astype(int).tolist()]


def groups(sizes: list[int], cells: int = CELLS) -> Iterator[list[int]]:
    """Places of documents of like length, as many as fit when all are filled up to the longest; a longer one alone."""
    part: list[int] = []
    for i in sorted(range(len(sizes)), key=sizes.__getitem__):
        if part and (len(part) + 1) * sizes[i] > cells:
            yield part
            part = []
        part.append(i)
    if part:
        yield part


def filled(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Arrays of unequal length as one, with zeros behind them, and where they are."""
    out = np.zeros((len(rows), max(map(len, rows)), *rows[0].shape[1:]))
    there = np.zeros(out.shape[:2], dtype=bool)
    for i, row in enumerate(rows):
        out[i, : len(row)], there[i, : len(row)] = row, True
    return out, there


@dataclass
class Chain:
    """Weights: of looks (for good against bad), and of a label after a label, 0 bad and 1 good."""

    weights: np.ndarray
    steps: np.ndarray
    curve: tuple[float, float] = (1.0, 0.0)

    def marginals(self, score: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of good by document and line, of pairs of labels in all, and log-sums by document.

        ``score`` has a row a document, ``there`` tells its lines from filling. Sums are scaled at every
        line, so documents of any length stay finite.
        """
        docs, n = score.shape
        potential = np.stack([np.exp(-np.maximum(score, 0)), np.exp(np.minimum(score, 0))], axis=2)
        step = np.exp(self.steps)
        forward, scale = np.zeros((n, docs, 2)), np.ones((n, docs))
        now = potential[:, 0]
        for t in range(n):
            if t:
                now = np.where(there[:, t, None], (now @ step) * potential[:, t], now)
            scale[t] = now.sum(axis=1)
            now = now / scale[t][:, None]
            forward[t] = now
        good, pairs = np.zeros((docs, n)), np.zeros((2, 2))
        back = np.ones((docs, 2))
        for t in range(n - 1, -1, -1):
            both = forward[t] * back
            good[:, t] = both[:, 1] / both.sum(axis=1)
            if t:
                ahead = potential[:, t] * back
                joint = forward[t - 1][:, :, None] * step[None] * ahead[:, None, :]
                joint /= joint.sum(axis=(1, 2), keepdims=True)
                pairs += joint[there[:, t]].sum(axis=0)
                moved = ahead @ step.T
                back = np.where(there[:, t, None], moved / moved.sum(axis=1, keepdims=True), back)
        logs = (np.log(scale) * there.T).sum(axis=0) + (np.maximum(score, 0) * there).sum(axis=1)
        return good, pairs, logs

    def alone(self, score: np.ndarray) -> np.ndarray:
        """Probabilities of good of one document's lines: for long ones plain numbers are faster than arrays."""
        (bb, bg), (gb, gg) = np.exp(self.steps).tolist()
        bad, good = np.exp(-np.maximum(score, 0)).tolist(), np.exp(np.minimum(score, 0)).tolist()
        forward, n = [], len(score)
        b, g = bad[0], good[0]
        for t in range(n):
            if t:
                b, g = (b * bb + g * gb) * bad[t], (b * bg + g * gg) * good[t]
            g /= b + g
            b = 1 - g
            forward.append(g)
        b, g = 1.0, 1.0
        for t in range(n - 1, -1, -1):
            here = forward[t]
            forward[t] = here * g / (here * g + (1 - here) * b)
            b, g = b * bad[t], g * good[t]
            b, g = bb * b + bg * g, gb * b + gg * g
            whole = b + g
            b, g = b / whole, g / whole
        return np.array(forward)

    def means(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Length-weighted mean probability of good for each (scores, lengths) of lines."""
        out = np.zeros(len(found))
        for part in groups([len(x) for x, _ in found]):
            if len(part) == 1:
                score, size = found[part[0]]
                out[part] = self.alone(score) @ size / size.sum()
                continue
            score, there = filled([found[i][0] for i in part])
            size, _ = filled([found[i][1] for i in part])
            good, _, _ = self.marginals(score, there)
            out[part] = (good * size).sum(axis=1) / size.sum(axis=1)
        return out

    def qualities(self, texts: list[str]) -> np.ndarray:
        """Each text's probability of being good."""
        seen = []
        for text in texts:
            lines = Lines(text)
            seen.append((lines.scores(self.weights), lines.sizes()))
        return self.turned(self.means(seen))

    def turned(self, means: np.ndarray) -> np.ndarray:
        slope, shift = self.curve
        return 1 / (1 + np.exp(-np.clip(slope * _log_odds(means) + shift, -500, 500)))


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p) - np.log1p(-p)


def curve(means: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from log-odds of means to labels, by Newton's steps."""
    x = np.stack([_log_odds(means), np.ones(len(means))], axis=1)
    found = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ found, -30, 30)))
        pull = 1e-2 * (found - [1.0, 0.0])
        found = found - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), x.T @ (p - label) + pull)
        found[0] = max(found[0], 0.05)
    return float(found[0]), float(found[1])


def fit(found: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 150, rate: float = 0.15, keep: float = 1e-3) -> Chain:
    """Learns from (looks with neighbours, lengths, label) of runs of lines by Adam on the likelihood of their label chains."""
    width = 3 * LOOKS
    weights, steps = np.zeros(width), np.zeros((2, 2))
    if not found:
        return Chain(weights, steps)
    parts = []
    for part in groups([len(x) for x, *_ in found]):
        x, there = filled([found[i][0] for i in part])
        parts.append((x, there, np.array([found[i][2] for i in part], dtype=float)))
    lines = sum(len(x) for x, *_ in found)
    mean, spread = np.zeros(width + 4), np.zeros(width + 4)
    for k in range(1, rounds + 1):
        chain, slope = Chain(weights, steps), np.zeros(width + 4)
        for x, there, label in parts:
            good, pairs, _ = chain.marginals(x @ weights, there)
            slope[:width] += np.einsum("dt,dtf->f", (label[:, None] - good) * there, x)
            inner = there[:, 1:].sum(axis=1)
            slope[width:] += (np.diag([(inner * (1 - label)).sum(), (inner * label).sum()]) - pairs).ravel()
        slope = slope / lines - keep * np.r_[weights, steps.ravel()]
        mean, spread = 0.9 * mean + 0.1 * slope, 0.99 * spread + 0.01 * slope * slope
        move = rate * (mean / (1 - 0.9**k)) / (np.sqrt(spread / (1 - 0.99**k)) + 1e-8)
        weights, steps = weights + move[:width], steps + move[width:].reshape(2, 2)
    chain = Chain(weights, steps)
    chain.curve = curve(chain.means([(x @ weights, size) for x, size, _ in found]), np.array([y for *_, y in found], dtype=float))
    return chain


def remainder(doc_id: Column) -> Column:
    """The crc32 of the id as text, modulo 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = SAMPLE_LINES) -> Chain:
    """A chain fitted to at most ``sample`` labelled documents outside the held-out fifth, and at most ``lines`` lines of them.

    The sample is drawn among the labels alone, so that only its own texts leave the scan. One text of each is
    looked at, by at most ``MOST_LINES`` of its lines; documents are taken in order of a hash of their ids as
    long as their lines come to no more than ``lines`` (the first one in any case). What reaches the driver is
    ``LOOKS`` floats of each of these lines: 13 MB, however many and long the texts are.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & (remainder(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            rows = []
            for doc_id, quality, text in zip(batch.column("doc_id").to_pylist(), batch.column("quality").to_pylist(), texts(batch)):
                known = Lines(text)
                sizes = known.sizes()
                # Each run with the line before and the one after it, from which its neighbours are told.
                rows += [(doc_id, quality, a, known.looks(a - 1, b + 1).astype(np.float32).ravel(), sizes[a:b].astype(np.float32)) for a, b in runs(len(known))]
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float32()), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "quality", "start", "x", "size"])

    # ``chosen`` has no more rows than ``sample``, which is why it may be sent to every task.
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", F.col("quality").cast("int").alias("quality")).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    texts_ = written(joined.select("doc_id", "quality", "t.text"), "labelled")
    # One row a document of the sample: their running sum is no large window.
    many = F.least(F.regexp_count(F.coalesce("text", F.lit("")), F.lit("\n")) + 1, F.lit(MOST_LINES))
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    few = texts_.select("doc_id", many.alias("n")).withColumns({"all": F.sum("n").over(order), "place": F.row_number().over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))}).where((F.col("all") <= lines) | (F.col("place") == 1))
    looked = batches(texts_.join(F.broadcast(few.select("doc_id")), "doc_id").select("doc_id", "quality", "text"), 32).mapInArrow(run, "doc_id long, quality int, start long, x array<float>, size array<float>")
    rows = looked.toArrow().sort_by([("doc_id", "ascending"), ("start", "ascending")])
    return fit([(beside(x.values.to_numpy().astype(float).reshape(-1, LOOKS)), size.values.to_numpy().astype(float), y) for x, size, y in zip(rows.column("x"), rows.column("size"), rows.column("quality").to_pylist())])


def scored(docs: DataFrame, chain: Chain, threshold: float = 0.3) -> DataFrame:
    """Per row ``doc_id, held_out, score, predicted``."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            scores = chain.qualities(texts(batch)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"))
    return batches(marked).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
