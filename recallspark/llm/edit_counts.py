"""Token counts that follow edits: a tree of sums over each document's pre-tokens, kept as a table.

``built`` encodes documents once and keeps, a row a document, the text and the characters and tokens of its
leaves, which are runs of pre-tokens. ``edited`` takes such a table and a batch of edits, lays the stored
sums out as a tree, encodes nothing but the leaves that an edit touches with some context before them, and
gives the rows anew, to be kept in the place of the old ones (``updated``).

Inner nodes know the sums of their two children. An edit begins at a leaf boundary at least one leaf and the
longest added token's name before it, and goes on until a new cut falls on an old one; sums change along the
paths to the root. New pre-tokens are dealt to the places of the leaves they replace, so the tree keeps its
shape; only where these would become far too large is it laid out anew, from its sums.

The tokenizer's pattern looks at nothing before a pre-token, so cuts from a common place in equal text are
equal, which is why stopping there gives the count that encoding the whole text would give. Names of added
tokens are tokens of their own, as the tokenizers library counts them.

Rules for odd input: a null text is the empty text and has no tokens. Places and lengths of an edit are cut
to the text's bounds, null ones are zero, and a null insertion is the empty text; edits of one document go
in the order of ``seq``, then of their other fields, each on the text that the one before left. Rows of equal
``doc_id`` are documents of their own and all get the edits of that id; edits of a null or unknown ``doc_id``
have no document. Other columns are carried through, those named like an added one are replaced. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallspark.llm.bpe import byte_pairs
from recallspark.llm.chunks import Memory, byte_letters
from recallspark.llm.rows import batches, texts, together
from recallspark.llm.token_files import tokenizer

#: Pre-tokens, or words with what hangs on them, of one leaf; the tree is laid out anew where an edit would
#: put more than ``CROWD`` times as many into one.
LEAF, CROWD = 32, 8


class Counter:
    """The library's tokenizer for whole columns of texts, and its model for single pieces, with a table of their counts."""

    def __init__(self, path: str):
        self.pairs, self.columns = byte_pairs(path), tokenizer(path)
        self.model, self.known = self.columns.coder.model, Memory()
        self.letters = dict(enumerate(byte_letters()))
        self.longest = max(map(len, self.pairs.added), default=0)

    def cuts(self, text: str, at: int) -> Iterator[tuple[str, int]]:
        """Pieces from a cut on, each with the place where it ends."""
        pairs = self.pairs
        for name in pairs.added_at.finditer(text, at) if pairs.added_at else ():
            for found in pairs.pattern.finditer(text, at, name.start()):
                yield found[0], found.end()
            at = name.end()
            yield name[0], at
        for found in pairs.pattern.finditer(text, at):
            yield found[0], found.end()

    def count(self, piece: str) -> int:
        """How many tokens a piece comes to."""
        if (found := self.known.get(piece)) is None:
            found = 1 if piece in self.pairs.added else len(self.model.tokenize(piece.encode("utf-8").decode("latin-1").translate(self.letters)))
            self.known.put(piece, found)
        return found


@lru_cache(maxsize=2)
def coder(path: str) -> Counter:
    """One a process."""
    return Counter(path)


class CountTree:
    """Sums of characters and tokens over leaves, as a binary tree in an array: children of i are 2i, 2i+1."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.n = len(chars)
        self.width = 1 << max(0, (self.n - 1).bit_length())
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        self.chars[self.width : self.width + self.n], self.tokens[self.width : self.width + self.n] = chars, tokens
        for i in range(self.width - 1, 0, -1):
            self._add_up(i)

    def _add_up(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def leaves(self) -> tuple[list[int], list[int]]:
        return self.chars[self.width : self.width + self.n], self.tokens[self.width : self.width + self.n]

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, by descent, and the character it begins with; the last one beyond the end."""
        i, before = 1, 0
        while i < self.width:
            i *= 2
            if place >= before + self.chars[i] and self.chars[i + 1]:
                before += self.chars[i]
                i += 1
        return i - self.width, before

    def change(self, first: int, chars: list[int], tokens: list[int]) -> None:
        """New sums for leaves from ``first`` on, and for the paths above them alone."""
        stale = set()
        for i, c, t in zip(range(first + self.width, first + self.width + len(chars)), chars, tokens):
            self.chars[i], self.tokens[i] = c, t
            stale.add(i // 2)
        while stale and stale != {0}:
            for i in stale:
                self._add_up(i)
            stale = {i // 2 for i in stale}


def dealt(pieces: list[tuple[int, int]], parts: int) -> tuple[list[int], list[int]]:
    """Characters and tokens of pieces, put evenly into so many leaves."""
    ends = [len(pieces) * k // parts for k in range(parts + 1)]
    return [sum(c for c, _ in pieces[a:b]) for a, b in zip(ends, ends[1:])], [sum(t for _, t in pieces[a:b]) for a, b in zip(ends, ends[1:])]


def leaves_of(text: str, counter: Counter) -> tuple[list[int], list[int]]:
    """Leaves of one text, which end where the pattern cuts."""
    pieces = [(len(p), counter.count(p)) for p, _ in counter.cuts(text, 0)]
    return dealt(pieces, max(1, -(-len(pieces) // LEAF)))


def leaves_of_column(texts: pa.Array, counter: Counter) -> tuple[list[Sequence[int]], list[Sequence[int]]]:
    """Leaves of each text: they end at certain blanks, or as the pattern cuts where white space stands beside blanks or there are none."""
    parts = counter.columns.parts(texts)
    if not len(texts):
        return [], []
    pieces = np.diff(parts.bounds)
    leaves = -(-pieces // LEAF)
    ends = np.cumsum(leaves)
    k = np.arange(ends[-1]) - np.repeat(ends - leaves, leaves)
    starts = np.repeat(parts.bounds[:-1], leaves) + np.repeat(pieces, leaves) * k // np.repeat(leaves, leaves)
    chars, tokens = ([x.tolist() for x in np.split(np.add.reduceat(of[parts.codes], starts), ends[:-1])] for of in (parts.sizes, parts.counts))
    for d in parts.coarse.tolist():
        chars[d], tokens[d] = leaves_of(texts[d].as_py() or "", counter)
    return chars, tokens


class CountedText:
    """A text with its tree; ``encoded`` counts the characters that edits have had encoded."""

    def __init__(self, text: str, counter: Counter, chars: list[int], tokens: list[int]):
        self.text, self.counter, self.encoded = text, counter, 0
        self.tree = CountTree(chars, tokens)

    def edit(self, start: int, removed: int, inserted: str) -> None:
        start = min(max(0, start), len(self.text))
        removed = min(max(0, removed), len(self.text) - start)
        text = self.text[:start] + inserted + self.text[start + removed :]
        shift, tree = len(inserted) - removed, self.tree
        size = lambda leaf: tree.chars[tree.width + leaf]
        first, begin = tree.leaf_at(max(0, start - 1))
        context = begin
        while first and (context - begin < max(1, self.counter.longest) or start - begin <= self.counter.longest):
            first -= 1
            begin -= size(first)
        last, end = first, begin
        while last < tree.n and end <= start + removed:
            end += size(last)
            last += 1
        made: list[tuple[int, int]] = []
        at = begin
        if begin < len(text):
            for piece, stop in self.counter.cuts(text, begin):
                made.append((len(piece), self.counter.count(piece)))
                at = stop
                while last < tree.n and end + shift < at:
                    end += size(last)
                    last += 1
                if at == end + shift and at >= start + len(inserted):
                    break
            else:
                last = tree.n
        else:
            last = tree.n
        self.encoded += at - begin
        self.text = text
        if len(made) <= CROWD * LEAF * max(1, last - first):
            tree.change(first, *dealt(made, last - first))
            return
        chars, tokens = tree.leaves()
        new = dealt(made, -(-len(made) // LEAF))
        self.tree = CountTree([*chars[:first], *new[0], *chars[last:]], [*tokens[:first], *new[1], *tokens[last:]])


EDIT = "struct<start:long,removed:long,inserted:string>"

#: What a kept tree adds to its document.
KEPT = [T.StructField("leaf_chars", T.ArrayType(T.IntegerType())), T.StructField("leaf_tokens", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())]


def _lists(rows: Sequence[Sequence[int]]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array([x for row in rows for x in row], pa.int32()))


def built(docs: DataFrame, path: str, *, text: str = "text") -> DataFrame:
    """``docs`` with ``leaf_chars, leaf_tokens`` and ``n_tokens``: the table to write and keep."""
    kept = docs.drop(*(f.name for f in KEPT))
    names, added = kept.columns, [f.name for f in KEPT]

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = coder(path)
        for some in together(found):
            chars, tokens = leaves_of_column(pa.concat_arrays([x.column(text) for x in some]), counter)
            row = 0
            for batch in some:
                here = slice(row, row := row + batch.num_rows)
                columns = [_lists(chars[here]), _lists(tokens[here]), pa.array([sum(t) for t in tokens[here]], pa.int64())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*names, *added])

    return batches(kept).mapInArrow(run, T.StructType([*kept.schema.fields, *KEPT]))


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """The kept trees that ``edits`` (``doc_id, seq, start, removed, inserted``) touch, with these by ``seq``.

    A document's own edits are one row's list, which is bounded by what is done to one document in a batch.
    """
    one = F.struct("seq", F.col("start").cast("long").alias("start"), F.col("removed").cast("long").alias("removed"), "inserted")
    lists = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(one)).alias("edits"))
    lists = lists.withColumn("edits", F.transform("edits", lambda e: F.struct(e["start"].alias("start"), e["removed"].alias("removed"), e["inserted"].alias("inserted"))))
    return trees.drop("edits").join(lists, "doc_id")


def edited(trees: DataFrame, path: str, *, text: str = "text") -> DataFrame:
    """Kept trees with a column ``edits``, after these: text and leaves anew, with ``n_tokens_after``, ``n_chars_after`` and ``n_encoded``.

    ``n_tokens`` stays the count before the edits; ``n_encoded`` is how many characters they had encoded.
    """
    added = ["n_tokens_after", "n_chars_after", "n_encoded"]
    kept = trees.drop(*added)
    out = [c for c in kept.columns if c not in (text, "edits", "leaf_chars", "leaf_tokens")]

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = coder(path)
        counter.columns.known = {}  # a worker that built trees still has its table of chunks
        for batch in found:
            done = []
            for said, edits, chars, tokens in zip(texts(batch, text), *(batch.column(c).to_pylist() for c in ("edits", "leaf_chars", "leaf_tokens"))):
                counted = CountedText(said, counter, chars, tokens)
                for e in edits or []:
                    if e is not None:
                        counted.edit(e["start"] or 0, e["removed"] or 0, e["inserted"] or "")
                done.append(counted)
            leaves = [c.tree.leaves() for c in done]
            columns = [pa.array([c.text for c in done], pa.string()), _lists([c for c, _ in leaves]), _lists([t for _, t in leaves])]
            columns += [pa.array([f(c) for c in done], pa.int64()) for f in (lambda c: c.tree.total, lambda c: len(c.text), lambda c: c.encoded)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in out), *columns], [*out, text, "leaf_chars", "leaf_tokens", *added])

    schema = T.StructType([*(f for f in kept.schema.fields if f.name in out), T.StructField(text, T.StringType()), *KEPT[:2], *(T.StructField(c, T.LongType()) for c in added)])
    return batches(kept).mapInArrow(run, schema)


def updated(trees: DataFrame, after: DataFrame) -> DataFrame:
    """The table to keep after a batch: the rows of ``edited`` in the place of the old ones of their ids."""
    new = after.withColumn("n_tokens", F.col("n_tokens_after")).select(*trees.columns)
    return trees.join(new.select("doc_id").distinct(), "doc_id", "left_anti").select(*trees.columns).unionByName(new)
