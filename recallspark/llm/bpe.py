"""Byte-level BPE by forced-boundary splitting.

A byte pair that occurs inside no vocabulary entry can never lie inside a token, so every place where
such a pair stands is a certain cut. Text is cut first where the tokenizer's own pattern cuts it, and
each piece again at its certain cuts; fragments are encoded each by itself, with a table of those met
before, and their ids are put one after another. The result equals the tokenizer's own.

Rules for odd input: a null text is the empty text and has no ids. The tokenizer's added tokens that
stand in a text become their own ids, as the tokenizer does by default. Repeated rows and repeated ids
are encoded each for itself. Columns of the input other than the text are carried through untouched.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from recallspark.llm.chunks import BlankChunks, Memory, byte_letters
from recallspark.llm.rows import batches, texts

#: Fixed value: the pattern that cuts text before merges apply.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Fragments of more bytes are merged with a heap.
LONG = 48

#: Chunks, and pieces of chunks that are no plain words, that one of the two tables of each holds at most. Dicts grow at
#: 349,525 and at 43,690 entries, and a worker keeps its tables for the stages that follow, so they are to be small.
REMEMBERED, PIECES = 345_000, 43_000

#: Stands for a pair that never merges; larger than every rank.
NEVER = 1 << 62


class BytePairs:
    """Encoder and decoder over one vocabulary file."""

    def __init__(self, path: str, pieces: int = PIECES):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or model["type"] != "BPE":
            raise ValueError(f"{path}: only plain byte-level BPE is encoded here")
        value = {letter: b for b, letter in enumerate(byte_letters())}
        raw = lambda token: bytes(value[c] for c in token)
        self.ids = {raw(token): i for token, i in model["vocab"].items()}
        self.bytes_of = {i: token for token, i in self.ids.items()}
        self.size = max(self.ids.values()) + 1
        self.rank: dict[int, int] = {}  # of a pair: its rank and the id it makes, in one number
        for rank, merge in enumerate(model["merges"]):
            left, right = map(raw, merge.split(" ") if isinstance(merge, str) else merge)
            self.rank[self.ids[left] * self.size + self.ids[right]] = rank * self.size + self.ids[left + right]
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.inside = bytearray(1 << 16)
        for token in self.ids:
            for a, b in zip(token, token[1:]):
                self.inside[a << 8 | b] = 1
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of.update({i: content.encode() for content, i in self.added.items()})
        self.added_at = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.pattern = regex.compile(PATTERN)
        self.digits = {i: str(i) for i in self.bytes_of}
        self.known = Memory(pieces)
        # Ids are remembered as bytes, which take less than a tuple and its numbers.
        self.plain = BlankChunks(self.pieces, lambda ids: array("I", ids).tobytes(), b"".join, self.fresh, REMEMBERED)

    def fragments(self, piece: bytes) -> list[bytes]:
        """The piece cut at every byte pair that no vocabulary entry holds."""
        inside = self.inside
        cuts = [i for i, (a, b) in enumerate(zip(piece, piece[1:]), 1) if not inside[a << 8 | b]]
        if not cuts:
            return [piece]
        return [piece[a:b] for a, b in zip([0, *cuts], [*cuts, len(piece)])]

    def merged(self, fragment: bytes) -> list[int]:
        """Ids of one fragment: the pair of least rank merges first, the leftmost of equal ones."""
        if len(fragment) > LONG:
            return self._merged_long(fragment)
        single, get, size = self.single, self.rank.get, self.size
        ids = [single[b] for b in fragment]
        ranks = [get(a * size + b, NEVER) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < NEVER:
            i = ranks.index(best)
            ids[i : i + 2] = (best % size,)
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] * size + ids[i], NEVER)
            if i < len(ranks):
                ranks[i] = get(ids[i] * size + ids[i + 1], NEVER)
        return ids

    def _merged_long(self, fragment: bytes) -> list[int]:
        """The same by a heap of waiting pairs, for fragments whose pairs are too many to search each time."""
        ids = [self.single[b] for b in fragment]
        n, size, get = len(ids), self.size, self.rank.get
        following, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
        waiting = []
        for i in range(n - 1):
            if (found := get(ids[i] * size + ids[i + 1])) is not None:
                waiting.append((found, i, ids[i], ids[i + 1]))
        heapq.heapify(waiting)
        while waiting:
            best, i, left, right = heapq.heappop(waiting)
            j = following[i]
            if gone[i] or j >= n or ids[i] != left or ids[j] != right:
                continue
            ids[i], gone[j], following[i] = best % size, True, following[j]
            if following[i] < n:
                before[following[i]] = i
            for a, b in ((before[i], i), (i, following[i])):
                if a >= 0 and b < n and (found := get(ids[a] * size + ids[b])) is not None:
                    heapq.heappush(waiting, (found, a, ids[a], ids[b]))
        return [x for x, dead in zip(ids, gone) if not dead]

    def fresh(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece of the pattern, not remembered."""
        return tuple(chain.from_iterable(map(self.merged, self.fragments(piece.encode("utf-8")))))

    def piece(self, piece: str) -> tuple[int, ...]:
        """The same, remembered."""
        if (ids := self.known.get(piece)) is None:
            ids = self.fresh(piece)
            self.known.put(piece, ids)
        return ids

    def pieces(self, text: str) -> list[int]:
        """Ids of ordinary text, cut by the pattern alone."""
        return list(chain.from_iterable(map(self.piece, self.pattern.findall(text))))

    def sections(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Stretches of ordinary text (with None) and the added tokens between them (with their id)."""
        at = 0
        if self.added_at is not None:
            for m in self.added_at.finditer(text):
                yield text[at : m.start()], None
                yield m[0], self.added[m[0]]
                at = m.end()
        yield text[at:], None

    def encode(self, text: str) -> list[int]:
        out = array("I")
        for section, added in self.sections(text):
            if added is None:
                out.frombytes(self.plain.encode(section))
            else:
                out.append(added)
        return out.tolist()

    def decode(self, ids: list[int]) -> str:
        """Bytes of the ids as text; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def byte_pairs(path: str, pieces: int = PIECES) -> BytePairs:
    """One encoder a process."""
    return BytePairs(path, pieces)


def encode(docs: DataFrame, path: str, *, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column of token ids, any earlier column of that name replaced."""
    kept = docs.drop(ids)
    names = kept.columns

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_pairs(path)
        for batch in found:
            coded = pa.array([coder.encode(x) for x in texts(batch, text)], type=pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, coded], [*names, ids])

    return batches(kept).mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(coded: DataFrame, path: str, *, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``coded`` with the text of its ids; null ids give a null text."""
    kept = coded.drop(text)
    names = kept.columns

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_pairs(path)
        for batch in found:
            said = [None if x is None else coder.decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, type=pa.string())], [*names, text])

    return batches(kept).mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(text, T.StringType())]))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per document ``doc_id, n_tokens, ids_sha256, decoded_sha256, text_sha256``: encoded, then decoded from the ids.

    Ids and texts go through digests in the task that made them, so neither is moved.
    """

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_pairs(path)
        digits = coder.digits.__getitem__
        for batch in found:
            out = []
            for said in texts(batch):
                ids = coder.encode(said)
                back = coder.decode(ids)
                out.append((len(ids), hashlib.sha256(",".join(map(digits, ids)).encode()).hexdigest(), hashlib.sha256(back.encode("utf-8")).hexdigest(), hashlib.sha256(said.encode("utf-8")).hexdigest()))
            made = [pa.array(column, type=kind) for column, kind in zip(zip(*out), (pa.int64(), pa.string(), pa.string(), pa.string()))] if out else [pa.array([], type=kind) for kind in (pa.int64(), pa.string(), pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "text_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, text_sha256 string"
    return batches(docs).select("doc_id", "text").mapInArrow(run, schema)
