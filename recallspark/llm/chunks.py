"""Text cut at certain blanks, with a table of chunks met before.

In byte-level tokenizers whose pattern lets one blank open a word, a blank between two characters that
are no white space always begins a piece, so the text may be cut before it.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Sequence
from itertools import chain, islice
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries one of the two tables holds at most; when it is full it becomes the older one, and what stands
#: only in the one before it is forgotten, which changes no result.
REMEMBERED = 400_000

#: Longer keys are not remembered.
KEY_CHARACTERS = 64

#: Marks that stand as a piece of their own after letters.
MARKS = ",.;:!?"

Ids = Sequence[int]


class Uncertain(Exception):
    """A chunk is not certain to begin and end a piece."""


class Asking(dict):
    """A table that asks ``missed`` for what it does not hold."""

    __slots__ = ("missed",)

    def __init__(self, missed: Callable[[str], Any]):
        super().__init__()
        self.missed = missed

    def __missing__(self, said: str) -> Any:
        return self.missed(said)


class Memory:
    """A bounded table of what was worked out before."""

    def __init__(self, size: int = REMEMBERED, table: Callable[[], dict] = dict):
        self.size, self.table, self.young, self.old = size, table, table(), {}

    def get(self, said: str) -> Any:
        found = self.young.get(said)
        if found is None and (found := self.old.get(said)) is not None:
            self.put(said, found)
        return found

    def put(self, said: str, found: Any) -> None:
        if len(said) <= KEY_CHARACTERS:
            if len(self.young) >= self.size:
                self.young, self.old = self.table(), self.young
            self.young[said] = found


def flat(parts: list[tuple[int, ...]]) -> list[int]:
    return list(chain.from_iterable(parts))


class BlankChunks:
    """Encodes by chunks, each with the blank before it; ``encode`` gives what any text comes to.

    ``whole`` encodes a text by itself, ``pack`` makes of its ids what is remembered, and ``join`` puts
    remembered parts one after another. ``word``, where it is given, encodes a blank and a run of letters.
    """

    def __init__(self, whole: Callable[[str], Ids], pack: Callable[[Ids], Any] = tuple, join: Callable[[list], Any] = flat, word: Callable[[str], Ids] | None = None, size: int = REMEMBERED):
        self.whole, self.pack, self.join, self.word = whole, pack, join, word
        self.known = Memory(size, lambda: Asking(self._certain))
        self.marks = {x: pack(whole(x)) for x in MARKS} if word else {}

    def _chunk(self, chunk: str) -> Any:
        """A blank and what stands up to the next one; None unless both are certain cuts."""
        if (found := self.known.get(chunk)) is None:
            if not chunk or chunk[0].isspace() or chunk[-1].isspace():
                return None
            if self.word is None:
                found = self.pack(self.whole(" " + chunk))
            elif chunk.isalpha():
                found = self.pack(self.word(" " + chunk))
            elif (mark := self.marks.get(chunk[-1])) is not None and chunk[:-1].isalpha():
                # A run of letters and the mark after it are two pieces of the pattern.
                found = self.join([self._chunk(chunk[:-1]), mark])
            else:
                found = self.pack(self.whole(" " + chunk))
            self.known.put(chunk, found)
        return found

    def _certain(self, chunk: str) -> Any:
        if (found := self._chunk(chunk)) is None:
            raise Uncertain
        return found

    def alone(self, text: str) -> Any:
        return self.join([self.pack(self.whole(text))])

    def parts(self, text: str) -> list | None:
        """What each chunk comes to, the first without a blank before it; None where white space stands beside a blank."""
        first, *rest = text.split(" ")
        if not rest or not first or first[-1].isspace():
            return None
        try:
            return [self.pack(self.whole(first)), *map(self.known.young.__getitem__, rest)]
        except Uncertain:
            return None

    def encode(self, text: str) -> Any:
        """The text by its chunks, or as a whole where these are not certain."""
        found = self.parts(text)
        return self.alone(text) if found is None else self.join(found)


#: Chunks that ``ColumnChunks`` remembers.
COLUMN_REMEMBERED = 1_000_000

#: New chunks that the library is given as one text; longer texts cost it more a chunk.
RUN = 100

#: Chunks of ASCII without apostrophes and of letters that are ones in every version of Unicode, and lines of such.
PLAIN = r"\A[!-&(-~ªµºÀ-ÖØ-öø-ɏ]+(?:\n[!-&(-~ªµºÀ-ÖØ-öø-ɏ]+)*\z"

#: What the tokenizer's pattern cuts these into, as bytes in UTF-8; other bytes than ASCII are of letters.
PIECE = re.compile(rb" ?[A-Za-z\x80-\xff]+| ?[0-9]+| ?[!-/:-@\[-`{-~]+|\n")


def packed(ids: Ids) -> bytes:
    return array("i", ids).tobytes()


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files: itself where printable, else from U+0100 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Parts:
    """A column of texts as numbers of values: text ``d`` is ``values[codes[bounds[d]]], ...`` up to the next bound.

    ``values`` are ids as 32-bit integers, ``sizes`` the characters of each. ``coarse`` are the texts with a part
    that is more than one chunk, as white space stands beside a blank, and those that are one chunk.
    """

    def __init__(self, values: list[bytes], sizes: np.ndarray, codes: np.ndarray, bounds: np.ndarray, coarse: np.ndarray):
        self.values, self.sizes, self.codes, self.bounds, self.coarse = values, sizes, codes, bounds, coarse
        self.counts = np.fromiter(map(len, values), np.int64, len(values)) // 4

    def ids(self, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and all ids, with those of ``end`` after each text."""
        values = [*self.values, end]
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(self.counts), sum(map(len, values)) // 4].astype(np.int32)), pa.array(np.frombuffer(b"".join(values), np.int32)))
        codes = np.insert(self.codes, self.bounds[1:], len(values) - 1)
        taken = lists.take(pa.array(codes))
        ends = taken.offsets.to_numpy()[self.bounds + np.arange(len(self.bounds))]
        return np.diff(ends).astype(np.int64), taken.flatten().to_numpy()


class ColumnChunks:
    """Encodes columns of texts by the tokenizers library, each chunk of a column that is not remembered once.

    A column is split and its different chunks are found by Arrow. New ones go to the library many at a time, as one
    text, whose ids are dealt to them by their bytes: plain words to its model, other chunks to all of it.
    """

    def __init__(self, path: str, size: int = COLUMN_REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.coder = Tokenizer.from_file(path)
        self.coder.no_truncation()
        self.coder.no_padding()
        self.size, self.known = size, {}
        pre, letters = spec["pre_tokenizer"] or {}, byte_letters()
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec["normalizer"] and spec["model"]["type"] == "BPE"
        self.plain = plain and all(x in spec["model"]["vocab"] for x in letters) and not any(" " in x["content"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"])
        if not self.plain:
            return
        self.model = Tokenizer(self.coder.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        # No text in UTF-8 holds the byte 255, so it can stand between pieces.
        self.letters = {**dict(enumerate(letters)), 255: " "}
        self.added = [x["content"] for x in spec["added_tokens"]]
        widths = {**{i: len(token) for token, i in spec["model"]["vocab"].items()}, **{x["id"]: len(x["content"].encode()) for x in spec["added_tokens"]}}
        self.width = np.zeros(max(widths) + 1, np.int64)
        self.width[list(widths)] = list(widths.values())

    def _whole(self, said: list[str]) -> list[bytes]:
        return [packed(x.ids) for x in self.coder.encode_batch_fast(said, add_special_tokens=False)]

    def _asked(self, chunks: pa.Array, plain: bool) -> list[bytes]:
        """Ids of chunks without white space at their ends, each with a blank before it."""
        joined = pc.binary_join_element_wise(pa.scalar(b" "), chunks.cast(pa.binary()), pa.scalar(b""))
        if not len(joined):
            return []
        ends, said = np.frombuffer(joined.buffers()[1], np.int32)[: len(joined) + 1], memoryview(joined.buffers()[2])
        places = [*ends[:-1:RUN].tolist(), int(ends[-1])]
        runs = [bytes(said[a:b]) for a, b in zip(places, places[1:])]
        runs = [b"\xff".join(PIECE.findall(x)).decode("latin-1").translate(self.letters) for x in runs] if plain else [x.decode("utf-8") for x in runs]
        ids = np.concatenate([np.array(x.ids, np.int32) for x in (self.model if plain else self.coder).encode_batch_fast(runs, add_special_tokens=False)])
        made, stops = np.cumsum(self.width[ids]), ends[1:]
        last = np.searchsorted(made, stops)
        if last[-1] != len(ids) - 1 or not np.array_equal(made[last], stops):
            raise ValueError("a chunk does not begin and end with a token")
        raw, at = ids.tobytes(), (4 * (last + 1)).tolist()
        return [raw[a:b] for a, b in zip([0, *at], at)]

    def _values(self, found: pa.Array, chunks: list[str]) -> tuple[list[bytes], list[int]]:
        """Ids of different chunks, and which of these begin or end with white space and so have none."""
        values, new = list(map(self.known.get, chunks)), {}
        missed = [i for i, x in enumerate(values) if x is None]
        asked = found.take(pa.array(missed, pa.int64()))
        plain = pc.match_substring_regex(asked, PLAIN)
        for name in self.added:
            plain = pc.and_not(plain, pc.match_substring(asked, name))
        plain, missed = plain.to_numpy(zero_copy_only=False).astype(bool), np.array(missed, np.int64)
        others = missed[~plain].tolist()
        sure = [i for i in others if chunks[i] and not chunks[i][0].isspace() and not chunks[i][-1].isspace()]
        for places, kind in ((missed[plain].tolist(), True), (sure, False)):
            for i, ids in zip(places, self._asked(found.take(pa.array(places, pa.int64())), kind)):
                values[i] = ids
                if len(chunks[i]) <= KEY_CHARACTERS:
                    new[chunks[i]] = ids
        if len(self.known) + len(new) > self.size:
            # The chunks of this column stay, and of the others those that were met first, as these are the frequent ones.
            stay = {x: ids for x, ids in islice(zip(chunks, values), self.size) if ids is not None and len(x) <= KEY_CHARACTERS}
            self.known = stay | dict(islice(self.known.items(), max(0, self.size // 2 - len(stay))))
        else:
            self.known.update(new)
        unsure = [i for i in others if values[i] is None]
        for i in unsure:
            values[i] = b""
        return values, unsure

    def parts(self, texts: pa.Array) -> Parts:
        """The column's texts by their chunks; a null text is the empty text."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        n = len(texts)
        if not self.plain:
            return Parts(self._whole(texts.to_pylist()), pc.utf8_length(texts).to_numpy(), np.arange(n), np.arange(n + 1), np.arange(n))
        split = pc.split_pattern(texts, " ")
        bounds = split.offsets.to_numpy().astype(np.int64)
        found = split.flatten().dictionary_encode()
        chunks, codes = found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy().astype(np.int64)
        values, unsure = self._values(found.dictionary, chunks)
        opens, closes = np.ones(len(chunks), bool), np.ones(len(chunks), bool)
        opens[unsure] = [chunks[i] != "" and not chunks[i][0].isspace() for i in unsure]
        closes[unsure] = [chunks[i] != "" and not chunks[i][-1].isspace() for i in unsure]
        # A part goes on over blanks that are not certain to begin a piece.
        cut = np.r_[True, closes[codes[:-1]] & opens[codes[1:]]][: len(codes)]
        cut[bounds[:-1]] = True
        begins = np.flatnonzero(cut)
        ends = np.r_[begins[1:], len(codes)][: len(begins)]
        first = np.zeros(len(codes), bool)
        first[bounds[:-1]] = True
        apart = np.flatnonzero(first[begins] | (ends - begins > 1) | ~closes[codes[ends - 1]])
        said = {}
        own = codes[begins]
        for i in apart.tolist():
            a = begins[i]
            text = " ".join([chunks[k] for k in codes[a : ends[i]]])
            own[i] = len(chunks) + said.setdefault(text if first[a] else " " + text, len(said))
        starts = np.searchsorted(begins, bounds)
        several = np.searchsorted(bounds, begins[ends - begins > 1], "right") - 1
        sizes = np.r_[pc.utf8_length(found.dictionary).to_numpy() + 1, np.fromiter(map(len, said), np.int64, len(said))]
        return Parts(values + self._whole(list(said)), sizes, own, starts, np.union1d(several, np.flatnonzero(np.diff(bounds) == 1)))

    def encode(self, text: str) -> bytes:
        """One text's ids as 32-bit integers."""
        return self.parts(pa.array([text], pa.string())).ids()[1].tobytes()
