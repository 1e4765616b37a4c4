"""Byte pairs, token files and edit-aware counts against the tokenizers library."""

import hashlib
import random
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import orc
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recallspark.llm import bpe, chunks, edit_counts, token_files
from recallspark.llm.queries import BYTE_BPE, QUERIES
from recallspark.session import new_folder, written
from tests.llm.helpers import DOCS, docs, key

LIBRARY = Tokenizer.from_file(BYTE_BPE)
PAIRS = bpe.byte_pairs(BYTE_BPE)
COUNTER = edit_counts.coder(BYTE_BPE)
PARTS = ["a", " ", "  ", "\n", "\t", "'s", "'", "\x1c", "\x85", "\xa0", "é", "ß", "<|endoftext|>", "<|", "1", "²", "!", "漢", "́", "\U0001f600", "\r", "the ", "ing", ",", " ", "x.", "\x00"]


def ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join) | st.text(max_size=40))
def test_bytes_pairs_and_files_encode_as_the_library(text):
    assert PAIRS.encode(text) == ids(text)
    assert np.frombuffer(token_files.tokenizer(BYTE_BPE).encode(text), np.int32).tolist() == ids(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=6))
def test_decodes_any_ids_as_the_library(some):
    assert PAIRS.decode(some) == LIBRARY.decode(some, skip_special_tokens=False)


def test_cuts_stand_where_no_entry_has_the_pair():
    piece = "thndäö漢字".encode()
    parts = PAIRS.fragments(piece)
    assert b"".join(parts) == piece
    at = 0
    for part in parts[:-1]:
        at += len(part)
        assert not any(piece[at - 1 : at + 1] in token for token in PAIRS.ids)


def test_round_trip_of_odd_rows(spark):
    got = sorted((tuple(r) for r in bpe.round_trip(docs(spark), BYTE_BPE).collect()), key=key)
    want = []
    for doc_id, text, *_ in DOCS:
        text = text or ""
        back = LIBRARY.decode(ids(text), skip_special_tokens=False)
        want.append((doc_id, len(ids(text)), hashlib.sha256(",".join(map(str, ids(text))).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=key)
    assert bpe.round_trip(docs(spark, []), BYTE_BPE).count() == 0


def test_encode_and_decode_keep_other_columns(spark):
    df = docs(spark).withColumnRenamed("lang", "ids")
    coded = bpe.encode(df, BYTE_BPE)
    assert coded.columns == ["doc_id", "text", "source", "n_chars", "ids"]
    for r in bpe.decode(coded, BYTE_BPE, text="back").collect():
        assert r["back"] == (r["text"] or "")


def test_chunks_are_asked_for_once():
    asked = []
    coder = chunks.BlankChunks(lambda said: [len(said), asked.append(said)][:1], size=2)
    assert coder.encode("a b b c") == [1, 2, 2, 2]
    assert coder.encode("a dd b c") == [1, 3, 2, 2]
    assert asked == ["a", " b", " c", "a", " dd"]
    assert coder.parts("a  b") is None and coder.parts("a b\t c") is None


def test_full_tables_of_an_encoder_are_small():
    """A worker keeps them for all stages that follow, and two workers share an executor."""
    rng = random.Random(5)
    said = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(20_000)]
    coder = bpe.BytePairs(BYTE_BPE)
    tracemalloc.start()
    coder.encode(" ".join(said))
    chunk = tracemalloc.get_traced_memory()[0] / len(said)
    tracemalloc.stop()
    coder = bpe.BytePairs(BYTE_BPE)
    tracemalloc.start()
    for x in said:
        coder.piece(x)
    piece = tracemalloc.get_traced_memory()[0] / len(said)
    tracemalloc.stop()
    assert 2 * (coder.plain.known.size * chunk + coder.known.size * piece) < 200e6


def test_remembered_chunks_come_to_the_same_ids():
    """Words, words with a mark and others, from tables that are empty, filled and turned over; letters are the pattern's letters."""
    coder = bpe.BytePairs(BYTE_BPE)
    coder.known.size = coder.plain.known.size = 3
    for text in 3 * ["so Größe, größe! naïve 12.5 it's", "it's so so, so! 漢字 漢字. <|endoftext|> so", "x\ny, x\ny y-z <|endoftext|>"]:
        assert coder.encode(text) == ids(text)
    assert all(coder.pattern.fullmatch(" " + c) for c in map(chr, range(0x110000)) if c.isalpha())


class Counted:
    """A tokenizer that keeps what it is given."""

    def __init__(self, coder, given):
        self.coder, self.given = coder, given

    def encode_batch_fast(self, said, **more):
        self.given.extend(said)
        return self.coder.encode_batch_fast(said, **more)


def column_ids(coder, texts):
    sizes, found = coder.parts(pa.array(texts, pa.string())).ids(b"\2\0\0\0")
    assert int(sizes.sum()) == len(found)
    return [x.tolist() for x in np.split(found, np.cumsum(sizes)[:-1])] if texts else found.tolist()


def test_a_column_asks_the_library_for_new_chunks_many_at_a_time():
    """One call a new word is most of the work of token files."""
    given, coder = [], chunks.ColumnChunks(BYTE_BPE)
    coder.coder, coder.model = Counted(coder.coder, given), Counted(coder.model, given)
    texts = [" ".join(f"{chr(97 + i)}{chr(97 + k // 26)}{chr(97 + k % 26)}." for k in range(500)) for i in range(4)]
    want = [[*ids(x), 2] for x in texts]
    assert column_ids(coder, texts) == want
    assert len(given) <= 4 + 2000 // chunks.RUN
    given.clear()
    assert column_ids(coder, texts[::-1]) == want[::-1]
    assert sorted(given) == ["aaa.", "baa.", "caa.", "daa."]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.lists(st.sampled_from([*PARTS, *" ab.\n", "x's", "Größe", "don't", "a.b-c", "12"]), max_size=9).map("".join) | st.text(max_size=20), max_size=6), st.sampled_from([2, 7, 1000]))
def test_columns_are_encoded_as_the_library(texts, size):
    """With tables that are empty, filled and turned over."""
    coder = chunks.ColumnChunks(BYTE_BPE, size)
    for some in (texts, texts[::-1], texts):
        assert column_ids(coder, some) == [[*ids(x or ""), 2] for x in some]


def test_letters_are_cut_as_the_librarys_pattern_cuts_them():
    """Python may know letters that the library's pattern does not."""
    texts = [f"so a{c} {c}b" for c in map(chr, range(0x80, 0x110000)) if c.isalpha()]
    coder = chunks.ColumnChunks(BYTE_BPE)
    for a in range(0, len(texts), 20_000):
        some = texts[a : a + 20_000]
        assert column_ids(coder, some) == [[*x.ids, 2] for x in LIBRARY.encode_batch(some, add_special_tokens=False)]


def test_token_files(spark):
    path = new_folder(spark, "tokens")
    token_files.write(docs(spark), BYTE_BPE, 2, path)
    got = sorted((tuple(r) for r in token_files.summary(spark, path).collect()), key=lambda r: r[1])
    coded = {}
    for doc_id, text, *_ in DOCS:
        coded.setdefault(doc_id, []).append([*ids(text or ""), 2])
    start = 0
    for doc_id, at, n, crc in got:
        assert at == start
        start += n
        match = next(x for x in coded[doc_id] if zlib.crc32(np.array(x, "<u4").tobytes()) == crc)
        assert len(match) == n
        coded[doc_id].remove(match)
    assert not any(coded.values())
    assert [r[0] for r in got] == sorted((d[0] for d in DOCS), key=lambda x: (x is not None, x))
    plan = token_files.read(spark, path).where("doc_id = 5")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,5)" in plan
    empty = new_folder(spark, "tokens")
    token_files.write(docs(spark, []), BYTE_BPE, 2, empty)
    assert token_files.summary(spark, empty).count() == 0


def scanned(df):
    """Rows that the scan of a query gave on."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    return plan.collectLeaves().head().metrics().apply("numOutputRows").value()


def test_filters_skip_stripes_and_row_groups(spark):
    path = new_folder(spark, "tokens")
    r, rows = random.Random(1), 20_000
    data = [(2 * i, " ".join(r.choice(["one", "two", "three", "four"]) for _ in range(12)), "", "", 0) for i in range(rows)]
    token_files.write(docs(spark, data).coalesce(1), BYTE_BPE, 2, path, stripe_bytes=64 << 10)
    files = sorted(Path(path.removeprefix("file://")).glob("*.orc"))
    stripes = [orc.ORCFile(f).nstripes for f in files]
    assert max(stripes) > 1
    table = token_files.read(spark, path)
    assert scanned(table.select("doc_id", "n_tokens")) == rows
    # An id in the ranges of the indexes: one group of rows is read; ids between two documents: the Bloom filters rule all out.
    assert 0 < scanned(table.where("doc_id = 20000").select("doc_id", "n_tokens")) <= 1000
    assert scanned(table.where("doc_id = 20001").select("doc_id", "n_tokens")) <= 1000
    assert scanned(table.where("doc_id > 10000000").select("doc_id", "n_tokens")) == 0
    # Stripes of one file go to several tasks.
    one = max(files, key=lambda f: f.stat().st_size)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(one.stat().st_size // 3))
    try:
        assert token_files.read(spark, f"file://{one}").select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def counted_text(text):
    return edit_counts.CountedText(text, COUNTER, *edit_counts.leaves_of(text, COUNTER))


@pytest.mark.parametrize("seed", range(8))
def test_counts_follow_edits(seed):
    r = random.Random(seed)
    for _ in range(40):
        counted = counted_text("".join(r.choice(PARTS) for _ in range(r.choice([0, 5, 200, 900]))))
        assert counted.tree.total == len(ids(counted.text))
        for _ in range(5):
            counted.edit(r.randrange(-2, len(counted.text) + 3), r.choice([0, 1, 40]), "".join(r.choice(PARTS) for _ in range(r.choice([0, 2, 50]))))
            assert counted.tree.total == len(ids(counted.text))
            assert sum(counted.tree.leaves()[0]) == len(counted.text)


def test_trees_of_a_column_ask_the_library_for_new_chunks_many_at_a_time():
    counter = edit_counts.Counter(BYTE_BPE)
    counter.columns, given = chunks.ColumnChunks(BYTE_BPE), []
    counter.columns.coder, counter.columns.model, counter.model = Counted(counter.columns.coder, given), Counted(counter.columns.model, given), None
    texts = [" ".join(f"{chr(97 + i)}{chr(97 + k // 26)}{chr(97 + k % 26)}." for k in range(500)) for i in range(4)]
    made = edit_counts.leaves_of_column(pa.array(texts), counter)
    assert len(given) <= 4 + 2000 // chunks.RUN
    for text, chars, tokens in zip(texts, *made):
        assert sum(chars) == len(text) and sum(tokens) == len(ids(text)) and len(chars) == len(tokens) == 16


@pytest.mark.parametrize("seed", range(4))
def test_counts_follow_edits_of_trees_made_by_columns(seed):
    r = random.Random(seed)
    said = [None, "", *("".join(r.choice([*PARTS, "so ", "be, "]) for _ in range(r.choice([1, 5, 200, 900]))) for _ in range(20)), *(" ".join(r.choice(["so", "it's", "Größe,", "<|endoftext|>", "x\ny", "漢字"]) for _ in range(r.choice([2, 31, 65, 700]))) for _ in range(20))]
    for text, chars, tokens in zip(said, *edit_counts.leaves_of_column(pa.array(said, pa.string()), COUNTER)):
        counted = edit_counts.CountedText(text or "", COUNTER, chars, tokens)
        assert counted.tree.total == len(ids(counted.text)) and sum(chars) == len(counted.text)
        for _ in range(5):
            counted.edit(r.randrange(-2, len(counted.text) + 3), r.choice([0, 1, 40]), "".join(r.choice(PARTS) for _ in range(r.choice([0, 2, 50]))))
            assert counted.tree.total == len(ids(counted.text))
            assert sum(counted.tree.leaves()[0]) == len(counted.text)


def test_names_made_and_broken_by_edits():
    before = "a few words here and there " * 20
    counted = counted_text(before + "<|endof" + "text|> and more " * 3)
    for at, removed, said in ((len(before) + 7, 0, ""), (len(before) + 3, 1, "e"), (len(before), 1, ""), (len(before), 0, "<"), (len(before) + 5, 4, ""), (0, 0, "<|endoftext|>"), (1, 0, "|")):
        counted.edit(at, removed, said)
        assert counted.tree.total == len(ids(counted.text))
    counted = counted_text("see <|endoftext|> here")
    assert counted.tree.total == 4


def test_an_edit_encodes_a_small_part_and_keeps_the_tree():
    counted = counted_text("some plain words in a row. " * 4000)
    tree = counted.tree
    for k in range(50):
        counted.edit(50_000 + k, 3, "xyz and a word more")
    assert counted.tree is tree
    assert counted.encoded < 50 * 2500
    assert tree.total == len(ids(counted.text))


def test_batches_of_edits_on_a_kept_table(spark):
    """What a batch has encoded follows its edits, not the corpus; tables after batches are those built anew."""
    said = [(i, "some plain words in a row, and more of them. " * 300, "en", "a", 0) for i in range(20)]
    kept = written(edit_counts.built(docs(spark, DOCS + [(100 + i, *rest) for i, *rest in said]).withColumnRenamed("lang", "n_tokens_after"), BYTE_BPE), "trees")
    edits = [(3, 1, 0, 0, "new "), (3, 2, 4, None, None), (4, 1, None, 10**9, "all gone"), (5, 1, 9, 2, "x"), (999, 1, 0, 0, "no such"), (None, 1, 0, 0, "nor such"), (105, 1, 5000, 10, "changed"), (106, 1, 100, 0, "put in")]
    edits = spark.createDataFrame(edits, "doc_id long, seq int, start long, removed long, inserted string")
    after = written(edit_counts.edited(edit_counts.with_edits(kept, edits), BYTE_BPE), "edited")
    assert sorted(r["doc_id"] for r in after.collect()) == [3, 4, 5, 5, 105, 106]
    by_id = {r["doc_id"]: r for r in after.collect()}
    assert by_id[3]["text"] == "new one two three one two three" and by_id[4]["text"] == "all gone"
    assert all(r["n_tokens_after"] == len(ids(r["text"])) and r["n_chars_after"] == len(r["text"]) for r in after.collect())
    assert by_id[105]["n_encoded"] + by_id[106]["n_encoded"] < 3000 < by_id[105]["n_chars_after"]
    new = written(edit_counts.updated(kept.drop("n_tokens_after"), after), "trees")
    rows = new.collect()
    assert len(rows) == len(DOCS) + 20
    assert all(r["n_tokens"] == sum(r["leaf_tokens"]) == len(ids(r["text"] or "")) and sum(r["leaf_chars"]) == len(r["text"] or "") for r in rows)
    assert edit_counts.edited(edit_counts.with_edits(edit_counts.built(docs(spark, []), BYTE_BPE), edits), BYTE_BPE).count() == 0


def test_query_is_the_library(spark, sf):
    found = {r["doc_id"]: r for r in QUERIES["op7_edit_counts"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(found)
    for doc_id, text in rows:
        text = text or ""
        half, quarter = len(text) // 2, len(text) // 4
        once = text[:half] + " (see the note of 2024-02-01) " + text[half:]
        twice = once[:quarter] + "changed here," + once[quarter + 24 :]
        assert (found[doc_id]["n_tokens"], found[doc_id]["n_tokens_after"], found[doc_id]["n_chars_after"]) == (len(ids(text)), len(ids(twice)), len(twice))
