"""Bit-sliced search, collocations and periodic runs against plain Python and SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from recallspark.llm import bit_slices, periods, phrases, queries
from recallspark.llm.rows import ROWS_A_BATCH
from recallspark.session import written
from tests.llm.helpers import DOCS, SCHEMA, WORD, docs, rows_of

VECTORS = "other string, vec_id long, embedding array<double>, score string"


def vectors(spark, rows):
    return spark.createDataFrame([("x", i, v, "y") for i, v in rows], VECTORS)


LIMIT = (1 << 63) - 1


def plain_top(rows, asked, k):
    """By rows: the same rows in the same order, each query against all others of its length."""
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and abs(x) < 2.0**43 for x in v)]
    out = []
    for a, (i, q) in enumerate(fine):
        if asked(i):
            scores = sorted((-max(-LIMIT, min(LIMIT, sum(x * y for x, y in zip(q, v)))), j) for b, (j, v) in enumerate(fine) if b != a and len(v) == len(q))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 5, 40])
def test_top_is_brute_force(spark, k):
    rng = random.Random(k)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(7)]) for i in range(150)]
    rows += [(i, [0.5] * 7) for i in range(200, 330)]  # ties beyond what is resolved early
    rows += [(500 + i, [float(rng.randint(-3, 3)), -1.0]) for i in range(20)]
    rows += [(0, [0.25] * 7), (0, [0.25] * 7), (10, [1e12, -1e12, 0.0, 3.0, 4.0, 5.0, 6.0]), (11, [1e6, -1e6, 0.0, 3.0, 4.0, 5.0, 6.0]), (600, []), (610, []), (620, [0.0] * 7), (None, [1.0] * 7)]
    rows += [(630, None), (640, [math.nan] * 7), (650, [math.inf] * 7), (660, [None] + [1.0] * 6)]
    got = bit_slices.top(vectors(spark, rows).repartition(3), F.col("vec_id") % 10 == 0, k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == plain_top(rows, lambda i: i % 10 == 0, k)


def test_top_of_nothing(spark):
    assert bit_slices.top(vectors(spark, []), F.col("vec_id") % 10 == 0).collect() == []
    assert bit_slices.top(vectors(spark, [(0, [1.0])]), F.col("vec_id") % 10 == 0).collect() == []
    assert bit_slices.top(vectors(spark, [(1, [1.0]), (2, [2.0])]), F.col("vec_id") % 10 == 0).collect() == []


def test_groups_and_blocks_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(bit_slices, "COMPONENTS", 100)
    monkeypatch.setattr(bit_slices, "SENT", 1)
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(120)]
    got = bit_slices.top(vectors(spark, rows), F.col("vec_id") % 3 == 0, 4)
    assert sorted(map(tuple, got.collect())) == plain_top(rows, lambda i: i % 3 == 0, 4)


def test_slices_add_up():
    rng = np.random.default_rng(5)
    values = rng.integers(-300, 300, (130, 6))
    block = bit_slices.Block(*bit_slices.Block.sliced(values), 130)
    query = rng.integers(-300, 300, 6)
    slices, base = block.scores(query)
    bit = np.unpackbits(slices.view(np.uint8), axis=1, bitorder="little")[:, :130].astype(np.int64)
    assert ((bit << np.arange(len(slices))[:, None]).sum(axis=0) + base).tolist() == (values @ query).tolist()


def plain_phrases(rows, least, longest=4, first=2000):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    out = []
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            score, k = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            held = any(100 * b >= 80 * a for (x, q), b in f.items() if x == lang and b >= least and len(p) < len(q) and any(q[i : i + len(p)] == p for i in range(len(q))))
            if not held:
                out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    out.sort()
    place = Counter()
    for lang, score, a, p, l, r in out:  # noqa: E741
        place[lang] += 1
        if place[lang] <= first:
            yield lang, place[lang], p.decode(), -a, l, r, n[lang], -score


def odd_texts(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(80):
        words = [rng.choice(["Alpha", "beta", "gamma", "é", "漢", "a\x01", "a", "the", "\x0fx"]) for _ in range(rng.randint(0, 60))]
        rows.append((rng.choice(["en", None, "und"]), "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", "\n", "\x0b", "\xa0"]) for w in words)))
    return rows + [(None, None), ("fr", ""), ("en", "the same of it " * 400), ("de", "x" * 5000)]


@pytest.mark.parametrize("shard", [7, 1 << 20])
def test_phrases_are_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(phrases, "SHARD", shard)
    rows = odd_texts(3)
    df = spark.createDataFrame([(t, x, "c", 1) for x, t in rows], "text string, lang string, path string, n long").repartition(3)
    for least, first in ((3, 2000), (8, 4)):
        got = phrases.collocations(df, least, first=first)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == sorted(plain_phrases(rows, least, first=first))


def test_shards_are_read_and_sent_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD", 1 << 12)
    monkeypatch.setitem(phrases.AS_WRITTEN, "parquet.block.size", str(64 << 10))
    rows = [("en", " ".join(str(a * i % 9973) for i in range(4000))) for a in range(1, 41)]
    shards = written(phrases._shards(spark.createDataFrame(rows, "lang string, text string").coalesce(1), "lang", "text", 4), "shards", **phrases.AS_WRITTEN)
    files = [pq.ParquetFile(f.removeprefix("file://")) for f in shards.inputFiles()]
    groups = [f.metadata.row_group(i).num_rows for f in files for i in range(f.num_row_groups)]
    assert sum(groups) == 20 and max(groups) <= 3
    sent = phrases._each(shards, ["ids"], "n int", lambda ids: iter([pa.RecordBatch.from_pydict({"n": pa.array([len(ids)], pa.int32())})]))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1"
    assert sent.agg(F.sum("n")).head()[0] == 4 * (40 * 4000 + 40)
    phrases.collocations(shards.select("lang", F.lit("a b").alias("text")), 2).collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == str(ROWS_A_BATCH)


def test_phrases_of_nothing(spark):
    assert phrases.collocations(docs(spark, [])).collect() == []
    assert phrases.collocations(docs(spark, [(1, None, None, None, 0), (2, "a b c", "en", "x", 3)])).collect() == []


def plain_runs(w, shortest=24):
    out = {}
    for q in range(1, len(w) // 3 + 1):
        s = 0
        while s + q < len(w):
            if w[s] != w[s + q]:
                s += 1
                continue
            e = s
            while e + q < len(w) and w[e] == w[e + q]:
                e += 1
            if e + q - s >= max(shortest, 3 * q):
                out.setdefault((s, e + q - s), q)
            s = e + 1
    return sorted([(s, n, q) for (s, n), q in out.items()], key=lambda r: (r[0], r[2]))


def repeating(seed):
    rng = random.Random(seed)
    w = [rng.randrange(rng.choice([1, 2, 3, 40])) for _ in range(rng.randint(0, 150))]
    for _ in range(rng.randint(0, 3)):
        if len(w) > 30:
            a, p = rng.randrange(len(w)), rng.randint(1, 12)
            for i in range(a + p, min(len(w), a + rng.randint(p, 70))):
                w[i] = w[i - p]
    return w


def test_runs_are_brute_force():
    texts = [repeating(i) for i in range(200)]
    assert periods.runs_of([np.array(w, np.int64) for w in texts]) == [plain_runs(w) for w in texts]


def test_runs_with_few_pairs_at_a_time(monkeypatch):
    monkeypatch.setattr(periods, "PAIRS", 5)
    texts = [repeating(i) for i in range(40)]
    assert periods.runs_of([np.array(w, np.int64) for w in texts]) == [plain_runs(w) for w in texts]


def test_hashes_that_tell_lies_are_found_out(monkeypatch):
    told = periods.Hashes.__init__

    def weak(self, ids, attempt):
        told(self, ids if attempt > 2 else ids % 2, attempt)

    monkeypatch.setattr(periods.Hashes, "__init__", weak)
    texts = [repeating(i) for i in range(120)]
    assert periods.runs_of([np.array(w, np.int64) for w in texts]) == [plain_runs(w) for w in texts]


def test_long_texts_take_little_time():
    assert periods.runs_of([np.zeros(300_000, np.int64)]) == [[(0, 300_000, 1)]]
    assert periods.runs_of([np.tile(np.arange(9), 40_000)]) == [[(0, 360_000, 9)]]


def plain_periods(doc_id, text):
    w = WORD.findall(text or "")
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    told = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return doc_id, len(runs), *told, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def test_periods_of_whole_tables(spark, sf):
    got = queries.op13_periods(spark, sf)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [plain_periods(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sum(r[1] for r in want) > 0
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_periods_of_odd_rows(spark, tmp_path):
    rows = [*DOCS, (20, "a b " * 30, "en", "x", 1), (None, "a b " * 30, None, None, None), *[(i, "one two three four five " * 9 + LONG_TAIL, "en", "a", 1) for i in range(100, 140)]]
    spark.createDataFrame(rows, SCHEMA).withColumnRenamed("source", "runs").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in queries.op13_periods(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([plain_periods(r[0], r[1]) for r in rows], key=str)
    found = periods.found(spark.read.parquet(str(tmp_path / "documents.parquet")))
    assert found.columns == ["doc_id", "text", "lang", "n_chars", "n_words", "runs", "best", "collapsed"]
    assert found.where("text is null").select("runs", "best", "collapsed").first() == ([], None, "")
    assert periods.found(docs(spark, [])).collect() == []


LONG_TAIL = " ".join(f"t{i}" for i in range(40))


@pytest.mark.parametrize("name", ["op11_bit_slices", "op12_phrases"])
def test_queries_give_the_rows_of_their_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    df = queries.QUERIES[name](spark, sf)
    said = con.sql(queries.ORACLES[name])
    assert sorted(said.columns) == sorted(df.columns)
    got = rows_of(df)
    assert len(got) > 40 and got == sorted(said.select(*[duckdb.ColumnExpression(c) for c in df.columns]).fetchall())
