"""Neighbours, URLs, line quality and the pipeline."""

import subprocess
import sys
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recallspark.llm import line_crf, neighbours, urls
from recallspark.llm.queries import QUERIES, URL_RULES
from tests.llm.helpers import docs


def plain_nearest(rows, query_ids, k):
    usable = {}
    for i, x in rows:
        if i is not None and x and all(p is not None and np.isfinite(p) for p in x) and any(x):
            usable.setdefault(i, []).append(np.array(x, dtype=float))
    out = {}
    for q in query_ids:
        if q in usable:
            a = usable[q][0]
            scores = {i: max(float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) for b in found) for i, found in usable.items() if i != q}
            out[q] = sorted(scores.items(), key=lambda s: (-round(s[1], 9), s[0]))[:k]
    return out


def test_recall_against_brute_force(spark):
    d = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    got = QUERIES["op2_neighbours"](spark, d).collect()
    want = plain_nearest(rows, [i for i, _ in rows if i % 50 == 0], 5)
    found = {}
    for r in got:
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert found.keys() == want.keys()
    assert all(sorted(x) == [1, 2, 3, 4, 5] for x in found.values())
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in found[q].values()}) for q in want)
    assert hits >= 0.9 * 5 * len(want)


def test_odd_vectors_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0]), (1, [2.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [nan, 1.0, 0.0]), (7, [1.0, None, 0.0]), (8, [inf, 0.0, 0.0]), (9, []), (None, [1.0, 0.0, 0.0]), (50, [-1e-200, 0.0, 0.0])]
    df = spark.createDataFrame([(i, x, "r") for i, x in rows], "vec_id long, embedding array<double>, rank string")
    got = neighbours.search(df, df.where("vec_id % 50 = 0"), 5).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got) == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.0), (0, 4, 50, -1.0), (50, 1, 3, 0.0), (50, 2, 0, -1.0), (50, 3, 1, -1.0), (50, 4, 2, -1.0)]
    assert neighbours.search(df.where("false"), df.where("false"), 5).count() == 0


def test_lengths_copies_and_repeated_ids(spark):
    r = np.random.default_rng(8)
    good = [(i, r.normal(size=3).tolist()) for i in range(20)]
    one = spark.createDataFrame([*good, (20, [1.0, 2.0, 3.0, 4.0])], "vec_id long, embedding array<double>")
    got = neighbours.search(one, one.where("vec_id = 0"), 5).collect()
    assert [(x["rank"], x["vec_id"]) for x in sorted(got)] == [(k, i) for k, (i, _) in enumerate(plain_nearest(good, [0], 5)[0], 1)]
    assert neighbours.search(one, one, 5, dim=4).count() == 0
    # One id many times near the query, and one vector under more ids than there are places.
    near, same = [(100, [1.0, 0.001 * i, 0.0]) for i in range(20)], [(200 + i, [1.0, 0.5, 0.0]) for i in range(30)]
    rows = [(50, [1.0, 0.0, 0.0]), *near, *same, (300, [1.0, 0.4, 0.0])]
    df = spark.createDataFrame([*rows, *rows], "vec_id long, embedding array<double>")
    got = neighbours.search(df, df.where("vec_id % 50 = 0"), 5).collect()
    found = {}
    for x in sorted(got):
        found.setdefault(x["query_id"], []).append(x["vec_id"])
    assert found == {q: [i for i, _ in hits] for q, hits in plain_nearest(rows, [50, 100, 200, 300], 5).items()}


def test_bucket_counts_follow_rows():
    for rows in (100, 2000, 10_000, 50_000, 10**9):
        axes = neighbours.widths(64, rows)
        assert neighbours.buckets_of(axes) >= min(128, rows / neighbours.ROWS_A_BUCKET)
    share = lambda rows: neighbours.probes_for(b := neighbours.buckets_of(neighbours.widths(64, rows))) / b
    assert share(2000) > share(50_000) > share(10**7) > share(10**9)


def test_probes_are_the_largest_sums():
    x = neighbours.unit(np.random.default_rng(2).normal(size=(7, 16)))
    axes, signs = [16, 4], neighbours.turns(16, 2, 3)
    first, second = (neighbours.signed_axes(neighbours.turned(x, by), w) for w, by in zip(axes, signs))
    sums = (first[:, :, None] + second[:, None, :]).reshape(7, -1)
    assert (np.sort(neighbours.probed(x, axes, signs, 9), axis=1) == np.sort(np.argsort(-sums, axis=1)[:, :9], axis=1)).all()
    assert (neighbours.probed(x, axes, signs, 1)[:, 0] == neighbours.own_bucket(x, axes, signs)).all()


@pytest.mark.parametrize("probes", [1, 2, 7, 50, 400, 5000])
def test_probes_of_three_hashes(probes):
    x = neighbours.unit(np.random.default_rng(4).normal(size=(5, 16)))
    axes, signs = [16, 8, 2], neighbours.turns(16, 3, 1)
    sums, code = np.zeros((5, 1)), np.zeros(1, np.int64)
    for width, by in zip(axes, signs):
        near = neighbours.signed_axes(neighbours.turned(x, by), width)
        sums, code = (sums[:, :, None] + near[:, None, :]).reshape(5, -1), (code[:, None] * 2 * width + np.arange(2 * width)).ravel()
    got = neighbours.probed(x, axes, signs, probes)
    assert got.shape == (5, min(probes, 2048))
    assert (np.sort(got, axis=1) == np.sort(code[np.argsort(-sums, axis=1)[:, :probes]], axis=1)).all()


def test_memory_of_probing_is_bounded():
    axes = neighbours.widths(64, 3 * 10**7)
    probes = neighbours.probes_for(neighbours.buckets_of(axes))
    x, signs = neighbours.unit(np.random.default_rng(5).normal(size=(256, 64))), neighbours.turns(64, len(axes), 0)
    tracemalloc.start()
    got = neighbours.probed(x, axes, signs, probes)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert got.shape == (256, probes)
    assert peak < 100 << 20


def clustered(n, seed=12):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(40, 32))
    return (centres[r.integers(0, 40, n)] + 0.3 * r.normal(size=(n, 32))).astype(np.float32)


def test_recall_on_clusters_and_in_rounds(spark, monkeypatch):
    x = clustered(6000)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    asked = np.arange(0, 6000, 50)
    score = u[asked] @ u.T
    score[np.arange(len(asked)), asked] = -2
    want = {q: set(np.argsort(-s, kind="stable")[:5].tolist()) for q, s in zip(asked.tolist(), score)}
    once = neighbours.search(df, df.where("vec_id % 50 = 0"), 5).collect()
    assert sum(r["vec_id"] in want[r["query_id"]] for r in once) >= 0.9 * 5 * len(want)
    monkeypatch.setattr(neighbours, "BYTES_A_ROUND", 4 * 32 * 50)
    monkeypatch.setattr(neighbours, "BYTES_A_SLICE", 4 * 32 * 500)
    assert sorted(neighbours.search(df, df.where("vec_id % 50 = 0"), 5).collect()) == sorted(once)


def test_vectors_of_one_id_in_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BYTES_A_ROUND", 4 * 3 * 2)
    r = np.random.default_rng(6)
    rows = [(i % 12 * 10, r.normal(size=3).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for x in neighbours.search(df, df.where("vec_id % 50 = 0"), 4).collect():
        got.setdefault(x["query_id"], {})[x["rank"]] = x["vec_id"]
    want = {}
    for q in (0, 50, 100):
        best = {}
        for a in (np.array(v) for i, v in rows if i == q):
            for i, v in rows:
                if i != q:
                    best[i] = max(best.get(i, -2), float(a @ np.array(v) / (np.linalg.norm(a) * np.linalg.norm(v))))
        want[q] = dict(enumerate([i for i, _ in sorted(best.items(), key=lambda s: (-s[1], s[0]))[:4]], 1))
    assert got == want


def test_vectors_of_queries_are_not_shuffled(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(clustered(300).tolist())], "id long, vec array<double>")
    axes = neighbours.widths(32, 300)
    units = neighbours._units(rows, 32)
    asked = neighbours._asked(units, 32, axes, 2, 3)
    assert asked.columns == ["table", "part", "q", "probes"]
    index = neighbours._indexed(rows, 32, axes, 2).select("id", "unit", F.posexplode("buckets").alias("table", "bucket")).withColumn("part", F.floor(F.col("bucket") / neighbours.SPAN))
    plan = neighbours._found(index, asked, units, 32, 5)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    join = next(i for i, line in enumerate(lines) if "BroadcastHashJoin [q#" in line)
    assert not any("Exchange" in line and "unit" in line for line in lines[join:] if "Broadcast" not in line)
    after = lines[lines.index(next(line for line in lines if "FlatMapCoGroups" in line)) + 1 : join]
    assert sum("Exchange hashpartitioning" in line for line in after) == 1  # the index's own


def test_exact_ties_of_multiples(spark):
    v = [0.3, 0.7, -0.11]
    rows = [(0, [0.2, 0.9, 0.4]), *((i, [x * 2.0**e for x in v]) for i, e in ((1, 0), (2, 900), (3, -900), (4, 1)))]
    got = neighbours.search(df := spark.createDataFrame(rows, "vec_id long, embedding array<double>"), df.where("vec_id = 0"), 4).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(got)] == [(1, 1), (2, 2), (3, 3), (4, 4)]
    assert len({r["score"] for r in got}) == 1


URLS = [None, "", "no scheme", "http://Example.NET", "http://x.net/a?b", "https://m.example.net/en/1#t", "http://example.com/de/x", "http://a.b.example.com/de/", "http://example.com/den", "http://fr.org/fr/", "http://org/fr/9", "http://xorg/fr/9", "x://y.net/p://q", "http://u\n.net/a\nb?c", "http://notexample.com/de/", "http://net/"]


def plain_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate([*URLS, URLS[4]])], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judged(df, urls.rule_table(spark, URL_RULES)).collect()}
    assert got == {i: plain_verdict(u) for i, u in enumerate([*URLS, URLS[4]])}
    assert urls.judged(df.where("false"), urls.rule_table(spark, URL_RULES)).count() == 0
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert {r["verdict"] for r in urls.judged(df, none).collect()} == {"allow"}


def test_bloom_has_no_false_misses(spark):
    keys = [f"h{i}.net/p{i}" for i in range(3000)]
    lines = urls.bloom(spark.createDataFrame([(k,) for k in keys], "key string"))
    assert urls.may_hold(lines, [k.encode() for k in keys]).all()
    assert urls.may_hold(lines, [f"no{i}.org/".encode() for i in range(3000)]).mean() < 0.05


def test_marginals_are_those_of_all_label_chains():
    r = np.random.default_rng(3)
    chain = line_crf.Chain(np.zeros(3), r.normal(size=(2, 2)))
    score = r.normal(size=(1, 6)) * 2
    good, pairs, logs = chain.marginals(score, np.ones((1, 6), dtype=bool))
    total, on = 0.0, np.zeros(6)
    for number in range(64):
        y = [number >> t & 1 for t in range(6)]
        weight = np.exp(sum(score[0, t] * y[t] for t in range(6)) + sum(chain.steps[y[t], y[t + 1]] for t in range(5)))
        total += weight
        on += weight * np.array(y)
    assert good[0] == pytest.approx(on / total)
    assert logs[0] == pytest.approx(np.log(total))
    assert pairs.sum() == pytest.approx(5)


def plain_quality(text, chain):
    """Forward-backward over one document's lines, in plain Python."""
    lines = line_crf.Lines(text)
    x, w = [lines.looks(i, i + 1)[0] for i in range(-1, len(lines) + 1)], chain.weights.reshape(3, -1)
    score = [float(x[i + 1] @ w[0] + x[i] @ w[1] + x[i + 2] @ w[2]) for i in range(len(lines))]
    step = np.exp(chain.steps)
    forward = [np.array([1.0, np.exp(score[0])])]
    for v in score[1:]:
        forward.append(forward[-1] @ step * [1.0, np.exp(v)])
        forward[-1] /= forward[-1].sum()
    back, good = np.ones(2), []
    for t in range(len(score) - 1, -1, -1):
        both = forward[t] * back
        good.append(both[1] / both.sum())
        back = step @ (back * [1.0, np.exp(score[t])])
        back /= back.sum()
    mean = float(np.dot(good[::-1], lines.sizes()) / lines.sizes().sum())
    return float(chain.turned(np.array([mean]))[0])


def test_scores_of_documents_are_plain_ones():
    r = np.random.default_rng(4)
    chain = line_crf.Chain(r.normal(size=3 * line_crf.LOOKS), r.normal(size=(2, 2)), (1.3, -0.2))
    words = ["Ab", "cd", "!!", "#x", "77", "lorem"]
    said = ["", "\n", *("\n".join(" ".join(r.choice(words, r.integers(0, 9))) for _ in range(r.integers(1, 60))) for _ in range(40))]
    assert chain.qualities(said) == pytest.approx([plain_quality(t, chain) for t in said])
    assert [chain.qualities([t])[0] for t in said] == pytest.approx([plain_quality(t, chain) for t in said])
    assert chain.qualities(said[::-1]) == pytest.approx(chain.qualities(said)[::-1])


def test_groups_are_bounded():
    sizes = [1] * 40 + [30, 70_000, 5, 900]
    found = list(line_crf.groups(sizes, 1000))
    assert sorted(i for part in found for i in part) == list(range(len(sizes)))
    assert all(len(part) == 1 or len(part) * max(sizes[i] for i in part) <= 1000 for part in found)
    assert line_crf.runs(10) == [(0, 10)]
    assert line_crf.runs(10**6)[0] == (0, 250) and line_crf.runs(10**6)[-1] == (10**6 - 250, 10**6) and len(line_crf.runs(10**6)) == 8


def test_a_million_line_feeds(spark):
    """One text of very many lines beside short ones, scored and learned from in little memory."""
    code = "import resource, numpy as np; from recallspark.llm import line_crf as l; c = l.Chain(np.full(3 * l.LOOKS, 0.1), np.zeros((2, 2))); base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; x = c.qualities([chr(10) * 1_000_000, *['some short text'] * 31]); assert ((0 <= x) & (x <= 1)).all(); print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)"
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(line_crf.__file__).parents[2])
    assert int(said.stdout) < 500
    rows = [(4, "\n" * 50_000, "", "", 0), *[(4, "same id again", "", "", 0)] * 50, (8, "good words here", "", "", 0)]
    labels = spark.createDataFrame([(4, 0, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    scores = line_crf.scored(docs(spark, rows), line_crf.learned(docs(spark, rows), labels)).collect()
    assert len(scores) == 52


def test_held_out_quality(spark):
    d = "/root/testdata/sf0.1"
    found = QUERIES["op10_line_crf"](spark, d)
    rows = found.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.96 * len(rows)
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.98


def test_odd_rows_are_scored(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = line_crf.scored(docs(spark), line_crf.learned(docs(spark), none)).collect()
    assert len(rows) == 12 and all(0 <= r["score"] <= 1 for r in rows)
    one = spark.createDataFrame([(4, 1, 0), (None, 0, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    assert line_crf.scored(docs(spark, []), line_crf.learned(docs(spark), one)).count() == 0


def test_pipeline_stages(spark, sf):
    docs_ = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs_.columns, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs_, sf)
        assert out.columns == columns, name
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert before is None or ids <= before
        before, docs_ = ids, out
    last = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in last.collect()} == before
