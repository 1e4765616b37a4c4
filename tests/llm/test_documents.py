"""Quality rules, near copies, passages and mixing against plain Python."""

import collections
import hashlib
import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from recallspark.llm import mixing, quality, simhash, substrings
from recallspark.llm.queries import QUERIES
from tests.llm.helpers import DOCS, WORD, docs, key, rows_of


def counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, covered = collections.Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_measured(spark):
    names = ["_n_words", "_word_chars", "_n_symbols", "_n_dup_lines", "_n_repeat_words"]
    more = [(20, "a a a a a", "", "", 0), (21, "x y\nx y\n\n \nx y", "", "", 0), (22, "a b \x1c c", "", "", 0), (23, "p q r s p q r p q", "", "", 0)]
    got = rows_of(quality.measured(docs(spark, DOCS + more)).select("doc_id", *names))
    assert got == sorted(((d[0], *counts(d[1])) for d in DOCS + more), key=key)


def plain_em(patterns, n_rules):
    """Expectation-maximisation in plain Python over {votes: n}: share of bad texts, and by rule how often it calls (bad, good) texts bad."""

    def fitted(weights):
        bad, good = sum(b for b, _ in weights.values()), sum(g for _, g in weights.values())
        out = []
        for side, (b, g) in enumerate(quality.BEFORE):
            votes = lambda j, k: sum(w[side] for v, w in weights.items() if v[j] == k)  # noqa: B023, E731
            out.append([(votes(j, 0) + b) / (votes(j, 0) + votes(j, 2) + b + g) for j in range(n_rules)])
        return (bad + 1) / (bad + good + 2), out

    model = fitted({v: (n * (q := (v.count(0) + 0.5) / (v.count(0) + v.count(2) + 1)), n * (1 - q)) for v, n in patterns.items()})
    for _ in range(quality.ROUNDS):
        weights = {v: (n * (1 - (q := plain_posterior(model, v))), n * q) for v, n in patterns.items()}
        model = fitted(weights)
    return model


def plain_posterior(model, votes):
    """Probability that a text of these votes is good."""
    share, (bad, good) = model
    of = {0: lambda b, g: np.log(g / b), 1: lambda b, g: 0.0, 2: lambda b, g: np.log((1 - g) / (1 - b))}
    odds = np.log(1 - share) - np.log(share) + sum(of[v](bad[j], good[j]) for j, v in enumerate(votes))
    return 1 / (1 + np.exp(-odds))


def plain_votes(text):
    """Votes of the ten rules."""
    n, chars, symbols, dup, again = counts(text)
    words = WORD.findall(text or "")
    lines = len([x for x in (text or "").split("\n") if WORD.search(x)])

    def vote(part, whole, low, high, inner, asked=True):
        at = 1000 * part
        if not n or not asked:
            return 1
        return 0 if at < whole * low or at > whole * high else 2 if whole * inner[0] <= at <= whole * inner[1] else 1

    never = 10**9
    said = text or ""
    return (
        vote(symbols, chars, 0, 10, (0, 5)), vote(chars, n, 4500, 5800, (4600, 5600)), vote(said.count("."), n, 45, 140, (50, 120), n >= 20),
        vote(sum("A" <= c <= "Z" for c in said), chars, 0, 300, (0, 100)), vote(said.count("!"), n, 0, 100, (0, 20)), vote(again, n, 0, 80, (0, 20), n >= 20),
        vote(dup, lines, 0, 100, (0, 0), lines >= 4), vote(len(set(words)), n, 620, never, (660, 1000), n >= 20),
        vote(sum(len(w) <= 2 for w in words), n, 50, 270, (60, 250), n >= 20), vote(said.count(","), n, 30, 100, (35, 90), n >= 20),
    )


def test_estimate_is_plain_em(spark):
    r = random.Random(1)
    patterns = {tuple(r.choice([0, 1, 1, 2]) for _ in range(4)): r.randrange(1, 50) for _ in range(20)}
    df = spark.createDataFrame([(list(v), n) for v, n in patterns.items()], "votes array<int>, n long")
    share, chances = quality.estimate(df, 4)
    want, (bad, good) = plain_em(patterns, 4)
    assert share == pytest.approx(want, abs=1e-9)
    assert [list(row) for row in chances] == [pytest.approx([b, g], abs=1e-9) for b, g in zip(bad, good)]


def test_a_noisy_rule_is_outvoted(spark):
    """Four rules that are right in nine of ten votes, and one that is right in every second: its accuracy is found, and it decides nothing."""
    r, rows = random.Random(7), []
    for _ in range(4000):
        bad = r.random() < 0.2
        votes = [(0 if bad else 2) if r.random() < 0.9 else (2 if bad else 0) for _ in range(4)] + [r.choice([0, 2])]
        rows.append((bad, tuple(v if r.random() < 0.9 else 1 for v in votes)))
    patterns = collections.Counter(v for _, v in rows)
    share, chances = quality.estimate(spark.createDataFrame([(list(v), n) for v, n in patterns.items()], "votes array<int>, n long"), 5)
    assert share == pytest.approx(0.2, abs=0.03)
    assert all(b == pytest.approx(0.9, abs=0.05) and g == pytest.approx(0.1, abs=0.03) for b, g in chances[:4])
    noisy = chances[4]
    assert all(c == pytest.approx(0.5, abs=0.06) for c in noisy)
    model = share, list(zip(*chances))
    assert plain_posterior(model, (2, 2, 2, 2, 0)) > 0.99 and plain_posterior(model, (0, 0, 0, 0, 2)) < 0.01 and plain_posterior(model, (0, 2, 2, 2, 2)) > 0.9
    right = sum((plain_posterior(model, v) < 0.5) == bad for bad, v in rows) / len(rows)
    must_pass = sum((0 in v) == bad for bad, v in rows) / len(rows)
    assert right > 0.95 > 0.7 > must_pass


def test_posteriors_and_verdicts_of_documents_are_plain_ones(spark, sf):
    """The whole query against plain Python: votes, estimate, posterior and verdict of every document."""
    said = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    votes = {d: plain_votes(t) for d, t in said.items()}
    model = plain_em(collections.Counter(votes.values()), 10)
    found = {r["doc_id"]: r for r in QUERIES["op5_quality_rules"](spark, sf).collect()}
    assert found.keys() == said.keys()
    for d, t in said.items():
        n, *_, again = counts(t)
        failed, good = n < 50 or 100 * again > 50 * n, plain_posterior(model, votes[d])
        assert found[d]["base_failed"] == failed
        assert found[d]["posterior"] == pytest.approx(good, abs=1e-6)
        assert found[d]["kept"] == (not failed and good >= 0.5)


def test_kept_on_labelled_documents(spark):
    found = QUERIES["op5_quality_rules"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("not base_failed")
    rows = found.collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in rows) >= 0.97 * len(rows)
    clean = [r["kept"] for r in rows if r["quality"] == 1]
    assert sum(clean) >= 0.97 * len(clean)
    # Rejecting whatever some rule votes against would lose many more clean documents.
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    must_pass = [0 not in plain_votes(texts[r["doc_id"]]) for r in rows if r["quality"] == 1]
    assert sum(must_pass) < 0.92 * len(must_pass)


def test_filtered_keeps_columns_and_odd_rows_pass(spark):
    df = docs(spark).withColumnRenamed("lang", "_n_words")
    assert quality.filtered(df).columns == df.columns
    assert quality.filtered(docs(spark, [])).count() == 0


def plain_print(text, shingle):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_op9_is_brute_force_on_a_whole_table(spark):
    """Every row of the query against all pairs of fingerprints that plain Python makes."""
    sf_dir = "/root/testdata/sf0.01"
    said = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    prints = {doc_id: plain_print(text, 3) for doc_id, text in said.items()}
    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], dtype=np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 2
    label = np.arange(len(ids))
    while True:
        least = np.where(near, label[None, :], len(ids)).min(axis=1)
        if (least == label).all():
            break
        label = least
    wanted = [(i, f"{prints[i]:016x}", ids[k]) for i, k in zip(ids, label)]
    got = QUERIES["op9_simhash"](spark, sf_dir).select("doc_id", "fingerprint", "component_id").collect()
    assert len(said) >= 1000 and len(set(label.tolist())) < len(ids)
    assert sorted(map(tuple, got)) == wanted


def test_fingerprints_and_groups(spark):
    got = rows_of(simhash.grouped(docs(spark), shingle=3, blocks=1, radius=2, keys=simhash.exact_keys(2, 1)))
    prints = [(d[0], plain_print(d[1], 3)) for d in DOCS]
    names = []
    for start in range(len(prints)):
        seen, waiting = {start}, [start]
        while waiting:
            i = waiting.pop()
            near = {j for j, p in enumerate(prints) if (p[1] ^ prints[i][1]).bit_count() <= 2} - seen
            seen |= near
            waiting.extend(near)
        names.append(min((prints[j][0] for j in seen if prints[j][0] is not None), default=None))
    want = sorted(((d, p.to_bytes(8, "big"), n) for (d, p), n in zip(prints, names)), key=key)
    assert [(a, bytes(b), c) for a, b, c in got] == want
    assert simhash.grouped(docs(spark, []), shingle=3, blocks=1, radius=2, keys=simhash.exact_keys(2, 1)).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 6])
def test_trees_lose_no_link(radius):
    r = random.Random(radius)
    centres = [r.getrandbits(64) for _ in range(6)]
    values = list({c ^ sum(1 << b for b in r.sample(range(64), r.randrange(0, radius + 2))) for c in centres for _ in range(30)})
    near = [(i, j) for i, j in itertools.combinations(range(len(values)), 2) if (values[i] ^ values[j]).bit_count() <= radius]

    def parts(pairs):
        head = list(range(len(values)))

        def top(i):
            while head[i] != i:
                i = head[i]
            return i

        for i, j in pairs:
            head[max(top(i), top(j))] = min(top(i), top(j))
        return [top(i) for i in range(len(values))]

    words = np.array(values, dtype=np.uint64).reshape(-1, 1)
    for side in (np.zeros(len(values), np.int64), np.array([r.randrange(2) for _ in values])):
        wanted = near if not side.any() else [(i, j) for i, j in near if side[i] != side[j]]
        for found in (simhash.forest_small(values, radius, side.tolist()), simhash.forest(words, radius, side)):
            assert parts(found) == parts(wanted)
            assert all((values[i] ^ values[j]).bit_count() <= radius for i, j in found)
            assert len(found) < len(values)


def test_large_shards_meet_by_halves(spark, monkeypatch):
    """Some thousands of fingerprints against brute force, many of them in shards that are cut into parts."""
    monkeypatch.setattr(simhash, "HALF", 50)
    r = random.Random(9)
    centres = [r.getrandbits(64) for _ in range(400)]
    values = sorted({(c if k else r.getrandbits(64)) ^ sum(1 << b for b in r.sample(range(64), r.randrange(4))) for i, c in enumerate(centres) for k in range(500 if i < 3 else 4)})
    words = np.array(values, dtype=np.uint64)
    head = list(range(len(values)))

    def top(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(words[i + 1 :] ^ words[i]) <= 2) + i + 1:
            a, b = sorted((top(i), top(int(j))))
            head[b] = a
    df = spark.createDataFrame([(i, v.to_bytes(8, "big")) for i, v in enumerate(values)], "rep long, fp binary")
    got = {x["id"]: x["component"] for x in simhash.components(simhash._links(simhash._sharded(df, simhash.exact_keys(2, 1)), 2)).collect()}
    assert [got.get(i, i) for i in range(len(values))] == [top(i) for i in range(len(values))]


def test_tree_search_follows_few_edges():
    """What a search meets grows far slower than the shard."""
    r = np.random.default_rng(3)
    met = []
    for n in (2000, 16000):
        words = r.integers(0, 1 << 64, (n, 1), np.uint64)
        tree = simhash.BKTree(int(words[0, 0]), 0)
        for i, w in enumerate(words[1:, 0].tolist(), 1):
            tree.add(w, i)
        count, waiting = 0, [tree.root]
        while waiting:
            stands, _, children = waiting.pop()
            count += 1
            d = (stands ^ int(words[7, 0])).bit_count()
            waiting.extend(child for edge, child in children.items() if d - 2 <= edge <= d + 2)
        met.append(count)
    assert met[1] < 6 * met[0] and met[1] < 16000 / 2


def test_keys_of_near_prints_meet():
    r = random.Random(4)
    for _ in range(300):
        a = r.getrandbits(64)
        b = a ^ sum(1 << x for x in r.sample(range(64), 2))
        same = lambda places: all((a >> (63 - p) & 1) == (b >> (63 - p) & 1) for p in places)
        assert any(map(same, simhash.exact_keys(2, 1)))


def test_thinned_keeps_one_of_each_group(spark):
    r = random.Random(2)
    base = [f"t{r.randrange(10**6)}" for _ in range(300)]
    near = [w if i not in (40, 200) else "other" for i, w in enumerate(base)]
    rows = [(3, " ".join(base)), (1, " ".join(near)), (2, " ".join(base)), (2, " ".join(base)), (4, " ".join(r.sample(base, 300))), (None, " ".join(near)), (None, "alone here"), (5, None)]
    df = spark.createDataFrame([(a, b, "x", "y", 1, 5) for a, b in rows], "doc_id long, text string, _k string, _h string, _n int, sid int")
    kept = simhash.thinned(df)
    assert kept.columns == df.columns
    assert {tuple(x)[2:] for x in kept.collect()} == {("x", "y", 1, 5)}
    assert [x[0] for x in sorted((tuple(r) for r in kept.collect()), key=key)] == [None, 1, 4, 5]


def five_words(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def planted(r, base, wanted):
    """A text whose sets of five-word shingles has about the wanted similarity with that of ``base``."""
    words, places = list(base), list(range(len(base)))
    r.shuffle(places)
    while jaccard(five_words(" ".join(base)), five_words(" ".join(words))) > wanted:
        words[places.pop()] = f"x{r.randrange(10**6)}"
    return " ".join(words)


def test_thinned_is_brute_force_by_shingles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    r, said = random.Random(11), []
    for size in (12, 40, 150, 600):
        for wanted in (0.6, 0.65, 0.7, 0.75, 0.78, 0.8, 0.82, 0.85, 0.9):
            for _ in range(6):
                base = [f"w{r.randrange(10**6)}" for _ in range(size)]
                said += [" ".join(base), planted(r, base, wanted)]
    # Chains within a group larger than a block, and a text whose repeats change its counts of shingles alone.
    base = [f"c{r.randrange(10**6)}" for _ in range(80)]
    said += [" ".join(base[i : i + 60]) for i in range(20)] + [planted(r, base, 0.7) for _ in range(20)]
    said += [" ".join(base[:7] * 2 + base[20:40]), " ".join(base[:7] * 40 + base[20:40])]
    sets, head = [five_words(t) for t in said], list(range(len(said)))

    def top(i):
        while head[i] != i:
            i = head[i]
        return i

    for i, j in itertools.combinations(range(len(said)), 2):
        if jaccard(sets[i], sets[j]) >= 0.8:
            a, b = sorted((top(i), top(j)))
            head[b] = a
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(said)]
    assert sorted(x[0] for x in simhash.thinned(docs(spark, rows)).select("doc_id").collect()) == [i for i in range(len(head)) if head[i] == i]
    assert sorted((x[0], x[1]) for x in simhash.near_copies(docs(spark, rows)).select("doc_id", "component_id").collect()) == [(i, top(i)) for i in range(len(said))]


def plain_cut(rows, window):
    seen = {}
    for doc_id, text, *_ in rows:
        words = (text or "").encode().split()
        for i in range(len(words) - window + 1):
            k = tuple(words[i : i + window])
            low = doc_id if doc_id is not None else -(1 << 63)
            seen[k] = min(low, seen.get(k, low))
    out = []
    for doc_id, text, *_ in rows:
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - window + 1):
            if seen[tuple(words[i : i + window])] < (doc_id if doc_id is not None else -(1 << 63)):
                gone |= set(range(i, i + window))
        out.append((doc_id, len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    return sorted(out, key=key)


def test_removed_words(spark):
    assert rows_of(substrings.removed_words(docs(spark).select("doc_id", "text")).drop("text")) == plain_cut(DOCS, 50)
    assert substrings.removed_words(docs(spark, [])).count() == 0


@pytest.mark.parametrize("window", [6, 7, 50])
def test_removed_words_of_many_overlaps(spark, window):
    r = random.Random(window)
    pieces = [[r.choice("ab") for _ in range(r.randrange(window // 2, 2 * window))] for _ in range(8)]
    rows = [(r.randrange(40) if r.random() > 0.1 else None, " ".join(w for _ in range(r.randrange(0, 4)) for w in r.choice(pieces)), "", "", 0) for _ in range(60)]
    assert rows_of(substrings.removed_words(docs(spark, rows).select("doc_id", "text"), window, start=2).drop("text")) == plain_cut(rows, window)


def test_removed_words_of_many_rows_of_one_id(spark):
    """Thousands of rows without an id or with one id: no list that is told to a row is longer than its text."""
    r = random.Random(3)
    shared = [f"s{i}" for i in range(60)]
    longest, real = [], substrings.batches

    def seen(df, *args):
        for column in {"own", "dead", "keeps"} & set(df.columns):
            longest.append(df.agg(F.max(F.size(column))).first()[0] or 0)
        return real(df, *args)

    rows = []
    for doc_id in (None, 5):
        rows += [(doc_id, " ".join([f"{doc_id}-{n}-{i}" for i in range(55)] + (shared if n % 3 == 0 else [])), "", "", 0) for n in range(1500)]
    rows += [(5, rows[0][1], "", "", 0)] * 3 + [(7, " ".join(shared), "", "", 0), (None, None, "", "", 0)]
    r.shuffle(rows)
    substrings.batches = seen
    try:
        got = rows_of(substrings.removed_words(docs(spark, rows).select("doc_id", "text")).drop("text"))
    finally:
        substrings.batches = real
    assert got == plain_cut(rows, 50)
    assert 0 < max(longest) <= 115


def test_texts_of_one_id_keep_what_they_share(spark):
    passage = [f"p{i}" for i in range(70)]
    rows = [(4, f"{head} " + " ".join(passage), "", "", 0) for head in ("a b", "c", "d e f")] + [(4, "  " + " ".join(passage), "", "", 0), (4, " ".join(passage), "", "", 0), (9, "z " + " ".join(passage), "", "", 0)]
    got = rows_of(substrings.removed_words(docs(spark, rows).select("doc_id", "text")).drop("text"))
    assert got == plain_cut(rows, 50)
    assert [x[2] for x in got] == [0, 0, 0, 0, 0, 70]


def test_levels_ask_both_halves():
    assert substrings.lengths(50, 16) == [13, 25, 50] and substrings.lengths(7, 2) == [2, 4, 7] and substrings.lengths(1, 16) == [1]
    r = np.random.default_rng(1)
    singles = r.integers(0, 1 << 63, 90).astype(np.uint64)
    short, at = substrings.window_hashes(singles, 13), np.array([0, 3, 4, 12, 15, 30, 42, 60])
    places, hashes = substrings.doubled(at, short[:, at], 13, 25)
    assert places.tolist() == [0, 3, 30]
    assert (hashes == substrings.joined(short[:, [0, 3, 30]], short[:, [12, 15, 42]])).all()


def test_removed_words_keeps_clashing_columns(spark):
    df = docs(spark).toDF("doc_id", "text", "doc", "gone", "own").withColumn("kept", F.lit(1)).withColumn("at", F.col("doc_id") * 2)
    out = substrings.removed_words(df)
    assert out.columns == ["doc_id", "text", "doc", "gone", "own", "at", "n_words", "n_removed", "kept"]
    assert rows_of(out.select("doc_id", "n_words", "n_removed", "kept")) == plain_cut(DOCS, 50)
    assert rows_of(out.select("doc_id", "doc", "gone", "own")) == rows_of(df.select("doc_id", "doc", "gone", "own"))


def test_without_repeats_keeps_columns(spark):
    df = docs(spark).withColumnRenamed("lang", "n_words").withColumnRenamed("source", "kept")
    out = substrings.without_repeats(df)
    assert out.columns == df.columns
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect() if r["doc_id"] == 5)


def plain_mix(rows, weights=(3, 1, 2)):
    sized = [(d, s, len(WORD.findall(t or ""))) for d, t, _, s, _ in rows]
    names = sorted({s for _, s, _ in sized}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, x, n in sized if x == s) for s in names}
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, target, open_ = 1.5 * sum(size.values()), {}, list(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 2 * size[s]]
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
            open_.remove(s)
    queue, copies = [], []
    for i, s in enumerate(names):
        own = sorted((hashlib.md5(("mix-1:" + ("null" if d is None else str(d))).encode()).hexdigest(), (d is not None, d), n) for d, x, n in sized if x == s)
        total = 0
        for k, (_, d), n in own:
            total += n
            queue.append((s, d, n, total))
            for e in (1, 2):
                copies.append(((total + (e - 1) * size[s]) / weight[s], i, k, (d is not None, d), n, e, len(queue) - 1))
    taken, run = [0] * len(queue), 0
    for c in sorted(copies):
        run += c[4]
        if run * 100 <= sum(size.values()) * 150:
            taken[c[-1]] += 1
    return [(d, n, size[s], target[s], t * n) for (s, d, n, _), t in zip(queue, taken)]


def near_rows(rows):
    return sorted(((d, n, z, round(t, 6), k) for d, n, z, t, k in rows), key=key)


@pytest.mark.parametrize("seed", range(3))
def test_mix(spark, seed):
    r = random.Random(seed)
    rows = DOCS if not seed else [(i, " ".join("w" * r.randrange(1, 3) for _ in range(r.choice([0, 5, 80]))), "", r.choice(["a", "b", "c", "d", None]), 0) for i in range(120)]
    got = [tuple(x) for x in mixing.mix(docs(spark, rows)).select("doc_id", "size", "source_size", "target", "taken").collect()]
    assert near_rows(got) == near_rows(plain_mix(rows))


def test_mixed_repeats_rows(spark):
    df = docs(spark).toDF("doc_id", "text", "text_hash", "source", "copies").withColumn("again", F.lit(3)).withColumn("nth", F.lit("x")).withColumn("of_nth", F.col("doc_id"))
    out = mixing.mixed(df)
    assert {(x["again"], x["nth"]) for x in out.collect()} == {(3, "x")}
    assert all(x["doc_id"] == x["of_nth"] and x["text_hash"] in ("en", "de", "fr") for x in out.collect())
    assert out.columns == df.columns
    total = sum(len(WORD.findall(t or "")) for _, t, *_ in DOCS)
    assert sum(len(WORD.findall(r["text"] or "")) for r in out.collect()) <= 1.5 * total
    assert mixing.mixed(docs(spark, [])).count() == 0
