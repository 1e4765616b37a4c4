"""The kept index gives the ranks of a scan over the texts, and reads the buckets of its words."""

import random
import re

import pytest
from pyspark.sql import functions as F

from recallspark.operators import index, lexical
from recallspark.session import new_folder

NOTES = "id long, text string, cues array<string>"


def scanned(spark, notes, wanted, k):
    rows = [(i, " ".join([text or "", *(c for c in cues or [] if c is not None)])) for i, (text, cues) in notes.items()]
    return [tuple(r) for r in lexical.search(spark.createDataFrame(rows, "id long, text string"), wanted, k).collect()]


def test_ranks_are_those_of_a_scan_after_any_batches(spark):
    rng, words = random.Random(3), ["red", "ring", "Größe", "漢字", "the", "x1"]
    kept, notes = index.Postings(spark, new_folder(spark, "index"), buckets=8), {}
    for number in range(4):
        rows = {i: (rng.choice([None, "", " ".join(rng.choices(words, k=rng.randint(1, 9)))]), rng.choice([None, [], ["red cue"], [None, "ring"]])) for i in rng.sample(range(40), 15)}
        gone = rng.sample(range(40), 3)
        made = [(i, *r) for i, r in rows.items()]
        twice = [made[0], (None, "red red", None)]
        kept.put(spark.createDataFrame(made + twice, NOTES), number, gone=spark.createDataFrame([(i,) for i in gone], "id long"))
        notes.update(rows)
        notes = {i: r for i, r in notes.items() if i not in gone}
    for wanted in (["red"], ["ring", "größe", "none"], ["漢字", "the", "red", "red"], ["none"], []):
        want = scanned(spark, notes, wanted, 12)
        assert [tuple(r) for r in kept.search(wanted, 12).collect()] == want
    one = kept.merged(new_folder(spark, "merged"))
    assert [tuple(r) for r in one.search(["red", "the"], 12).collect()] == scanned(spark, notes, ["red", "the"], 12)
    before = sorted(map(tuple, kept.postings().collect()))
    kept.put(spark.createDataFrame(made + twice, NOTES), 3, gone=spark.createDataFrame([(i,) for i in gone], "id long"))
    assert sorted(map(tuple, kept.postings().collect())) == before


def test_counts_of_a_word_end_at_256(spark):
    kept = index.Postings(spark, new_folder(spark, "index"))
    kept.put(spark.createDataFrame([(1, "red " * 300), (2, "red")], "id long, text string"), 0)
    assert [tuple(r) for r in kept.search(["red"], 5).collect()] == [(1, pytest.approx(25.6), 1.0), (2, pytest.approx(0.1), 0.25)]


def test_a_search_reads_the_buckets_of_its_words_alone(spark):
    kept = index.Postings(spark, new_folder(spark, "index"))
    kept.put(spark.range(2000).select("id", F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" red")).alias("text")), 0)
    found = kept.search(["w17"], 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (=|IN)", plan) and re.search(r"PushedFilters: \[[^\]]*token", plan)
    assert [r["id"] for r in found.collect()] == [17]
