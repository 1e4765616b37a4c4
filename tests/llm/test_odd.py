"""Input that once took far too much memory: very long hosts, hot rules, many long labelled texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallspark.llm import line_crf, urls


def test_hosts_of_very_many_labels():
    host = "a." * 100_000 + "example.net"
    assert urls.lookups(host, "/en/x", [4, 1], 2) == ["example.net/en/", "example.net/", "net/en/", "net/"]
    assert urls.lookups("net", "/", [1], 1) == ["net/"] and urls.lookups("a.net", "/", [1], 1) == ["net/"]
    assert urls.lookups(".net", "/", [1], 5) == [".net/", "net/"] and urls.lookups("", "/", [1], 5) == []
    assert sorted(urls.lookups("a.b.c", "/", [1], 9)) == sorted(urls.lookups("a.b.c", "/", [1], 3)) == ["a.b.c/", "b.c/", "c/"]


@pytest.mark.parametrize("hot", [3, 10_000])
def test_hot_rules_and_long_hosts_are_judged_alike(spark, monkeypatch, hot):
    monkeypatch.setattr(urls, "HOT", hot)
    hosts = ["net", "a.net", "example.net", "b.example.net", "org", "x.org", "." * 50_000 + "net", "n.et", ""]
    rows = [(i, f"http://{hosts[i % len(hosts)]}{['/', '/en/', '/fr/x', ''][i % 4]}") for i in range(180)] + [(200, None), (201, "no url")]
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("allow", "org", "/fr/"), ("block", "deep.er.x.org", "/")]
    got = urls.judged(spark.createDataFrame(rows, "page_id long, url string"), urls.rule_table(spark, rules))
    for r in got.collect():
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (r["host"] == h or r["host"].endswith("." + h)) and r["path"].startswith(p)]
        want = max(fits)[1:] if fits else (None, "allow")
        assert (r["rule"], r["verdict"]) == want, r
    assert got.count() == len(rows)


def test_many_long_labelled_texts_are_learned_from_within_a_bound(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(line_crf, "fit", lambda found: seen.append(found))
    texts = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("short\n"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(2100)), lambda i: F.concat(F.lit("line "), i.cast("string"))), "\n")).alias("text"))
    labels = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    line_crf.learned(texts, labels, lines=9000)
    (found,) = seen
    lines = [len(size) for _, size, _ in found]
    assert 6000 < sum(lines) <= 9000 and {x.shape[1] for x, *_ in found} == {3 * line_crf.LOOKS}
    # Each run's lines stand beside those of the text itself.
    text = line_crf.Lines(texts.first()["text"])
    want = text.with_neighbours(0, 250)
    assert any(np.allclose(x, want, atol=1e-6) for x, *_ in found)
    seen.clear()
    line_crf.learned(texts, labels, lines=10)
    assert sum(len(size) for _, size, _ in seen[0]) == 2000  # the first document in any case
