"""The queries of this subpackage's operators over the driver tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.llm import bit_slices, bpe, edit_counts, line_crf, mixing, neighbours, periods, phrases, quality, simhash, substrings, token_files, urls
from recallspark.session import new_folder, written
from recallspark.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

#: Id that ends each document in token files.
END_ID = 2

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.search(rows, rows.where(F.col("vec_id") % 50 == 0), 5)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_BPE).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), BYTE_BPE, END_ID, path)
    return token_files.summary(spark, path)


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.removed_words(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"]
    return found.select("doc_id", *[F.col(f"_{c}").alias(c) for c in counts])


#: The contract's rules: verdict, host, beginning of the path.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judged(pages, urls.rule_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


def op7_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's kept tree edited twice: a remark put in at its middle, then 24 characters from a quarter on replaced."""
    trees = written(edit_counts.built(table(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_BPE), "trees")
    n = F.coalesce(F.char_length("text"), F.lit(0))
    edit = lambda start, removed, inserted: F.struct(F.floor(start).cast("long").alias("start"), F.lit(removed).cast("long").alias("removed"), F.lit(inserted).alias("inserted"))
    edits = F.array(edit(n / 2, 0, " (see the note of 2024-02-01) "), edit(n / 4, 24, "changed here,"))
    found = edit_counts.edited(trees.withColumn("edits", edits), BYTE_BPE)
    return found.select("doc_id", "n_tokens", "n_tokens_after", "n_chars_after", "n_encoded")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.grouped(table(spark, sf_dir, "documents"), shingle=3, blocks=1, radius=2, keys=simhash.exact_keys(2, 1))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op10_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_crf.scored(docs, line_crf.learned(docs, table(spark, sf_dir, "labels")))


def op11_bit_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_slices.top(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's texts: those of a tenth of all ids repeat themselves from some word on. None do without an id."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.found(table(spark, sf_dir, "documents").select("doc_id", "text"), edit=planted)
    told = F.array_join(F.transform("runs", lambda r: F.concat(r.start, F.lit(","), r.length, F.lit(","), r.period, F.lit("\n"))), "")
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    milli = F.expr("1000 * best.length div best.period")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, milli.alias("exponent_milli"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES: dict[str, Query] = {"op1_token_files": op1_token_files, "op2_neighbours": op2_neighbours, "op3_bpe": op3_bpe, "op4_substrings": op4_substrings, "op5_quality_rules": op5_quality_rules, "op6_urls": op6_urls, "op7_edit_counts": op7_edit_counts, "op8_mixing": op8_mixing, "op9_simhash": op9_simhash, "op10_line_crf": op10_line_crf, "op11_bit_slices": op11_bit_slices, "op12_phrases": op12_phrases, "op13_periods": op13_periods}
ORACLES: dict[str, str] = {}

ORACLES["op8_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM documents
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS s FROM d GROUP BY source
), s1 AS (
  SELECT *, [3, 1, 2][((s - 1) % 3 + 1)::INT]::BIGINT AS weight, sum(source_size) OVER ()::BIGINT AS total, source_size * 2 AS most FROM s0
), s2 AS (
  SELECT *, most::DOUBLE / weight AS ratio,
    (total::DOUBLE * 150 / 100 - coalesce(sum(most) OVER (ORDER BY most::DOUBLE / weight, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
      / (sum(weight) OVER (ORDER BY most::DOUBLE / weight, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lev
  FROM s1
), lv AS (
  SELECT lev AS level FROM s2 WHERE lev <= ratio ORDER BY ratio, s LIMIT 1
), s3 AS (
  SELECT source, source_size, s, weight, total, least(most::DOUBLE, coalesce((SELECT level FROM lv) * weight, most::DOUBLE)) AS target FROM s2
), q AS (
  SELECT d.doc_id, d.size, d.key, s3.*, sum(d.size) OVER (PARTITION BY s3.s ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING)::BIGINT AS cum
  FROM d JOIN s3 ON d.source IS NOT DISTINCT FROM s3.source
), c AS (
  SELECT *, (cum + (round - 1) * source_size)::DOUBLE / weight AS finish FROM q, (VALUES (1), (2)) r(round)
), t AS (
  SELECT *, sum(size) OVER (ORDER BY finish, s, key, doc_id, size, round ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM c
)
SELECT doc_id, size, source_size, target, sum(CASE WHEN running * 100 <= total * 150 THEN size ELSE 0 END)::BIGINT AS taken
FROM t GROUP BY doc_id, size, source_size, target, key
"""

ORACLES["op6_urls"] = r"""
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h0, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), v AS (
  SELECT page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u
), r(verdict, h, pre) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), m AS (
  SELECT v.page_id, v.host, v.path, h || pre AS rule, verdict, row_number() OVER (PARTITION BY v.page_id, v.host, v.path ORDER BY length(h || pre) DESC NULLS LAST) AS k
  FROM v LEFT JOIN r ON (v.host = h OR ends_with(v.host, '.' || h)) AND starts_with(v.path, pre)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""

ORACLES["op4_substrings"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), x AS (
  SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d
), p AS (
  SELECT doc_id, n, pos, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) AS h FROM x
), s AS (
  SELECT * FROM p WHERE pos + 49 <= n
), m AS (
  SELECT h, min(doc_id) AS low FROM s GROUP BY h
), g AS (
  SELECT DISTINCT doc_id, s.pos + k.k AS pos FROM s JOIN m USING (h), range(50) k(k) WHERE low < doc_id
), t AS (
  SELECT x.doc_id, x.pos, x.word, g.pos IS NOT NULL AS gone FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.pos = x.pos
), a AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '') AS kept FROM t GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)
"""

ORACLES["op11_bit_slices"] = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLES["op12_phrases"] = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d
), c AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang
), g AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM p, (VALUES (1), (2), (3), (4)) k(m)
), f AS MATERIALIZED (
  SELECT lang, m, phrase, count(*)::BIGINT AS a FROM g GROUP BY ALL HAVING count(*) >= 30
), x AS (
  SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM f WHERE m > 1
), y AS (
  SELECT x.lang, x.m, x.phrase, x.a, k, l.a AS l, r.a AS r, (2000000 * x.a::HUGEINT // (l.a + r.a))::BIGINT AS score
  FROM x JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1:k], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[k + 1:], ' ')
), z AS (
  SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), i AS (
  SELECT lang, a AS most, unnest(flatten(list_transform(range(2, m), lambda s: list_transform(range(1, m - s + 2), lambda i: array_to_string(string_split(phrase, ' ')[i:i + s - 1], ' '))))) AS phrase FROM f WHERE m > 2
), j AS (
  SELECT lang, phrase, max(most) AS most FROM i GROUP BY lang, phrase
), t AS (
  SELECT z.* FROM z LEFT JOIN j USING (lang, phrase) WHERE j.most IS NULL OR 100 * j.most::HUGEINT < 80 * z.a::HUGEINT
), q AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM t
)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score FROM q JOIN c USING (lang) WHERE rank <= 2000
"""
