"""Lexical search: texts ranked by how often they hold the query's words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallspark.functions import text as t


def search(notes: DataFrame, wanted: Sequence[str], k: int, *, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``id, raw, rank`` of the k best texts that hold a wanted word; one scan, each task keeps k rows."""
    # A filter on the rank would work it out twice; an explode of the ranks that count does not.
    rank = F.array(t.cover_density(t.tokens(F.col(text_col)), wanted))
    ranked = notes.select(id_col, F.explode(F.filter(rank, lambda r: r > 0)).alias("raw"))
    return ranked.withColumn("rank", t.normal_rank(F.col("raw"))).orderBy(F.desc("raw"), id_col).limit(k)


def search_or_newest(summaries: DataFrame, wanted: Sequence[str], k: int, fallback: int = 3) -> DataFrame:
    """Matching summaries, the newest first; where none matches, the newest few."""
    hit = summaries.withColumn("hit", t.cover_density(t.tokens(F.col("text")), wanted) > 0)
    found = hit.where("hit").orderBy(F.desc("at"), "id").limit(k)
    other = summaries.orderBy(F.desc("at"), "id").limit(fallback).withColumn("hit", F.lit(False))
    none = found.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(1).alias("_"))
    return found.unionByName(other.join(F.broadcast(none), F.lit(True)).drop("_"))


#: Texts, or labels, of a run of words that are sent in one row. A row's pairs are in memory together: 262,144 at most, about.
CHUNK = 512


def _chunks(rows: DataFrame, held: str) -> DataFrame:
    """``rows`` (run, ``held``, times) as lists of at most about ``CHUNK``, of equal times."""
    sizes = rows.groupBy("run").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64(held), F.col("parts"))
    # By way of structs, as lists of bare values leave out nulls.
    values = F.transform(F.collect_list(F.struct(held)), lambda x: x[held])
    return rows.join(sizes, "run").groupBy("run", F.col("times").alias(f"{held}_times"), part.alias(f"{held}_part")).agg(values.alias(f"{held}s"))


def label_hits(texts: DataFrame, labels: DataFrame, limit: int | None = None) -> DataFrame:
    """Labels that texts name: one word as a word, several as words in a row.

    Texts are exploded to runs of as many words as some label has, and met by equality; the number of
    different lengths is small, as labels are. Where very many texts have a run that very many labels are, the
    result is their product: lists of both meet, are dealt out evenly, and only then become pairs, which are
    neither moved nor added up. Only entities with several labels need a sum over pairs.
    """
    words = labels.withColumn("words", t.tokens(F.col("label"))).where(F.size("words") > 0).select(F.col("id").alias("entity_id"), F.array_join("words", " ").alias("run"), F.size("words").alias("n"))
    lengths = [r[0] for r in words.select("n").distinct().collect()]
    said = texts.withColumn("w", t.tokens(F.col("text")))

    def runs_of(n: int) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " ")))

    runs = None
    for n in lengths:
        made = runs_of(n)
        part = said.where(F.size("w") >= n).select("id", F.explode(made).alias("run"))
        runs = part if runs is None else runs.unionByName(part)
    if runs is None:
        return texts.sparkSession.createDataFrame([], "id long, entity_id long, hits long")
    own = words.groupBy("entity_id", "run").agg(F.count("*").alias("times")).groupBy("entity_id").agg(F.collect_list(F.struct("run", "times")).alias("runs"))
    of = lambda rows: rows.select("entity_id", F.inline("runs"))
    one, several = of(own.where(F.size("runs") == 1)), of(own.where(F.size("runs") > 1))
    told = runs.join(words.select("run").distinct(), "run", "left_semi").groupBy("run", "id").agg(F.count("*").alias("times"))
    met = _chunks(told, "id").join(_chunks(one, "entity_id"), "run")
    # As many parts as the session shuffles to, of which a large result needs each.
    spread = met.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "run", "id_part", "entity_id_part", "id_times", "entity_id_times")
    pairs = spread.select(F.explode("ids").alias("id"), "entity_ids", (F.col("id_times") * F.col("entity_id_times")).alias("hits")).select("id", F.explode("entity_ids").alias("entity_id"), "hits")
    summed = told.join(several.withColumnRenamed("times", "label_times"), "run").groupBy("id", "entity_id").agg(F.sum(F.col("times") * F.col("label_times")).alias("hits"))
    found = pairs.unionByName(summed)
    return found if limit is None else found.orderBy("id", "entity_id").limit(limit)


def label_hints(texts: DataFrame, labels: DataFrame, most: int = 12) -> DataFrame:
    """The first labels that each text names, one of each folded label and type; labels of one character are none."""
    key = F.array_join(t.tokens(F.col("label")), " ")
    once = labels.where(F.char_length(F.trim("label")) >= 2).groupBy(key.alias("label"), "entity_type").agg(F.min("id").alias("id"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("entity_id"))
    return label_hits(texts, once).withColumn("place", place).where(F.col("place") <= most).select("id", "entity_id", "place")
