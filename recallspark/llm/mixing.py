"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions alone.

Every document stands in its source's queue in a shuffled order that depends on its id and a seed. The
virtual finish time of its n-th copy is the source's words up to and with it, earlier rounds included,
over the source's weight. All copies in order of finish time, cut where their words reach the budget,
are the mix: sources advance in proportion to their weights, and one that has given all its rounds
leaves its share to the others.

No step gathers a source in one task: sums of hash ranges of a source, and of ranges of finish time,
carry the running totals between tasks.

Rules for odd input: a null text has size zero and takes part without words. Null sources are one
source, after all others. Rows of equal ``doc_id`` are documents of their own; of rows equal in all that
is read, those that come first by their other columns get the more copies. An empty table gives an empty
result. ``mix`` reads no other columns; ``mixed`` returns them whatever they are called.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallspark.llm.rows import word_count
from recallspark.session import packed, written

#: Sources up to this number are sent to every task; more of them are joined by shuffle.
SOURCES_SENT = 10_000

#: Ranges of finish time that one level of the cut tells apart, and number of levels before rows are sorted.
RANGES, LEVELS = 4096, 2


def shuffled_key(seed: str) -> Column:
    """A document's place in its source's queue: 32 hexadecimal digits."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def targets(by_source: DataFrame, weights: Sequence[int], percent: int, rounds: int) -> DataFrame:
    """``source, source_size`` with ``s`` (its number), ``weight``, ``total`` and ``target``.

    A source whose part by weight is above ``rounds`` times its size keeps that much; by rising ratio of
    that to weight, the first source that is not above tells the level at which all others stand.
    """
    everywhere = Window.partitionBy()
    found = by_source.withColumn("s", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    found = found.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("s") - 1) % len(weights) + 1).cast("int")).cast("long"))
    found = found.withColumn("total", F.sum("source_size").over(everywhere)).withColumn("most", F.col("source_size") * rounds)
    rising = Window.orderBy(F.col("most").cast("double") / F.col("weight"), "s")
    earlier, later = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    budget = F.col("total").cast("double") * percent / 100
    found = found.withColumn("level", (budget - F.coalesce(F.sum("most").over(earlier), F.lit(0)).cast("double")) / F.sum("weight").over(later).cast("double"))
    held = F.col("level") <= F.col("most").cast("double") / F.col("weight")
    found = found.withColumn("level", F.min_by(F.when(held, F.col("level")), F.when(held, F.col("most").cast("double") / F.col("weight"))).over(everywhere))
    target = F.least(F.col("most").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("most").cast("double")))
    return found.select("source", "source_size", "s", "weight", "total", target.alias("target"))


def queue(docs: DataFrame, weights: Sequence[int], percent: int, rounds: int, seed: str) -> DataFrame:
    """Each document with its source's figures and ``cum``, the source's words up to and with it."""
    slim = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
    base = written(packed(slim.withColumn("key", shuffled_key(seed))), "mix-sizes")
    plan = written(packed(targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, percent, rounds)), "mix-sources")
    few = plan.count() <= SOURCES_SENT
    side = (F.broadcast(plan) if few else plan).withColumnRenamed("source", "of")
    rows = base.join(side, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("part", F.substring("key", 1, 3))
    sums = base.groupBy("source", F.substring("key", 1, 3).alias("part")).agg(F.sum("size").alias("words"))
    sums = sums.join(side, F.col("source").eqNullSafe(F.col("of"))).select("s", "part", "words")
    before = Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("s", "part", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("s", "part").orderBy("key", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("here", F.sum("size").over(within)).join(sums, ["s", "part"]).withColumn("cum", F.col("before") + F.col("here")).drop("before", "here", "part")


#: What the order of copies goes by.
ORDER = ["finish", "s", "key", "doc_id", "size", "text_hash", "round"]


def finish_time(round_: Column) -> Column:
    return (F.col("cum") + (round_ - 1) * F.col("source_size")).cast("double") / F.col("weight")


def taken_copies(queued: DataFrame, percent: int, rounds: int) -> DataFrame:
    """``queued`` with ``copies``: how many of its copies stand before the cut.

    The cut is searched by ranges of finish time: sums of at most ``RANGES`` ranges tell in which one the
    budget ends, and that one is told apart again; the rows of the last range alone are sorted.
    """
    copies = queued.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("finish", finish_time(F.col("round")))
    high, total = queued.agg(F.max(F.col("source_size") * rounds / F.col("weight")), F.max("total")).first()
    if not total:
        return queued.withColumn("copies", F.lit(0).cast("long"))
    low, before, budget, inside = 0.0, 0, total * percent, copies
    for _ in range(LEVELS):
        at = F.least(F.floor((F.col("finish") - low) * RANGES / (high - low)), F.lit(RANGES - 1))
        sums = inside.groupBy(at.alias("at")).agg(F.sum("size"), F.min("finish"), F.max("finish")).orderBy("at").collect()
        for _, words, low, high in sums:
            if (before + words) * 100 > budget:
                break
            before += words
        else:
            return queued.withColumn("copies", F.lit(rounds).cast("long"))
        inside = copies.where(F.col("finish").between(low, high))
        if low == high:
            break
    running = F.sum("size").over(Window.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)) + before
    last = inside.withColumn("running", running).where(F.col("running") * 100 <= budget).orderBy(*[F.desc(c) for c in ORDER]).select(*ORDER).first()
    if last is None:
        taken = [finish_time(F.lit(n)) < low for n in range(1, rounds + 1)]
    else:
        kinds = dict(inside.dtypes)
        cut = F.struct(*[F.lit(last[c]).cast(kinds[c]).alias(c) for c in ORDER])
        at_round = lambda n: {"finish": finish_time(F.lit(n)), "round": F.lit(n)}
        taken = [F.struct(*[at_round(n).get(c, F.col(c)).alias(c) for c in ORDER]) <= cut for n in range(1, rounds + 1)]
    return queued.withColumn("copies", sum((t.cast("long") for t in taken), F.lit(0).cast("long")))


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), percent: int = 150, rounds: int = 2, seed: str = "mix-1") -> DataFrame:
    """Per document ``doc_id, source, size, source_size, target, copies, taken`` and ``text_hash``.

    ``weights`` repeat over the sources in code-point order; the mix holds ``percent`` of all words, and
    no document more than ``rounds`` times.
    """
    queued = queue(docs, weights, percent, rounds, seed)
    return taken_copies(queued, percent, rounds).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), "text_hash")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the columns of ``docs``."""
    inner = {"doc_id": "doc_id", "source": "source", "text": "text"}
    names = [inner.get(c, f"c{i}") for i, c in enumerate(docs.columns)]
    rows = docs.toDF(*names)
    same = Window.partitionBy("doc_id", "source", "text_hash")
    # Rows that agree in what the mix reads are told apart by their other columns.
    order = [F.col(c) for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]
    nth = F.row_number().over(same.orderBy(F.desc("copies")))
    plan = mix(rows, **how).withColumn("nth", nth).where("copies > 0").select(*[F.col(c).alias(f"of_{c}") for c in ("doc_id", "source", "text_hash", "nth", "copies")])
    rows = rows.withColumn("text_hash", F.xxhash64("text")).withColumn("nth", F.row_number().over(same.orderBy(*order)))
    match = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in ("doc_id", "source", "text_hash", "nth")]
    return rows.join(plan, match).withColumn("again", F.explode(F.sequence(F.lit(1), F.col("of_copies")))).select(*names).toDF(*docs.columns)
