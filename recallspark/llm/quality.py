"""Quality rules under weak supervision, in DataFrame functions alone.

Each rule looks at one thing and votes that a text is bad or good, or abstains where it cannot tell. Thresholds
lie near the bulk of texts, so most rules are often wrong; no rule decides by itself. Expectation-maximisation
over the counts of vote patterns estimates how often each rule, where it votes, calls bad and good texts bad, and
the share of bad ones. Nothing is held fixed: a prior of a few votes says that rules are better than chance,
and data overcome it. That a rule abstains says nothing about a text. A text is kept if the posterior
probability that it is good is at least one half and it does not fail the base rules.

There are at most 3 to the number of rules patterns, 59049 for the ten rules here, whatever the number of
documents; they are counted over all documents and only their counts reach the estimate.

Rules for odd input: a null text is the empty text; it has no words and fails the base rules. A very long text
is measured whole, in its row. Rows of equal ``doc_id`` are judged each for itself. An empty table gives an
empty result. ``judged`` returns its own columns; ``filtered`` returns the input's columns whatever they are
called.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallspark.session import packed, written

#: What separates words, and the characters that count as symbols.
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"

#: Votes.
BAD, NONE, GOOD = range(3)
VOTES = 3

#: Rounds of expectation-maximisation; votes for bad and for good that each rule is taken to have given before, to bad and to good texts.
ROUNDS, BEFORE = 60, ((3.0, 1.0), (0.5, 10.0))

#: Words, and lines, that a text needs before rules on their shares vote.
LEAST_WORDS, LEAST_LINES = 20, 4


def _lost(text: Column, characters: str) -> Column:
    """How many of these characters the text has."""
    return F.char_length(text) - F.char_length(F.translate(text, characters, ""))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` and the counts that the rules go by, in columns that begin with ``_``.

    Words of repeated three-word windows are found within the row: windows as (hash, place) are sorted,
    equal neighbours give the places, and the places' words are counted once each.
    """
    said = F.coalesce(F.col(text), F.lit(""))
    blanks = F.translate(said, SPACES, " " * len(SPACES))
    df = docs.withColumn("_w", F.filter(F.split(blanks, " ", -1), lambda x: x != ""))
    df = df.withColumns({"_n_words": F.size("_w").cast("long"), "_n_distinct": F.size(F.array_distinct("_w")).cast("long"), "_n_short": F.size(F.filter("_w", lambda x: F.char_length(x) <= 2)).cast("long")})
    windows = F.transform(F.slice("_w", 1, F.greatest(F.size("_w") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2)))
    df = df.withColumn("_h", windows).drop("_w")
    again = F.size(F.array_distinct("_h")) < F.size("_h")
    df = df.withColumn("_p", F.when(again, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_h")
    same = lambda x, i: (F.get("_p", i - 1)["h"] == x["h"]) | (F.get("_p", i + 1)["h"] == x["h"])
    places = F.transform(F.filter("_p", lambda x, i: F.coalesce(same(x, i), F.get("_p", i - 1)["h"] == x["h"], F.get("_p", i + 1)["h"] == x["h"], F.lit(False))), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
    df = df.withColumn("_n_repeat_words", F.coalesce(F.size(F.array_distinct(F.flatten(places))), F.lit(0)).cast("long")).drop("_p")
    df = df.withColumn("_l", F.filter(F.split(said, "\n", -1), lambda x: F.translate(x, SPACES, "") != ""))
    df = df.withColumn("_n_lines", F.size("_l").cast("long")).withColumn("_n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long")).drop("_l")
    counts = {"_word_chars": F.char_length(F.translate(said, SPACES, "")), "_n_symbols": _lost(said, SYMBOLS), "_n_marks": _lost(said, "!"), "_n_stops": _lost(said, "."), "_n_commas": _lost(said, ","), "_n_capitals": _lost(said, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")}
    return df.withColumns({name: found.cast("long") for name, found in counts.items()})


def default_rules() -> dict[str, Column]:
    """Votes by name. A share within its inner bounds is a vote for good, one beyond the outer bounds for bad.

    Bounds are thousandths. A text without words gets no vote.
    """
    words, chars, lines = F.col("_n_words"), F.col("_word_chars"), F.col("_n_lines")

    def rule(part: str, whole: Column, low: int | None, high: int | None, inner: tuple[int, int], asked: Column) -> Column:
        at, out = F.col(part) * 1000, F.lit(False)
        if low is not None:
            out = out | (at < whole * low)
        if high is not None:
            out = out | (at > whole * high)
        return F.when(~asked, NONE).when(out, BAD).when((at >= whole * inner[0]) & (at <= whole * inner[1]), GOOD).otherwise(NONE)

    some, enough = words > 0, words >= LEAST_WORDS
    return {
        "symbols": rule("_n_symbols", chars, None, 10, (0, 5), some),
        "lengths": rule("_word_chars", words, 4500, 5800, (4600, 5600), some),
        "sentences": rule("_n_stops", words, 45, 140, (50, 120), enough),
        "capitals": rule("_n_capitals", chars, None, 300, (0, 100), some),
        "marks": rule("_n_marks", words, None, 100, (0, 20), some),
        "repeats": rule("_n_repeat_words", words, None, 80, (0, 20), enough),
        "lines": rule("_n_dup_lines", lines, None, 100, (0, 0), lines >= LEAST_LINES),
        "distinct": rule("_n_distinct", words, 620, None, (660, 1000), enough),
        "short": rule("_n_short", words, 50, 270, (60, 250), enough),
        "commas": rule("_n_commas", words, 30, 100, (35, 90), enough),
    }


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def estimate(patterns: DataFrame, n_rules: int) -> tuple[float, list[tuple[float, float]]]:
    """The share of bad texts, and for each rule how often it calls (bad, good) texts bad where it votes.

    ``patterns`` has ``votes`` (an array) and ``n``, one row a pattern. The rounds are one column
    expression over their sorted array. They start from the shares of votes for bad.
    """
    rows = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("p"))

    def split(bad: Callable[[Column], Column]) -> Column:
        return F.transform("p", lambda p: _bound(bad(p), lambda q: F.struct(p["votes"].alias("votes"), (p["n"] * q).alias("bad"), (p["n"] * (1 - q)).alias("good"))))

    def total(found: Column, side: str) -> Column:
        return F.aggregate(found, F.lit(0.0), lambda s, x: s + x[side])

    def chances(found: Column, side: str, before: tuple[float, float]) -> Column:
        """One number a rule: its votes for bad among all its votes."""
        votes = lambda j, vote: F.aggregate(found, F.lit(0.0), lambda s, x: s + F.when(F.get(x["votes"], j) == vote, x[side]).otherwise(0.0))
        share = lambda bad, good: (bad + before[0]) / (bad + good + sum(before))
        return F.transform(F.sequence(F.lit(0), F.lit(n_rules - 1)), lambda j: share(votes(j, BAD), votes(j, GOOD)))

    def fitted(found: Column) -> Column:
        share = (total(found, "bad") + 1) / (total(found, "bad") + total(found, "good") + 2)
        return F.struct(share.alias("share"), chances(found, "bad", BEFORE[0]).alias("bad"), chances(found, "good", BEFORE[1]).alias("good"))

    def step(found: Column) -> Column:
        return _bound(found, fitted)

    def log_ratio(m: Column, p: Column) -> Column:
        weights = [_weight(F.get(p["votes"], F.lit(j)), F.get(m["bad"], F.lit(j)), F.get(m["good"], F.lit(j))) for j in range(n_rules)]
        return sum(weights, F.ln(1 - m["share"]) - F.ln(m["share"]))

    def against(p: Column) -> Column:
        of = lambda vote: F.size(F.filter(p["votes"], lambda v: v == vote))
        return (of(BAD) + 0.5) / (of(BAD) + of(GOOD) + 1.0)

    again = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.col("m"), lambda m, _: step(split(lambda p: 1 / (1 + F.exp(log_ratio(m, p))))))
    model = rows.withColumn("m", step(split(against))).select(again.alias("m")).first()["m"]
    return model["share"], list(zip(model["bad"], model["good"]))


def _weight(vote: Column, bad: Column, good: Column) -> Column:
    """What a vote adds to the log odds of a good text."""
    return F.when(vote == BAD, F.ln(good) - F.ln(bad)).when(vote == GOOD, F.ln(1 - good) - F.ln(1 - bad)).otherwise(0.0)


def judged(docs: DataFrame, *, text: str = "text", rules: dict[str, Column] | None = None) -> DataFrame:
    """``docs`` with the counts of ``measured``, ``_base_failed``, ``_posterior`` and ``_kept``.

    The measured rows are written once to the shared folder, as both the estimate and the verdicts read
    them.
    """
    rules = rules or default_rules()
    votes = F.array(*rules.values())
    rows = written(packed(measured(docs, text).withColumn("_votes", votes)), "quality")
    share, chances = estimate(rows.groupBy(F.col("_votes").alias("votes")).agg(F.count("*").alias("n")), len(rules))
    weight = F.lit(math.log(1 - share) - math.log(share))
    for j, (bad, good) in enumerate(chances):
        weight = weight + _weight(F.get("_votes", F.lit(j)), F.lit(bad), F.lit(good))
    failed = (F.col("_n_words") < 50) | (F.col("_n_repeat_words") * 100 > F.col("_n_words") * 50)
    rows = rows.withColumn("_posterior", 1 / (1 + F.exp(-weight))).withColumn("_base_failed", failed)
    return rows.withColumn("_kept", ~F.col("_base_failed") & (F.col("_posterior") >= 0.5))


def filtered(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``."""
    inner = [f"c{i}" for i in range(len(docs.columns))]
    said = inner[docs.columns.index(text)]
    kept = judged(docs.toDF(*inner), text=said).where("_kept").select(*inner)
    return kept.toDF(*docs.columns)
