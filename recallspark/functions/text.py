"""Text folding, tokens and rank functions for lexical search."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: A lexical rank of this much counts as 1: four matching positions.
RANK_SCALE, A_POSITION, MOST_POSITIONS = 2.5, 0.1, 256


def fold_text(text: str) -> str:
    """Compatibility form, lower case, sharp s as ss, marks dropped."""
    if text.isascii():
        return text.lower()
    lower = unicodedata.normalize("NFKC", text).lower().replace("ß", "ss")
    return "".join(ch for ch in unicodedata.normalize("NFKD", lower) if not unicodedata.combining(ch))


def lexical_text(text: str) -> str:
    return re.sub(r"\s+", " ", fold_text(text)).strip()


def query_tokens(text: str, least: int = 1, most: int | None = None) -> list[str]:
    """Runs of a-z and 0-9 of the folded text, each once, in order."""
    found = list(dict.fromkeys(t for t in re.split(r"[^a-z0-9]+", fold_text(text)) if len(t) >= max(1, least)))
    return found if most is None else found[:most]


def search_cues(cues: Sequence[str], most: int = 5) -> list[str]:
    """Hints of 3 to 80 characters, at most a few."""
    return [c for c in (x.strip() for x in cues) if 3 <= len(c) <= 80][:most]


def folded(text: Column) -> Column:
    """``lexical_text`` as a column; Spark has no such normal forms, so it runs on Arrow batches."""

    def run(said: pd.Series) -> pd.Series:
        return said.map(lambda x: None if x is None else lexical_text(x))

    return pandas_udf(run, "string")(text)


def tokens(text: Column) -> Column:
    """Runs of letters and figures of any script, in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def cover_density(found: Column, wanted: Sequence[str]) -> Column:
    """Rank of an any-of query: a tenth for each position that matches, up to 256 for a word."""
    if not wanted:
        return F.lit(0.0)

    # The text's tokens are made once, in the lambda's argument; only those that match are looked at again.
    def matches(hits: Column, word: str) -> Column:
        return F.least(F.size(F.filter(hits, lambda t: t == word)), F.lit(MOST_POSITIONS))

    def ranked(hits: Column) -> Column:
        return sum((matches(hits, w) for w in wanted), F.lit(0))

    hits = F.filter(found, lambda t: t.isin(*wanted))
    return A_POSITION * F.get(F.transform(F.array(hits), ranked), F.lit(0)).cast("double")


def normal_rank(rank: Column) -> Column:
    return F.when(rank <= 0, 0.0).otherwise(F.least(F.lit(1.0), rank * RANK_SCALE))


def snippet(text: Column, length: int = 300) -> Column:
    said = F.trim(text)
    return F.when(F.char_length(said) <= length, said).otherwise(F.concat(F.rtrim(F.substring(said, 1, length - 1)), F.lit("…")))
