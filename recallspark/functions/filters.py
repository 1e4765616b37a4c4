"""Optional conditions: what a caller asks for becomes one filter, and what is not asked for leaves no trace in the plan."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallspark.functions import predicates as p

Condition = Callable[[Any], Column]


def before(cursor: tuple[str, Any]) -> Column:
    """Rows after a page's last row (time, id), newest first: an upper bound on the time stands alone, so that scans can use it."""
    at, last = F.lit(cursor[0]).cast("timestamp_ntz"), F.lit(cursor[1])
    return (F.col("created_at") <= at) & ((F.col("created_at") < at) | (F.col("id") < last))


def layer(key: str) -> Column:
    """``user``, ``apikey:…`` or ``label:…``, by prefix: each is a condition on a column of its own."""
    kind, _, name = key.partition(":")
    if kind == "apikey" and name:
        return (F.col("author") != "user") & (F.col("author_key") == name)
    if kind == "label" and name:
        return (F.col("author") != "user") & F.col("author_key").isNull() & (F.col("author_label") == name)
    if kind == "user" and not name:
        return F.col("author") == "user"
    raise ValueError(f"no layer of authors: {key!r}")


#: What a list of thoughts can be asked for. ``active`` is asked for unless it is said to be ``False``.
THOUGHTS: dict[str, Condition] = {
    "tenant": lambda x: F.col("user_id") == x,
    "category": lambda x: F.col("category") == x,
    "author": lambda x: F.col("author") == x,
    "layer": layer,
    "date_from": lambda x: F.col("created_at") >= F.lit(x).cast("timestamp_ntz"),
    "date_to": lambda x: F.col("created_at") <= F.lit(x).cast("timestamp_ntz"),
    "cursor": before,
    "active": lambda x: p.is_active(F.col("lifecycle"), F.col("metadata")) if x else F.lit(True),
}


def compiled(asked: Mapping[str, Any], known: Mapping[str, Condition]) -> Column | None:
    """All conditions that are asked for; a value of None asks for nothing, an unknown name is refused."""
    if unknown := sorted(set(asked) - set(known)):
        raise ValueError(f"no such conditions: {', '.join(unknown)}; there are {', '.join(sorted(known))}")
    found = [known[name](value) for name, value in asked.items() if value is not None]
    return reduce(lambda a, b: a & b, found) if found else None


def thoughts(rows: DataFrame, limit: int = 20, **asked: Any) -> DataFrame:
    """The newest thoughts that meet what is asked, between 1 and 100 of them."""
    condition = compiled({"active": True} | asked, THOUGHTS)
    return (rows if condition is None else rows.where(condition)).orderBy(F.desc("created_at"), F.desc("id")).limit(max(1, min(limit, 100)))
