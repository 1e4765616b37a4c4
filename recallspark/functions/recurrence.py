"""Recurrence rules as RFC 5545 counts them, as a table function.

``occurrences`` in ``calendar`` follows the engine's own rule: COUNT counts times within the asked range, BYDAY
does away with the interval of weeks, and months overflow. Here COUNT counts from the rule's start, weeks are
counted from Monday by the interval, and months and years that lack a day are passed over.
"""

from __future__ import annotations

import calendar
import datetime as dt
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


def times(freq: str | None, interval: int | None, byday: list[int] | None, start: dt.datetime) -> Iterator[dt.datetime]:
    """All times of a rule in order, from its start on, without an end. ``byday``: weekdays from 1, Monday."""
    every, days = max(1, interval or 1), sorted({d for d in byday or [] if d is not None})
    day = dt.timedelta(days=1)

    def months(step: int) -> Iterator[tuple[int, int]]:
        at = start.year * 12 + start.month - 1
        while at // 12 <= 9999:
            yield at // 12, at % 12 + 1
            at += step

    if freq == "DAILY":
        at = start
        while True:
            if not days or at.isoweekday() in days:
                yield at
            at += every * day
    elif freq == "WEEKLY":
        monday = start - (start.isoweekday() - 1) * day
        while True:
            for d in days or [start.isoweekday()]:
                if (at := monday + (d - 1) * day) >= start:
                    yield at
            monday += 7 * every * day
    elif freq in ("MONTHLY", "YEARLY"):
        for year, month in months(every if freq == "MONTHLY" else 12 * every):
            length = calendar.monthrange(year, month)[1]
            if days and freq == "MONTHLY":
                chosen = [d for d in range(1, length + 1) if dt.date(year, month, d).isoweekday() in days]
            else:
                chosen = [start.day] if start.day <= length else []
            for d in chosen:
                at = start.replace(year=year, month=month, day=d)
                if at >= start and (not days or at.isoweekday() in days):
                    yield at
    elif freq is not None:
        yield start


@udtf(returnType="at_time timestamp_ntz, n int")
class Recurrences:
    """The times of a rule within [low, high), each with its number from the rule's start."""

    def eval(self, freq: str, interval: int, count: int, until: dt.datetime, byday: list, start: dt.datetime, low: dt.datetime, high: dt.datetime):
        if start is None or low is None or high is None or (byday is not None and not [d for d in byday if d is not None]):
            return
        try:
            for n, at in enumerate(times(freq, interval, byday, start), 1):
                if at >= high or (until is not None and at > until) or (count is not None and n > count):
                    return
                if at >= low:
                    yield at, n
        except OverflowError:  # beyond the year 9999
            return


def expanded(rules: DataFrame, low: Column, high: Column) -> DataFrame:
    """``rules`` (freq, interval, count, until, byday, start) with ``at_time`` and ``n`` for each time within [low, high)."""
    sides = rules.withColumns({"_low": low, "_high": high})
    columns = [F.col(c).outer() for c in ("freq", "interval", "count", "until", "byday", "start", "_low", "_high")]
    return sides.lateralJoin(Recurrences(*columns)).drop("_low", "_high")
