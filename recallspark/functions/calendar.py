"""Calendar arithmetic as column functions. Days are UTC days unless a zone is given; months overflow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def plus_days(t: Column, days: Column | int) -> Column:
    days = F.lit(days) if isinstance(days, int) else days
    return t + F.make_dt_interval(days.cast("int"))


def plus_hours(t: Column, hours: int) -> Column:
    return t + F.make_dt_interval(F.lit(0), F.lit(hours))


def overflow_months(t: Column, months: Column) -> Column:
    """``t`` some months on, days beyond the month's end running into the next: 31 March less one is 3 March."""
    day = F.to_date(t)
    first = F.add_months(F.trunc(day, "month"), months.cast("int"))
    moved = F.date_add(first, F.dayofmonth(day) - 1)
    return moved.cast("timestamp_ntz") + (t - F.date_trunc("day", t).cast("timestamp_ntz"))


def day_key(t: Column, zone: str = "UTC") -> Column:
    """The calendar day of a UTC time in a zone."""
    return F.to_date(F.from_utc_timestamp(t.cast("timestamp"), zone))


def days_between(a: Column, b: Column) -> Column:
    return F.datediff(F.to_date(b), F.to_date(a))


def weeks_between(a: Column, b: Column) -> Column:
    return F.floor(days_between(a, b) / 7).cast("int")


def months_between(a: Column, b: Column) -> Column:
    """Whole calendar months, days of the month not looked at."""
    return 12 * (F.year(b) - F.year(a)) + F.month(b) - F.month(a)


def active_period(text: Column) -> Column:
    """``[start,end)`` in text as a struct of times."""
    part = lambda i: F.regexp_extract(text, r'^[\[(]"?([^",]*)"?,"?([^",)\]]*)"?[\])]$', i)
    time = lambda i: F.try_to_timestamp(F.regexp_replace(part(i), r"Z$", "")).cast("timestamp_ntz")
    return F.struct(time(1).alias("start"), time(2).alias("end"))


def overlaps(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Half-open periods [a, b) and [c, d) have a time in common."""
    return (a < d) & (c < b)


def resolved_end(start: Column, end: Column, kind: Column, precision: Column, fuzzy: Column) -> Column:
    """An event's end: its own, or one after its kind and precision; at least an hour after the start."""
    own = (
        F.when(end.isNotNull(), end)
        .when(kind.isin("deadline", "reminder"), plus_days(start, 1))
        .when(fuzzy, plus_days(start, 7))
        .when(precision == "day", plus_days(start, 1))
        .when(precision == "week", plus_days(start, 7))
        .when(precision == "month", overflow_months(start, F.lit(1)))
        .otherwise(plus_hours(start, 1))
    )
    return F.when(own <= start, plus_hours(start, 1)).otherwise(own)


def relative_date(anchor: Column, unit: Column, amount: Column) -> Column:
    """Days, weeks or months before the anchor's day, or the weekday (1 Monday) strictly before it; at noon."""
    day = F.to_date(anchor)
    back = (F.pmod(F.weekday(day) + 1 - amount + 6, F.lit(7)) + 1).cast("int")
    found = (
        F.when(unit == "days", F.date_sub(day, amount.cast("int")))
        .when(unit == "weeks", F.date_sub(day, (amount * 7).cast("int")))
        .when(unit == "months", F.to_date(overflow_months(day.cast("timestamp_ntz"), -amount)))
        .when(unit == "weekday", F.date_sub(day, back))
    )
    return plus_hours(found.cast("timestamp_ntz"), 12)


#: Steps that a rule takes at most.
MOST_STEPS = 500


def _by_days(step: Column, start: Column, low: Column, stop: Column) -> Column:
    """Times from ``start`` on by ``step`` days, those from ``low`` to ``stop``: the first one is worked out."""
    near = plus_days(start, F.greatest(F.floor(F.datediff(F.to_date(low), F.to_date(start)) / step), F.lit(0)) * step)
    first = F.when(near < low, plus_days(near, step)).otherwise(near)
    return F.when(first <= stop, F.sequence(first, stop, F.make_dt_interval(step))).otherwise(F.array().cast("array<timestamp_ntz>"))


def _by_weekdays(byday: Column, start: Column, low: Column, stop: Column) -> Column:
    """Times from ``start`` on that fall on the weekdays, those from ``low`` to ``stop``."""
    own = lambda d: plus_days(start, F.pmod(d - 1 - F.weekday(F.to_date(start)), F.lit(7)))
    days = F.array_distinct(F.filter(byday, lambda d: d.between(1, 7)))
    return F.sort_array(F.flatten(F.transform(days, lambda d: _by_days(F.lit(7), own(d), low, stop))))


def _by_months(every: Column, start: Column, low: Column, last: Column) -> Column:
    """Times from ``start`` on by ``every`` months, those from ``low`` to ``last``.

    Only the first month that lacks the day runs into the next one; from then on it is a day of the first three.
    """
    day, month = F.dayofmonth(start), F.trunc(F.to_date(start), "month")
    first_of = lambda months: F.add_months(month, months)
    lacks = F.filter(F.sequence(F.lit(1), F.lit(MOST_STEPS - 1)), lambda i: F.dayofmonth(F.last_day(first_of(i * every))) < day)
    turn = F.when(day > 28, F.get(lacks, F.lit(0)))
    least = F.greatest(F.floor(months_between(start, low) / every) - 1, F.lit(0)).cast("int")
    most = F.least(F.floor(months_between(start, last) / every), F.lit(MOST_STEPS - 1)).cast("int")
    own = start - F.date_trunc("day", start).cast("timestamp_ntz")

    # The turn is looked for once, in the lambda's argument.
    def times(t: Column) -> Column:
        left = day - F.dayofmonth(F.last_day(first_of(t * every)))
        on = lambda i: F.when(i < t, F.date_add(first_of(i * every), day - 1)).otherwise(F.date_add(first_of(i * every + 1), left - 1))
        plain = lambda i: F.date_add(first_of(i * every), day - 1)
        steps = F.sequence(least, most)
        days = F.when(t.isNull(), F.transform(steps, plain)).otherwise(F.transform(steps, on))
        return F.filter(F.transform(days, lambda at: at.cast("timestamp_ntz") + own), lambda at: (at >= low) & (at <= last))

    return F.when(least <= most, F.get(F.transform(F.array(turn), times), F.lit(0))).otherwise(F.array().cast("array<timestamp_ntz>"))


def occurrences(freq: Column, interval: Column, count: Column, until: Column, byday: Column, start: Column, low: Column, high: Column) -> Column:
    """Times of a recurrence rule within [low, high).

    ``byday`` is an array of weekdays (1 Monday) or null; with it a weekly rule goes day by day and its
    interval is not looked at. ``count`` counts times within the range alone. Only steps that can be within the
    range are taken.
    """
    every = F.greatest(F.coalesce(interval, F.lit(1)), F.lit(1)).cast("int")
    step = F.when(freq == "DAILY", every).otherwise(every * 7)
    last = F.least(high - F.make_dt_interval(secs=F.lit(0.000001)), until)
    ended = lambda days: F.least(last, plus_days(start, days * (MOST_STEPS - 1)))
    on_days = lambda times: F.when(byday.isNull(), times).otherwise(F.filter(times, lambda t: F.coalesce(F.array_contains(byday, F.weekday(F.to_date(t)) + 1), F.lit(False))))
    once = F.filter(F.array(start), lambda t: (t >= low) & (t <= last))
    found = (
        F.when((freq == "WEEKLY") & byday.isNotNull(), _by_weekdays(byday, start, low, ended(F.lit(1))))
        .when(freq.isin("DAILY", "WEEKLY"), on_days(_by_days(step, start, low, ended(step))))
        .when(freq == "MONTHLY", on_days(_by_months(every, start, low, last)))
        .when(freq.isNotNull(), on_days(once))
    )
    none = start.isNull() | low.isNull() | high.isNull()
    most = F.when(count.isNull(), MOST_STEPS).otherwise(F.greatest(count, F.lit(0)))
    return F.when(freq.isNotNull() & none, F.array().cast("array<timestamp_ntz>")).otherwise(F.slice(found, 1, most))
