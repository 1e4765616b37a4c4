"""Conditions that many reads share, as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from recallspark.functions import calendar as c

#: After how many notes, and how many days, a question about oneself is due again.
EVERY_NOTES, EVERY_DAYS = 10, 7


def is_active(lifecycle: Column, metadata: Column) -> Column:
    """Open, and not marked as done or put away in its metadata."""
    status = F.get_json_object(metadata, "$.status")
    return (lifecycle == "open") & (status.isNull() | ~status.isin("completed", "archived"))


def never_stale(category: Column, metadata: Column, durable: Sequence[str] = ()) -> Column:
    """Of a durable kind, which the tenant's ontology names, or marked so."""
    kind = F.coalesce(category.isin(*durable), F.lit(False)) if durable else F.lit(False)
    return kind | F.get_json_object(metadata, "$.neverStale").eqNullSafe("true")


def is_stale(created: Column, category: Column, metadata: Column, now: str, days: int, durable: Sequence[str] = ()) -> Column:
    return (c.plus_days(created, days) < c.at(now)) & ~never_stale(category, metadata, durable)


def author_layer(author: Column, key_id: Column, label: Column) -> Column:
    """The layer a note belongs to: its key, else its label, else the coarse author."""
    return F.when(key_id.isNotNull(), F.concat(F.lit("apikey:"), key_id)).when(label.isNotNull(), F.concat(F.lit("label:"), label)).otherwise(author)


def reminder_at(start: Column, lead_minutes: Column, created: Column, zone: str) -> Column:
    """Start less the lead; without a start the next nine o'clock in the zone after the note was made."""
    local = F.from_utc_timestamp(created.cast("timestamp"), zone)
    today = F.to_utc_timestamp(F.date_trunc("day", local) + F.expr("interval 9 hour"), zone)
    nine = F.when(today > created.cast("timestamp"), today).otherwise(F.to_utc_timestamp(F.date_trunc("day", local) + F.expr("interval 33 hour"), zone))
    return F.coalesce(start - F.make_dt_interval(F.lit(0), F.lit(0), lead_minutes.cast("int")), nine.cast("timestamp_ntz"))


def question_due(notes: Column, last: Column, now: str) -> Column:
    """Every tenth note, if the last question is a week ago or there was none."""
    return (notes > 0) & (notes % EVERY_NOTES == 0) & (last.isNull() | (c.plus_days(last, EVERY_DAYS) <= c.at(now)))
