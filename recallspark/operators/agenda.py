"""Views of a list of dated items: today, upcoming, open to-do, week, tags, projects, lifecycle and search.

Items have ``event_id, start_at, end_at, minutes, lifecycle`` and what a view asks for beside. The time and
the zone are parameters. A missing lifecycle counts as open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallspark.functions import calendar as c
from recallspark.operators.timeline import section

#: Energy levels in their order, minutes of an item that tells none, and rows previewed.
ENERGY, MINUTES = ("deep", "medium", "light"), 30


def _done() -> Column:
    return F.coalesce(F.col("lifecycle") == "completed", F.lit(False))


def _prior_day(now: str, zone: str) -> Column:
    """Not done, and ended on a day before today."""
    return ~_done() & F.coalesce(c.day_key(F.col("end_at"), zone) < c.day_key(c.at(now), zone), F.lit(False))


def today(items: DataFrame, now: str, zone: str = "UTC") -> DataFrame:
    """Today's and undated items, and those done that started today."""
    where = section(F.col("start_at"), F.col("end_at"), now, zone)
    return items.where(where.isin("today", "unscheduled") | (_done() & F.coalesce(c.day_key(F.col("start_at"), zone) == c.day_key(c.at(now), zone), F.lit(False))))


def upcoming(items: DataFrame, now: str, zone: str = "UTC") -> DataFrame:
    return items.where(~_done() & section(F.col("start_at"), F.col("end_at"), now, zone).isin("tomorrow", "this_week", "later"))


def today_todo(items: DataFrame, now: str, zone: str = "UTC") -> DataFrame:
    """What is open of today's view, and open items overdue from earlier days; each item once, as one filter tells both."""
    where = section(F.col("start_at"), F.col("end_at"), now, zone)
    return items.where((~_done() & where.isin("today", "unscheduled")) | _prior_day(now, zone))


def open_todo(items: DataFrame, now: str, zone: str = "UTC") -> DataFrame:
    """The same for lists with ``snoozed_until``: what is snoozed shows only if it is overdue from an earlier day."""
    where = section(F.col("start_at"), F.col("end_at"), now, zone)
    awake = F.col("snoozed_until").isNull() | (F.col("snoozed_until") <= c.at(now))
    return items.where((~_done() & awake & where.isin("today", "unscheduled")) | _prior_day(now, zone))


def merged(items: DataFrame, overdue: DataFrame) -> DataFrame:
    """Items and overdue ones that the list did not hold, by id."""
    return items.unionByName(overdue.dropDuplicates(["event_id"]).join(items.select("event_id"), "event_id", "left_anti").select(*items.columns))


def estimated_minutes(items: DataFrame, *by: str) -> DataFrame:
    return items.groupBy(*by).agg(F.sum(F.coalesce("minutes", F.lit(MINUTES)).cast("long")).alias("minutes"))


def distinct_tags(items: DataFrame) -> DataFrame:
    """Trimmed tags, each once, empty ones left out."""
    return items.select(F.explode("tags").alias("tag")).select(F.trim("tag").alias("tag")).where("tag <> ''").distinct()


def energy_levels(items: DataFrame) -> DataFrame:
    """Levels that occur, with their place in the fixed order."""
    place = F.array_position(F.array(*map(F.lit, ENERGY)), F.col("energy"))
    return items.select("energy", place.cast("int").alias("place")).where("place > 0").distinct()


def by_project(items: DataFrame) -> DataFrame:
    """Count, minutes and label of each project; items without one under a null project.

    A group is told by sums, not gathered: its items are a filter on ``project`` away.
    """
    project = F.nullif(F.trim(F.col("project").cast("string")), F.lit(""))
    rows = items.withColumn("project", project).groupBy("project").agg(F.count("*").alias("items"), F.sum(F.coalesce("minutes", F.lit(MINUTES)).cast("long")).alias("minutes"), F.min(F.nullif(F.trim("project_label"), F.lit(""))).alias("label"))
    return rows.select("project", F.when(F.col("project").isNotNull(), F.coalesce("label", "project")).alias("label"), "items", "minutes")


def found(items: DataFrame, said: str, *columns: str) -> DataFrame:
    """Items one of whose texts holds what is said, case aside; all items for nothing said."""
    needle = said.strip().lower()
    if not needle:
        return items
    hits = [F.coalesce(F.contains(F.lower(F.col(x)), F.lit(needle)), F.lit(False)) for x in columns]
    return items.where(sum((h.cast("int") for h in hits), F.lit(0)) > 0)


def kanban(status: Column) -> Column:
    return F.when(status.isin("completed", "archived"), status).otherwise("open")


def week_placements(instances: DataFrame, monday: str, first_hour: int = 6, last_hour: int = 22, zone: str = "UTC") -> DataFrame:
    """Instances (``start_at, end_at``) on the sheet of a week: its day (0 to 6), and minutes of the day cut to the sheet's hours.

    What lies outside the hours on its day is not placed; a missing end is an hour on.
    """
    end = F.coalesce("end_at", F.col("start_at") + F.make_dt_interval(F.lit(0), F.lit(1)))
    day = F.datediff(c.day_key(F.col("start_at"), zone), F.to_date(F.lit(monday)))
    since = lambda t: (F.unix_micros(t.cast("timestamp")) - F.unix_micros(F.date_trunc("day", "start_at").cast("timestamp"))) / 60_000_000
    rows = instances.withColumn("day", day).where(F.col("day").between(0, 6))
    rows = rows.withColumns({"from_minute": F.greatest(since(F.col("start_at")), F.lit(60.0 * first_hour)), "to_minute": F.least(since(end), F.lit(60.0 * last_hour))})
    return rows.where("to_minute > from_minute")
