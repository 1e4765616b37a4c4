"""Dated events: windows, validity, the timeline solver, agendas, streaks and projects.

The time is always a parameter. The solver answers for all users at once: each question is an aggregate of
a user's events, so no user's timeline is gathered in one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallspark.functions import calendar as c
from recallspark.operators import intervals
from recallspark.operators.places import placed


def in_window(events: DataFrame, low: str, high: str) -> DataFrame:
    return events.where(c.overlaps(F.col("start_at"), F.col("end_at"), c.at(low), c.at(high)))


def in_range(events: DataFrame, low: str | None, high: str | None) -> DataFrame:
    """Closed bounds on times of which either may be missing; a missing side is open."""
    if low is not None:
        events = events.where(F.coalesce("end_at", "start_at").isNull() | (F.coalesce("end_at", "start_at") >= c.at(low)))
    if high is not None:
        events = events.where(F.coalesce("start_at", "end_at").isNull() | (F.coalesce("start_at", "end_at") <= c.at(high)))
    return events


def preset(events: DataFrame, name: str, now: str, ahead_days: int = 7) -> DataFrame:
    """past, upcoming, relevant (not over, and starting within some days) or all."""
    over = F.coalesce("end_at", "start_at") < c.at(now)
    if name == "past":
        return events.where(over)
    if name == "upcoming":
        return events.where(~over)
    if name == "relevant":
        return events.where(~over & (F.coalesce("start_at", "end_at") <= c.plus_days(c.at(now), ahead_days)))
    return events


def view_range(items: DataFrame, name: str, now: str, ahead_days: int = 7) -> DataFrame:
    """As a list on screen is cut: past has begun; items without a start stay in relevant and upcoming."""
    start, at = F.col("start_at"), c.at(now)
    ahead = F.coalesce("end_at", "start_at") >= at
    if name == "past":
        return items.where(start < at)
    if name == "upcoming":
        return items.where(start.isNull() | ahead)
    if name == "relevant":
        return items.where(start.isNull() | ahead | ((start >= at) & (start <= c.plus_days(at, ahead_days))))
    return items


def with_tasks(events: DataFrame, thoughts: DataFrame) -> DataFrame:
    """Events and open tasks that no event belongs to, as one list."""
    tasks = thoughts.where("category = 'task' and lifecycle = 'open'").join(events.select(F.col("thought_id").alias("id")).distinct(), "id", "left_anti")
    rows = tasks.select(F.concat(F.lit("task-"), F.col("id").cast("string")).alias("item_id"), F.col("id").alias("thought_id"), "user_id", F.lit("task").alias("kind"), F.col("created_at").alias("start_at"))
    return events.select(F.col("event_id").alias("item_id"), "thought_id", "user_id", "kind", "start_at").unionByName(rows)


def validity(events: DataFrame, now: str) -> DataFrame:
    """none, active or expired for each thought, by the latest end of its events."""
    last = events.groupBy("thought_id").agg(F.max("end_at").alias("last_end"))
    return last.withColumn("status", F.when(F.col("last_end").isNull(), "none").when(F.col("last_end") <= c.at(now), "expired").otherwise("active"))


def solve_ordering(events: DataFrame) -> DataFrame:
    """Each user's first and last event, where there are two."""
    order = F.struct("start_at", "event_id")
    found = events.groupBy("user_id").agg(F.min_by("event_id", order).alias("earliest"), F.max_by("event_id", order).alias("latest"), F.count("*").alias("n"))
    return found.where("n >= 2").drop("n")


def solve_multi_ordering(events: DataFrame, least: int = 3) -> DataFrame:
    """Every event's place in its user's order, where there are three or more."""
    mine = Window.partitionBy("user_id")
    place = F.row_number().over(mine.orderBy("start_at", "event_id"))
    return events.select("user_id", "event_id", place.alias("place"), F.count("*").over(mine).alias("n")).where(F.col("n") >= least).drop("n")


def solve_duration(events: DataFrame) -> DataFrame:
    """Days (with and without the last), weeks and months between each user's first and last event."""
    ends = events.groupBy("user_id").agg(F.min("start_at").alias("a"), F.max("start_at").alias("b")).where("a < b")
    a, b = F.col("a"), F.col("b")
    return ends.select("user_id", c.days_between(a, b).alias("days"), (c.days_between(a, b) + 1).alias("days_inclusive"), c.weeks_between(a, b).alias("weeks"), c.months_between(a, b).alias("months"))


def solve_count(events: DataFrame, anchors: DataFrame) -> DataFrame:
    """How many other thoughts of the user have an event before the anchor's (``user_id, thought_id, start_at``).

    Thoughts' first events and anchors stand on one line a user, which a running count walks once; the anchor's
    own thought is taken off where its first event is earlier. An anchor without a time has none before it.
    """
    first = events.groupBy("user_id", "thought_id").agg(F.min("start_at").alias("at")).where("at is not null")
    told = anchors.select("user_id", F.col("start_at").alias("at"), F.col("thought_id").alias("anchor"), F.lit(0).cast("long").alias("n"))
    line = told.unionByName(first.select("user_id", "at", F.col("thought_id").alias("anchor"), F.lit(1).cast("long").alias("n")))
    # At one time anchors come first, so that only what is earlier counts.
    running = F.sum("n").over(Window.partitionBy("user_id").orderBy("at", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = line.withColumn("before", running).where("n = 0")
    own = first.select("user_id", F.col("thought_id").alias("anchor"), F.col("at").alias("own_at"))
    itself = F.coalesce((F.col("own_at") < F.col("at")).cast("long"), F.lit(0).cast("long"))
    return counted.join(own, ["user_id", "anchor"], "left").select("user_id", "anchor", (F.col("before") - itself).alias("before"))


def solve_lookback(events: DataFrame, now: str) -> DataFrame:
    first = events.groupBy("user_id").agg(F.min("start_at").alias("a"))
    return first.select("user_id", *[f(F.col("a"), c.at(now)).alias(n) for n, f in (("days", c.days_between), ("weeks", c.weeks_between), ("months", c.months_between))])


def solve_span(events: DataFrame) -> DataFrame:
    ends = events.groupBy("user_id").agg(F.min("start_at").alias("a"), F.max("start_at").alias("b")).where("a < b")
    months = c.months_between(F.col("a"), F.col("b"))
    return ends.select("user_id", F.floor(months / 12).cast("int").alias("years"), (months % 12).alias("months"))


def overdue(items: DataFrame, now: str) -> DataFrame:
    """Open items whose end has passed: days past, minutes owed (60 where not told) and a bucket."""
    days = c.days_between(F.col("end_at"), c.at(now))
    bucket = F.when(days < 1, "today").when(days <= 7, "week").when(days <= 30, "month").otherwise("older")
    return items.where(F.col("end_at") < c.at(now)).withColumns({"days_past": days, "prior_day": days >= 1, "owed": F.coalesce("minutes", F.lit(60)), "bucket": bucket})


def streaks(done: DataFrame, now: str, most: int = 30, zone: str = "UTC") -> DataFrame:
    """Each user's days in a row up to now's day (or the day before) with something done: gaps and islands."""
    days = done.select("user_id", c.day_key(F.col("at"), zone).alias("day")).distinct()
    today = c.day_key(c.at(now), zone)
    recent = days.where((F.col("day") <= today) & (F.col("day") > F.date_sub(today, most)))
    island = F.date_sub("day", F.row_number().over(Window.partitionBy("user_id").orderBy("day")))
    runs = recent.withColumn("island", island).groupBy("user_id", "island").agg(F.count("*").alias("streak"), F.max("day").alias("last"))
    return runs.where(F.col("last") >= F.date_sub(today, 1)).select("user_id", "streak")


def completed_counts(done: DataFrame, now: str, zone: str = "UTC") -> DataFrame:
    """What each user finished on now's day and since its Monday; who finished nothing since has no row."""
    day, today = c.day_key(F.col("at"), zone), c.day_key(c.at(now), zone)
    week = done.select("user_id", day.alias("day")).where(F.col("day") >= F.date_sub(today, F.weekday(today)))
    return week.groupBy("user_id").agg(F.count_if(F.col("day") == today).alias("today"), F.count("*").alias("this_week"))


def stalled(projects: DataFrame, milestones: DataFrame, now: str) -> DataFrame:
    """Why an active project stands still: its deadline or a milestone has passed, or nothing comes next."""
    late = milestones.where(F.col("completed_at").isNull() & (F.col("target_date") < c.at(now))).select("project_id").distinct().withColumn("_late", F.lit(True))
    rows = projects.where("project_status = 'active'").join(late, "project_id", "left")
    why = F.when(F.col("target_date") < c.at(now), "deadline").when(F.col("_late"), "milestone").when(F.col("next_action").isNull(), "no_next_action")
    return rows.select("project_id", why.alias("reason")).where("reason is not null")


def open_threads(thoughts: DataFrame, sequence: DataFrame, members: DataFrame, limit: int = 50) -> DataFrame:
    """Open tasks in no project's sequence or membership, the oldest first."""
    rows = thoughts.where("category = 'task' and lifecycle = 'open'")
    for other in (sequence, members):
        rows = rows.join(other.select(F.col("thought_id").alias("id")), "id", "left_anti")
    return rows.orderBy("created_at", "id").limit(limit)


def digest(thoughts: DataFrame, done: DataFrame, events: DataFrame, low: str, high: str) -> DataFrame:
    """New thoughts, tasks done and events of each user in a period."""
    within = lambda df, t: df.where((F.col(t) >= c.at(low)) & (F.col(t) < c.at(high)))
    sides = [within(df, t).groupBy("user_id").agg(F.count("*").alias(n)) for df, t, n in ((thoughts, "created_at", "new_thoughts"), (done, "at", "tasks_done"), (events, "start_at", "events"))]
    rows = sides[0].join(sides[1], "user_id", "full").join(sides[2], "user_id", "full")
    return rows.na.fill(0, ["new_thoughts", "tasks_done", "events"])


def pattern_mix(thoughts: DataFrame, now: str, days: int = 21) -> DataFrame:
    """Thoughts by day and category over the last days."""
    rows = thoughts.where((F.col("created_at") >= c.plus_days(c.at(now), -days)) & (F.col("created_at") < c.at(now)))
    return rows.groupBy(F.to_date("created_at").alias("day"), "category").agg(F.count("*").alias("n"))


def pattern_activity(thoughts: DataFrame, members: DataFrame, names: DataFrame, today: str, days: int = 21) -> DataFrame:
    """How many thoughts of the last days, today's included, fall on each day, category and community.

    ``members`` has ``thought_id, community_id``, ``names`` ``community_id, name``; communities without a name are
    left out, those of one name add up. Places within a kind are by count, then key; days stand in their order.
    """
    rows = thoughts.where(F.to_date("created_at") >= F.date_sub(F.to_date(c.at(today)), days - 1))
    named = rows.select(F.col("id").alias("thought_id")).join(members, "thought_id").join(names, "community_id")
    keys = {"day": (rows, F.to_date("created_at").cast("string")), "category": (rows, F.col("category")), "community": (named, F.col("name"))}
    counts = [df.groupBy(key.alias("key")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "key", "n") for kind, (df, key) in keys.items()]
    every = counts[0].unionByName(counts[1]).unionByName(counts[2])
    first = F.when(F.col("kind") == "day", 0).otherwise(-F.col("n"))
    return every.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(first, "key")))


def project_digest(links: DataFrame, thoughts: DataFrame, events: DataFrame, milestones: DataFrame, since: str, now: str, top: int = 3) -> DataFrame:
    """What moved in each project since a time, and whether it is among its owner's most active.

    ``links`` (``entity_id, thought_id, user_id, linked_at``) are memberships. New are thoughts linked since then,
    open or completed; done are tasks completed since; overdue are open tasks with an event whose start or end
    has passed. Milestones made since are added, those only touched since are changed. The order is by new
    and done together, then overdue, then id; projects where nothing moved have no row.
    """
    at, clock = c.at(since), c.at(now)
    rows = links.join(thoughts.select(F.col("id").alias("thought_id"), "category", "lifecycle", "completed_at"), "thought_id")
    late = events.where((F.col("end_at") < clock) | (F.col("start_at") < clock)).select("thought_id").distinct().withColumn("late", F.lit(True))
    task = F.col("category") == "task"
    marks = {
        "new_thoughts": (F.col("linked_at") >= at) & F.col("lifecycle").isin("open", "completed"),
        "tasks_done": task & (F.col("lifecycle") == "completed") & (F.col("completed_at") >= at),
        "overdue_tasks": task & (F.col("lifecycle") == "open") & F.col("late"),
    }
    # A thought that is linked to a project more than once is counted once.
    one = rows.join(late, "thought_id", "left").groupBy("user_id", "entity_id", "thought_id").agg(*[F.max(F.coalesce(x, F.lit(False)).cast("int")).alias(n) for n, x in marks.items()])
    counts = one.groupBy("user_id", "entity_id").agg(*[F.sum(n).alias(n) for n in marks])
    added = F.coalesce(F.col("created_at") >= at, F.lit(False))
    steps = milestones.where(added | (F.col("updated_at") >= at)).groupBy("user_id", "entity_id").agg(F.count_if(added).alias("milestones_added"), F.count_if(~added).alias("milestones_changed"))
    names = [*marks, "milestones_added", "milestones_changed"]
    busy = counts.join(steps, ["user_id", "entity_id"], "full").na.fill(0, names).where(" + ".join(names) + " > 0")
    score = F.col("new_thoughts") + F.col("tasks_done")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(score.desc(), F.desc("overdue_tasks"), "entity_id"))
    return busy.withColumn("place", place).withColumn("top", (F.col("place") <= top) & (score > 0))


def cleanup(projects: DataFrame, why: DataFrame, late: DataFrame, loose: DataFrame, recent: int = 3) -> DataFrame:
    """``user_id, kind, id, n, note``: what the digest asks each user to tidy up.

    Of ``projects`` (``user_id, entity_id, next_action``): ``stalled`` ones with their reason (``why``: project_id,
    reason), those with ``no_next_action`` that are not stalled, and those with ``overdue_tasks`` (``late``:
    entity_id, thought_id, a task counted once) with their number. Of open tasks in no project (``loose``:
    id, user_id, created_at) their number, and the most ``recent`` ones with their places. A user's projects
    that need nothing have no row, and a user without loose tasks has no count of them.
    """
    reasons = why.select(F.col("project_id").alias("entity_id"), "reason")
    own = projects.select("user_id", "entity_id", "next_action").join(reasons, "entity_id", "left")
    row = lambda df, kind, key, n, note: df.select("user_id", F.lit(kind).alias("kind"), key.alias("id"), n.cast("long").alias("n"), note.cast("string").alias("note"))
    null, project = F.lit(None), F.col("entity_id")
    counts = late.groupBy("entity_id").agg(F.countDistinct("thought_id").alias("n")).where("n > 0")
    first = loose.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id")))).where(F.col("n") <= recent)
    parts = [
        row(own.where("reason is not null"), "stalled", project, null, F.col("reason")),
        row(own.where("reason is null and next_action is null"), "no_next_action", project, null, null),
        row(projects.join(counts, "entity_id"), "overdue_tasks", project, F.col("n"), null),
        row(loose.groupBy("user_id").agg(F.count("*").alias("n")), "unthreaded", null.cast("long"), F.col("n"), null),
        row(first, "unthreaded_recent", F.col("id"), F.col("n"), null),
    ]
    return reduce(DataFrame.unionByName, parts)


def next_action_changes(projects: DataFrame, before: DataFrame) -> DataFrame:
    """Projects (``user_id, entity_id, next_action``) whose next action is not what the last digest recorded.

    Projects that it did not record are not compared; a next action that came or went is a change.
    """
    old = before.select("user_id", "entity_id", F.col("next_action").alias("was"))
    rows = projects.select("user_id", "entity_id", F.col("next_action").alias("now")).join(old, ["user_id", "entity_id"])
    return rows.where(~F.col("was").eqNullSafe(F.col("now")))


def catalog(projects: DataFrame, links: DataFrame, thoughts: DataFrame, milestones: DataFrame, now: str, scope: str = "all") -> DataFrame:
    """Projects with open tasks, milestones and why they stand still; ``sort_rank``, then label, is their order.

    ``projects`` has ``id, label, project_status, project_source, layer, target_date, next_action``, ``thoughts``
    ``id, category, lifecycle, layer``. Scope ``all`` shows each; ``user`` those that people made or grounded, or
    with a thought of the user; any other scope is an author's layer: those it made or has a thought in.
    """
    if scope != "all":
        by = thoughts.where(F.col("layer") == scope).select(F.col("id").alias("thought_id"))
        touched = links.join(by, "thought_id", "left_semi").select(F.col("entity_id").alias("id")).distinct().withColumn("touched", F.lit(True))
        made = F.coalesce("project_source", F.lit("capture")).isin("manual", "grounding") if scope == "user" else F.coalesce(F.col("layer") == scope, F.lit(False))
        projects = projects.join(touched, "id", "left").where(made | F.col("touched")).drop("touched")
    tasks = thoughts.where("category = 'task' and lifecycle = 'open'").select(F.col("id").alias("thought_id"))
    counted = links.select("thought_id", "entity_id").distinct().join(tasks, "thought_id", "left_semi").groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("open_tasks"))
    steps = milestones.groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias("milestones"), F.count_if(F.col("completed_at").isNotNull()).alias("milestones_done"))
    why = stalled(projects.withColumnRenamed("id", "project_id"), milestones, now).select(F.col("project_id").alias("id"), "reason")
    rows = projects.join(counted, "id", "left").join(steps, "id", "left").join(why, "id", "left").na.fill(0, ["open_tasks", "milestones", "milestones_done"])
    active = F.col("project_status") == "active"
    rank = F.when(active & F.col("next_action").isNull(), 0).when(active, 1).when(F.col("project_status") == "someday", 2).otherwise(3)
    return rows.select("id", "label", "project_status", "open_tasks", "milestones", "milestones_done", F.col("reason").alias("stalled"), rank.alias("sort_rank"))


def now_candidates(thoughts: DataFrame, events: DataFrame, skipped: DataFrame, limit: int) -> DataFrame:
    """Open tasks with their first event and the count of all of them beside the cut list."""
    first = events.groupBy("thought_id").agg(F.min("start_at").alias("first_event"))
    rows = thoughts.where("category = 'task' and lifecycle = 'open'").join(skipped.select("id"), "id", "left_anti")
    total = rows.agg(F.count("*").alias("total"))
    cut = rows.join(first, rows.id == first.thought_id, "left").orderBy(F.desc("salience"), "id").limit(limit)
    return cut.select("id", "salience", "first_event").join(F.broadcast(total), F.lit(True))


def section(start: Column, end: Column, now: str, zone: str = "UTC") -> Column:
    """Where an item stands on the agenda."""
    today, day = c.day_key(c.at(now), zone), c.day_key(start, zone)
    return (
        F.when(start.isNull(), "unscheduled")
        .when(day == today, "today")
        .when(F.coalesce(end, start) < c.at(now), "past")
        .when(day == F.date_add(today, 1), "tomorrow")
        .when(day < F.date_add(today, 7), "this_week")
        .otherwise("later")
    )


#: What each section weighs in the order of attention.
FOCUS = {"today": 100, "tomorrow": 300, "this_week": 500, "later": 800, "unscheduled": 900, "past": 1000}


def focus_rank(items: DataFrame, now: str, most: int) -> DataFrame:
    """Score of attention (less is sooner) by section, deadline, task and how short it is; the first few of each user."""
    scored = items.withColumn("section", section(F.col("start_at"), F.col("end_at"), now))
    base = F.element_at(F.create_map(*[F.lit(x) for kv in FOCUS.items() for x in kv]), F.col("section"))
    less = F.when(F.col("kind") == "deadline", 50).otherwise(0) + F.when(F.coalesce("minutes", F.lit(60)) <= 15, 30).otherwise(0)
    order = Window.partitionBy("user_id").orderBy("focus", F.asc_nulls_last("start_at"), "event_id")
    ranked = scored.withColumn("focus", base - less).withColumn("place", F.row_number().over(order))
    return ranked.withColumn("now", F.col("place") <= most)


def on_days(events: DataFrame, days: DataFrame) -> DataFrame:
    """Events by the days they touch, by way of a few bins for each event, however long it is."""
    return intervals.touching(events, days)


def matrix(items: DataFrame, kinds: list[str]) -> DataFrame:
    """Counts by quadrant, empty ones and the unclassified included."""
    grid = items.sparkSession.createDataFrame([(k,) for k in [*kinds, "unclassified"]], "quadrant string")
    found = items.groupBy(F.coalesce("quadrant", F.lit("unclassified")).alias("quadrant")).agg(F.count("*").alias("n"))
    return grid.join(found, "quadrant", "left").select("quadrant", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def engage(items: DataFrame, tags: list[str], energies: list[str], minutes: int) -> DataFrame:
    rows = items.where(F.coalesce("minutes", F.lit(30)) <= minutes)
    if tags:
        rows = rows.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    return rows.where(F.col("energy").isin(*energies)) if energies else rows


def tab_counts(items: DataFrame, now: str) -> DataFrame:
    open_, late = F.col("lifecycle") == "open", F.coalesce(F.col("end_at") < c.at(now), F.lit(False))
    return items.groupBy("user_id").agg(F.count_if(open_).alias("open"), F.count_if(F.col("lifecycle") == "completed").alias("done"), F.count_if(open_ & late).alias("overdue"), F.count_if(open_ & ~late).alias("todo"))


def project_cards(links: DataFrame, thoughts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Projects by their newest item, then the catalogue's empty ones by label."""
    items = links.join(thoughts.select(F.col("id").alias("thought_id"), "created_at", "lifecycle"), "thought_id")
    found = items.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("items"), F.count_if(F.col("lifecycle") == "open").alias("open_items"), F.max("created_at").alias("newest"))
    rows = catalog.join(found, "id", "left").select("id", "label", F.coalesce("items", F.lit(0).cast("long")).alias("items"), F.coalesce("open_items", F.lit(0).cast("long")).alias("open_items"), "newest")
    return placed(rows, [F.desc_nulls_last("newest"), F.asc("label"), F.asc("id")])


def gantt(items: DataFrame, group: str) -> DataFrame:
    """Bars in percent of their group's range, cut to 0..100 and never thinner than a half."""
    ends = items.groupBy(group).agg(F.min("start_at").alias("lo"), F.max("end_at").alias("hi"))
    span = (F.unix_micros(F.col("hi").cast("timestamp")) - F.unix_micros(F.col("lo").cast("timestamp"))).cast("double")
    part = lambda t: 100 * (F.unix_micros(F.col(t).cast("timestamp")) - F.unix_micros(F.col("lo").cast("timestamp"))) / span
    cut = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(100.0))
    return items.join(ends, group).withColumn("left", F.round(cut(part("start_at")), 6)).withColumn("width", F.round(F.greatest(cut(part("end_at")) - cut(part("start_at")), F.lit(0.5)), 6))


def month_grid(spark, year: int, month: int) -> DataFrame:
    """The 42 days of a month's sheet, from the Monday on or before its first."""
    first = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    start = F.date_sub(first, F.weekday(first))
    return spark.range(42).select(F.col("id").cast("int").alias("cell"), F.date_add(start, F.col("id").cast("int")).alias("day")).withColumn("inside", F.month("day") == month)


def pattern_graph(cited: DataFrame, links: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """Edges among the entities that the most cited thoughts mention."""
    top = links.join(cited.select("thought_id"), "thought_id", "left_semi").groupBy("entity_id").agg(F.countDistinct("thought_id").alias("n")).orderBy(F.desc("n"), "entity_id").limit(most)
    keep = lambda df, col: df.join(top.select(F.col("entity_id").alias(col)), col, "left_semi")
    return keep(keep(edges, "a"), "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def next_after(sequence: DataFrame) -> DataFrame:
    """For each finished task of a sequence the next open one."""
    ahead = Window.partitionBy("project_id").orderBy("rank").rowsBetween(1, Window.unboundedFollowing)
    rows = sequence.withColumn("next_open", F.first(F.when(F.col("lifecycle") == "open", F.col("thought_id")), ignorenulls=True).over(ahead))
    return rows.where("lifecycle = 'completed'").select("project_id", "thought_id", "next_open")


def next_of(sequence: DataFrame, done: DataFrame) -> DataFrame:
    """For each finished task (``project_id, thought_id``) the open one to go on with, or null.

    It is the next open one behind a task of the sequence. A task that is not in its project's sequence,
    because it never was or has been pruned since, is followed by the first open one. The finished task itself
    may still be marked open; it is not its own follower unless it comes again.
    """
    ahead = Window.partitionBy("project_id").orderBy("rank").rowsBetween(1, Window.unboundedFollowing)
    mine = F.when(F.col("lifecycle") == "open", F.col("thought_id"))
    # Only the first place of a task that is twice in a list counts.
    placed = sequence.withColumn("follower", F.first(mine, ignorenulls=True).over(ahead)).groupBy("project_id", "thought_id").agg(F.min_by("follower", "rank").alias("follower"))
    first = sequence.where("lifecycle = 'open'").groupBy("project_id").agg(F.min_by("thought_id", "rank").alias("first_open"))
    rows = done.select("project_id", "thought_id").distinct().join(placed.withColumn("listed", F.lit(True)), ["project_id", "thought_id"], "left").join(first, "project_id", "left")
    return rows.select("project_id", "thought_id", F.when(F.col("listed"), F.col("follower")).otherwise(F.col("first_open")).alias("next_open"))


def appended(ranked: DataFrame, more: DataFrame) -> DataFrame:
    """A ranked list with further items after its end, in the order of their ids."""
    top = ranked.groupBy("project_id").agg(F.max("rank").alias("top"))
    tail = more.join(ranked.select("project_id", "thought_id"), ["project_id", "thought_id"], "left_anti").join(top, "project_id", "left")
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("thought_id"))
    return ranked.select("project_id", "thought_id", "rank").unionByName(tail.select("project_id", "thought_id", (F.coalesce("top", F.lit(0)) + place).alias("rank")))


def renumbered(ranked: DataFrame) -> DataFrame:
    """``project_id, thought_id, rank`` with ranks from 1 without gaps."""
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("rank", "thought_id"))
    return ranked.select("project_id", "thought_id", place.alias("rank"))


def reordered(ranked: DataFrame, moves: DataFrame) -> DataFrame:
    """Lists after one move a project (``project_id, thought_id, to_rank, after_id``).

    A task goes to a rank, which is cut to the list's ends, else behind another task of the list, else to the
    end; it need not have been in the list. Projects without a move keep their order.
    """
    rest = renumbered(ranked.join(moves.select("project_id", "thought_id"), ["project_id", "thought_id"], "left_anti"))
    m = moves.select("project_id", F.col("thought_id").alias("moved"), "to_rank", "after_id")
    told = rest.join(m, "project_id").groupBy("project_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("thought_id") == F.col("after_id"), F.col("rank"))).alias("behind"))
    n = F.coalesce("n", F.lit(0))
    ahead = F.when(F.col("to_rank").isNotNull(), F.greatest(F.lit(0), F.least(n, F.floor("to_rank") - 1))).otherwise(F.coalesce("behind", n)).cast("int")
    put = m.join(told, "project_id", "left").select("project_id", F.col("moved").alias("thought_id"), ahead.alias("ahead"))
    shifted = rest.join(put.select("project_id", "ahead"), "project_id", "left").withColumn("rank", F.col("rank") + F.coalesce((F.col("rank") > F.col("ahead")).cast("int"), F.lit(0)))
    return shifted.drop("ahead").unionByName(put.select("project_id", "thought_id", (F.col("ahead") + 1).alias("rank")))


def without_completed(sequence: DataFrame) -> DataFrame:
    """Lists (with ``lifecycle``) of open tasks alone, numbered anew."""
    return renumbered(sequence.where("lifecycle = 'open'"))


def merged_projects(links: DataFrame, merges: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """Links moved from merged projects to the ones they went into, each thought once.

    A merge that nobody asked for is given ``manual``: projects (``id``) that people made are not merged away.
    """
    into = merges.where("old_id <> new_id").select(F.col("old_id").alias("entity_id"), "new_id")
    if manual is not None:
        into = into.join(manual.select(F.col("id").alias("entity_id")), "entity_id", "left_anti")
    moved = links.join(into, "entity_id", "left").withColumn("entity_id", F.coalesce("new_id", "entity_id")).drop("new_id")
    return moved.groupBy("thought_id", "entity_id").agg(F.max("salience").alias("salience"))
