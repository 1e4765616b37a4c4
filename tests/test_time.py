"""Recurrence rules, intervals by days, series by account and optional conditions."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from recallspark.functions import calendar, filters, recurrence
from recallspark.operators import intervals, rollups
from recallspark.plans import conditions, timeline

DAY = dt.timedelta(days=1)


def plain_rule(freq, interval, count, until, byday, start, low, high):
    """Day by day: whether a rule holds on it."""
    every, found, at = max(1, interval or 1), [], start
    if byday is not None and not byday:
        return []
    monday = start.date() - (start.isoweekday() - 1) * DAY
    while at < high:
        months = (at.year - start.year) * 12 + at.month - start.month
        on = not byday or at.isoweekday() in byday
        holds = {
            "DAILY": (at - start).days % every == 0 and on,
            "WEEKLY": (at.date() - monday).days // 7 % every == 0 and (on if byday else at.isoweekday() == start.isoweekday()),
            "MONTHLY": months % every == 0 and (on if byday else at.day == start.day),
            "YEARLY": months % (12 * every) == 0 and at.day == start.day and on,
        }.get(freq, at == start and freq is not None)
        if holds:
            found.append(at)
        at += DAY
    if count is not None:
        found = found[: max(0, count)]
    return [(t, n) for n, t in enumerate(found, 1) if t >= low and (until is None or t <= until)]


def test_strict_rules_are_those_of_the_calendar(spark):
    rng, low, high = random.Random(2), dt.datetime(2024, 2, 1), dt.datetime(2025, 6, 1)
    rows = []
    for i in range(160):
        start = dt.datetime(2020 + i % 5, rng.randint(1, 12), rng.choice([1, 15, 28, 29 if i % 5 in (0, 4) else 28]), 9, 30)
        if rng.random() < 0.3:
            start = start.replace(month=rng.choice([1, 3, 5, 7]), day=31)
        byday = rng.choice([None, None, [], rng.sample(range(1, 8), rng.randint(1, 3))])
        rows.append((i, rng.choice(["DAILY", "WEEKLY", "MONTHLY", "YEARLY", "HOURLY", None]), rng.choice([None, 0, 1, 2, 3, 5]), rng.choice([None, None, 0, 3, 40]), rng.choice([None, dt.datetime(2024, 9, 9, 9, 30)]), byday, start))
    df = spark.createDataFrame(rows, "id long, freq string, interval int, count int, until timestamp_ntz, byday array<int>, start timestamp_ntz")
    got = {}
    for r in recurrence.expanded(df, F.lit(low).cast("timestamp_ntz"), F.lit(high).cast("timestamp_ntz")).collect():
        got.setdefault(r["id"], []).append((r["at_time"], r["n"]))
    want = {i: plain_rule(f, e, n, u, b, s, low, high) for i, f, e, n, u, b, s in rows}
    assert sum(map(len, want.values())) > 300
    assert {i: sorted(t) for i, t in got.items()} == {i: t for i, t in want.items() if t}


def test_strict_rules_of_whole_tables(spark, sf):
    low, high = dt.datetime(1998, 6, 1), dt.datetime(1999, 3, 1)
    want = []
    for r in timeline.rules(spark, sf).collect():
        want += [(r["id"], *x) for x in plain_rule(r["freq"], r["interval"], r["count"], r["until"], r["byday"], r["start"], low, high)]
    assert len(want) > 1000 and sorted(map(tuple, timeline.rrule_strict(spark, sf).collect())) == sorted(want)


def test_days_that_events_touch(spark):
    rng, base = random.Random(5), dt.datetime(2019, 12, 30)
    at = lambda days, seconds=0: base + dt.timedelta(days=days, seconds=seconds)
    rows = [(i, s := at(rng.randint(-40, 40), rng.choice([0, 1, 43200, 86399])), s + dt.timedelta(seconds=rng.choice([0, 1, 86400, 86401, 86400 * rng.randint(1, 90), -5]))) for i in range(150)]
    rows += [(200, dt.datetime(1950, 1, 1), dt.datetime(2060, 1, 1)), (201, at(0), at(1)), (202, at(1), at(2)), (203, at(1), None), (204, None, at(2)), (205, None, None)]
    days = [base.date() + i * DAY for i in range(-60, 60)] + [dt.date(1960, 2, 29)]
    want = []
    for i, s, e in rows:
        if s is not None:
            last = max(s.date(), (e - dt.timedelta(microseconds=1)).date()) if e is not None else s.date()
            want += [(i, d) for d in days if s.date() <= d <= last]
    events = spark.createDataFrame(rows, "id long, start_at timestamp_ntz, end_at timestamp_ntz")
    got = intervals.touching(events, spark.createDataFrame([(d,) for d in days], "day date"))
    assert got.columns == ["id", "start_at", "end_at", "day"]
    assert sorted((r["id"], r["day"]) for r in got.collect()) == sorted(want)


def test_ten_years_are_few_bins(spark):
    df = spark.createDataFrame([(dt.date(2014, 3, 7), dt.date(2024, 5, 9)), (dt.date(2024, 1, 1), dt.date(2024, 1, 1))], "a date, b date")
    bins = [r[0] for r in df.select(intervals.cover(intervals.number(F.col("a")), intervals.number(F.col("b")))).collect()]
    assert len(bins[0]) <= 22 and len(bins[1]) == 1
    assert sum(1 << b["level"] for b in bins[0]) == (dt.date(2024, 5, 9) - dt.date(2014, 3, 7)).days + 1


def test_each_account_has_the_unit_of_its_span(spark):
    at = lambda d: dt.datetime(2024, 1, 1) + d * DAY
    rows = [("a", at(0)), ("a", at(10)), ("b", at(0)), ("b", at(100)), ("c", at(0)), ("c", at(400)), ("d", at(3)), ("e", None)]
    df = spark.createDataFrame([(k, t, 1.5) for k, t in rows], "account string, created_at timestamp_ntz, cost_usd double")
    found = {}
    for r in rollups.spend_series_by(df, "account").collect():
        found.setdefault((r["account"], r["unit"]), []).append((r["calls"], r["cost_usd"]))
    assert {k: len(v) for k, v in found.items()} == {("a", "day"): 11, ("b", "week"): 15, ("c", "month"): 14, ("d", "day"): 1}
    assert all(sum(n for n, _ in v) == (1 if k[0] == "d" else 2) for k, v in found.items())


def test_conditions_that_are_not_asked_for_leave_no_trace(spark, sf):
    rows = conditions._authored(spark, sf)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan(filters.thoughts(rows, active=None, author=None, tenant=None))
    one = filters.thoughts(spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey AS id", "o_custkey AS user_id", "o_orderdate AS created_at", "o_orderpriority AS category"), tenant=7, date_from="1996-01-01", active=None)
    before = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    said = one._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.maxMetadataStringLength", before)
    assert "PushedFilters" in said and "EqualTo(o_custkey,7)" in said and "GreaterThanOrEqual(o_orderdate" in said
    with pytest.raises(ValueError, match="no such conditions: colour"):
        filters.thoughts(rows, colour="red")
    with pytest.raises(ValueError, match="layer"):
        filters.thoughts(rows, layer="team:x")
    assert len(filters.thoughts(rows, 10_000, active=False).collect()) == 100


def test_a_rule_takes_only_steps_of_its_range(spark):
    """Forty thousand monthly rules over two months: taking 500 steps of each took minutes."""
    began = time.monotonic()
    start = F.lit("1980-01-31 09:30:00").cast("timestamp_ntz") + F.make_dt_interval((F.col("id") % 400).cast("int"))
    low, high, none = (F.lit(t).cast("timestamp_ntz") for t in ("1999-01-01", "1999-03-01", None))
    times = calendar.occurrences(F.lit("MONTHLY"), (F.col("id") % 3 + 1).cast("int"), F.lit(None).cast("int"), none, F.lit(None).cast("array<int>"), start, low, high)
    got = {(r["step"], r["start"]): r["times"] for r in spark.range(0, 40_000, 1, 4).select((F.col("id") % 3 + 1).alias("step"), start.alias("start"), times.alias("times")).distinct().collect()}
    assert time.monotonic() - began < 20 and len(got) == 1200
    for (step, at), found in got.items():
        want = []
        while at < dt.datetime(1999, 3, 1):
            want += [at] * (at >= dt.datetime(1999, 1, 1))
            month = at.year * 12 + at.month - 1 + step
            at = dt.datetime(month // 12, month % 12 + 1, 1, 9, 30) + (at.day - 1) * DAY
        assert found == want
