"""Intervals met by days without a row for each day: covers of nested bins.

Bins of level l hold 2^l days. An interval is covered by the fewest bins, none of which overlap: at most two of
each level, so that ten years are some twenty rows and a day is one. A day lies in one bin of each level. An
interval and a day in it share exactly one bin, so the join is by equality and gives each pair once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of bins, and what is added to a day's number so that none is negative.
LEVELS, ORIGIN = 23, 1 << 22


def number(day: Column) -> Column:
    return (F.unix_date(F.to_date(day)) + ORIGIN).cast("long")


def cover(first: Column, last: Column) -> Column:
    """The bins (``level, bin``) of the days from ``first`` to ``last``, both included; null days have none."""
    bins = F.array().cast("array<struct<level:int,bin:bigint>>")
    start = F.struct(first.cast("long").alias("lo"), last.cast("long").alias("hi"), bins.alias("bins"))

    def step(s: Column, level: Column) -> Column:
        one = lambda at: F.array(F.struct(level.cast("int").alias("level"), at.alias("bin")))
        lo, hi, there = s["lo"], s["hi"], s["lo"] <= s["hi"]
        left, right = there & (lo % 2 == 1), there & (hi % 2 == 0) & ~((lo % 2 == 1) & (lo == hi))
        found = F.concat(s["bins"], F.when(left, one(lo)).otherwise(bins), F.when(right, one(hi)).otherwise(bins))
        up = lambda x: F.shiftright(x, 1)
        return F.struct(up(F.when(left, lo + 1).otherwise(lo)).alias("lo"), F.when(there, up(F.when(right, hi - 1).otherwise(hi))).otherwise(F.lit(-1).cast("long")).alias("hi"), found.alias("bins"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), start, step, lambda s: s["bins"])


def touching(events: DataFrame, days: DataFrame) -> DataFrame:
    """``events`` (start_at, end_at) with each ``day`` of ``days`` that they touch.

    An event lasts to just before its end, and at least its first day; without an end it is its first day
    alone, without a start it touches none.
    """
    last = F.greatest(F.to_date("start_at"), F.to_date(F.col("end_at") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0.000001))))
    bins = cover(number(F.col("start_at")), F.when(F.col("start_at").isNotNull(), number(last)))
    spread = events.select("*", F.inline(bins).alias("level", "bin"))
    level = F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level")
    asked = days.select("day", level).withColumn("bin", F.expr("shiftright(CAST(unix_date(day) AS BIGINT) + " + str(ORIGIN) + ", level)"))
    return spread.join(asked, ["level", "bin"]).drop("level", "bin")
