"""Roll-ups of usage, cost, review quality, agreement, queues and chats.

All take tables and, where time matters, the time as a parameter; none asks a clock. Groups are aggregated
before they are joined, so no join multiplies rows. Money is summed as decimals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallspark.operators.places import placed


def usd(amount: Column) -> Column:
    return F.round(amount.cast("double"), 6)


def spend_by_user(accounts: DataFrame, calls: DataFrame, ledger: DataFrame, *, kind: str | None = "production") -> DataFrame:
    """Each account with calls, cost, last call and credits spent; each side is aggregated first."""
    spent = calls.groupBy("user_id").agg(F.count("*").alias("calls"), F.sum("cost_usd").alias("cost"), F.max("created_at").alias("last_call_at")).where("cost > 0")
    debits = ledger.where("kind = 'usage_debit'").groupBy("user_id").agg(F.sum(F.abs("amount")).alias("credits"))
    rows = accounts if kind is None else accounts.where(F.col("account_kind") == kind)
    joined = rows.join(spent, "user_id", "left").join(debits, "user_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return joined.select("user_id", "name", "account_kind", zero("calls"), F.coalesce(usd(F.col("cost")), F.lit(0.0)).alias("cost_usd"), "last_call_at", zero("credits"))


def spend_totals(calls: DataFrame) -> DataFrame:
    return calls.agg(F.count("*").alias("calls"), F.countDistinct("user_id").alias("users"), F.coalesce(usd(F.sum("cost_usd")), F.lit(0.0)).alias("cost_usd"))


def bucket_unit(first: Column, last: Column) -> Column:
    """Days up to a month's span, weeks up to half a year's, else months."""
    days = F.datediff(last, first)
    return F.when(days <= 31, "day").when(days <= 180, "week").otherwise("month")


def spend_series(calls: DataFrame, unit: str) -> DataFrame:
    """Calls and cost by day, week (from Monday) or month, empty buckets included, first to last call.

    ``groups`` shares the distinct groups out in proportion to calls.
    """
    by = calls.groupBy(F.date_trunc(unit, "created_at").cast("timestamp_ntz").alias("bucket")).agg(F.count("*").alias("calls"), F.sum("cost_usd").alias("cost"))
    ends = calls.agg(F.date_trunc(unit, F.min("created_at")).cast("timestamp_ntz").alias("a"), F.date_trunc(unit, F.max("created_at")).cast("timestamp_ntz").alias("b"), F.count("*").alias("all_calls"), F.countDistinct("group_id").alias("all_groups"))
    step = {"day": F.expr("interval 1 day"), "week": F.expr("interval 7 day"), "month": F.expr("interval 1 month")}[unit]
    grid = ends.where("a is not null").select(F.explode(F.sequence("a", "b", step)).alias("bucket"), "all_calls", "all_groups")
    found = grid.join(by, "bucket", "left").withColumn("n", F.coalesce("calls", F.lit(0)))
    share = F.floor(F.col("n") * F.col("all_groups") / F.col("all_calls") + 0.5).cast("long")
    return found.select("bucket", F.col("n").cast("long").alias("calls"), F.coalesce(usd(F.col("cost")), F.lit(0.0)).alias("cost_usd"), share.alias("groups"))


def spend_series_by(calls: DataFrame, key: str) -> DataFrame:
    """``key, unit, bucket, calls, cost_usd``: for each key a series of its own, in the unit that suits its span, empty buckets included.

    The unit is chosen in the plan, from each key's first and last call; a key has some 60 buckets, or one a
    month of its span.
    """
    spans = calls.groupBy(key).agg(F.min("created_at").alias("first"), F.max("created_at").alias("last")).where("first is not null")
    spans = spans.withColumn("unit", bucket_unit(F.col("first"), F.col("last")))
    trunc = lambda at: F.call_function("date_trunc", F.col("unit"), at).cast("timestamp_ntz")
    # What a key has more than one row of is joined to the one row that it has of its span.
    by = calls.join(spans.select(key, "unit"), key).groupBy(key, trunc(F.col("created_at")).alias("bucket")).agg(F.count("*").alias("calls"), F.sum("cost_usd").alias("cost"))
    steps = {"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH"}
    whole = lambda unit: F.sequence(trunc(F.col("first")), trunc(F.col("last")), F.expr(steps[unit]))
    grid = spans.select(key, "unit", F.explode(F.when(F.col("unit") == "day", whole("day")).when(F.col("unit") == "week", whole("week")).otherwise(whole("month"))).alias("bucket"))
    found = grid.join(by, [key, "bucket"], "left")
    return found.select(key, "unit", "bucket", F.coalesce("calls", F.lit(0)).cast("long").alias("calls"), F.coalesce(usd(F.col("cost")), F.lit(0.0)).alias("cost_usd"))


def page(rows: DataFrame, order: Sequence[Column], size: int, number: int) -> DataFrame:
    """One page under a total order, with the whole count on each row; a page beyond the last is the last."""
    counted = rows.count()
    last = max(1, -(-counted // size))
    at = min(max(1, number), last)
    return rows.withColumn("total", F.lit(counted).cast("long")).withColumn("page", F.lit(at)).orderBy(*order).offset((at - 1) * size).limit(size)


def keyset_page(rows: DataFrame, time_col: str, id_col: str, before: tuple[str, object], size: int) -> DataFrame:
    """The ``size`` rows after a cursor in (time, id) descending order, and whether more follow."""
    t, i = F.lit(before[0]).cast(rows.schema[time_col].dataType), F.lit(before[1])
    more = rows.where((F.col(time_col) < t) | ((F.col(time_col) == t) & (F.col(id_col) < i))).orderBy(F.desc(time_col), F.desc(id_col)).limit(size + 1)
    placed = more.withColumn("place", F.row_number().over(Window.orderBy(F.desc(time_col), F.desc(id_col)))).withColumn("has_more", F.max("place").over(Window.partitionBy()) > size)
    return placed.where(F.col("place") <= size)


def activity_groups(calls: DataFrame, size: int, number: int) -> DataFrame:
    """A page of groups by first call, latest first, with their roll-ups; a call without a group is its own."""
    key = F.coalesce(F.concat(F.lit("g:"), F.col("group_id")), F.concat(F.lit("c:"), F.col("call_id").cast("string")))
    groups = calls.groupBy(key.alias("group_key")).agg(F.min("created_at").alias("first_at"), F.count("*").alias("calls"), usd(F.sum("cost_usd")).alias("cost_usd"))
    return page(groups, [F.desc("first_at"), F.asc("group_key")], size, number)


def cost_by_operation(calls: DataFrame) -> DataFrame:
    """Calls and cost by operation; blank names are 'unknown', missing and negative costs are zero."""
    name = F.coalesce(F.nullif(F.trim("operation"), F.lit("")), F.lit("unknown"))
    cost = F.greatest(F.coalesce("cost_usd", F.lit(0).cast("decimal(18,6)")), F.lit(0).cast("decimal(18,6)"))
    return calls.groupBy(name.alias("operation")).agg(F.count("*").alias("calls"), usd(F.sum(cost)).alias("cost_usd"), usd(F.sum(cost * F.lit("1.2").cast("decimal(3,1)"))).alias("charged_usd"))


def quality_totals(reviews: DataFrame) -> DataFrame:
    """Conditional counts in one pass. Scores are compared as 32-bit floats, as they are stored."""
    s = F.col("score").cast("float")
    at = lambda c, name: F.count_if(c).alias(name)
    return reviews.agg(
        F.count("*").alias("reviews"), at(F.col("verdict") == "up", "up"), at(F.col("verdict") == "down", "down"), F.count("reason").alias("with_reason"),
        at(s >= F.lit(0.9).cast("float"), "high"), at(s < F.lit(0.5).cast("float"), "low"), at((s < F.lit(0.5).cast("float")) & (F.col("verdict") == "up"), "low_but_up"), at((s >= F.lit(0.9).cast("float")) & (F.col("verdict") == "down"), "high_but_down"),
    )


def band(score: Column) -> Column:
    return F.when(score < 0.5, "<0.5").when(score < 0.7, "0.5-0.7").when(score < 0.9, "0.7-0.9").otherwise(">=0.9")


def quality_bands(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy(band(F.col("score")).alias("band")).agg(F.count("*").alias("reviews"), F.count_if(F.col("verdict") == "up").alias("up"), F.count("reason").alias("with_reason"))


def part_rows(reviews: DataFrame) -> DataFrame:
    return reviews.select("review_id", F.explode("parts").alias("p")).select("review_id", "p.part", "p.probability")


def part_bands(reviews: DataFrame) -> DataFrame:
    """Two steps: the least probability by review and part, then counts by part and band."""
    least = part_rows(reviews).groupBy("review_id", "part").agg(F.min("probability").alias("p"))
    return least.groupBy("part", band(F.col("p")).alias("band")).agg(F.count("*").alias("reviews"))


def weakest_part(reviews: DataFrame) -> DataFrame:
    """How often each part is a review's weakest; ties count for every one of them."""
    rows = part_rows(reviews).withColumn("least", F.min("probability").over(Window.partitionBy("review_id")))
    return rows.where("probability = least").groupBy("part").agg(F.countDistinct("review_id").alias("reviews"), F.round(F.avg("probability"), 6).alias("mean_probability"))


def agreement_by_kind(decisions: DataFrame) -> DataFrame:
    yes, no = F.count_if(F.coalesce("agree", F.lit(False))), F.count_if(F.coalesce(~F.col("agree"), F.lit(False)))
    return decisions.groupBy("kind").agg(F.count("*").alias("n"), (yes + no).alias("compared"), yes.alias("agreed"), no.alias("disagreed"), F.count("error").alias("errored"), F.round(F.try_divide(yes, yes + no), 6).alias("rate"))


def confusion_pairs(decisions: DataFrame, limit: int = 25) -> DataFrame:
    apart = decisions.where(F.col("agree").eqNullSafe(False) & F.col("model_choice").isNotNull())
    return apart.groupBy("kind", "model_choice", "rule_choice").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind", "model_choice", "rule_choice").limit(limit)


def latest_engine(decisions: DataFrame) -> DataFrame:
    last = F.struct("created_at", "event_id")
    return decisions.groupBy("kind").agg(F.max_by("engine", last).alias("engine"), F.max("created_at").alias("at"))


def queue_health(jobs: DataFrame, now: str) -> DataFrame:
    at = F.lit(now).cast("timestamp_ntz")
    waits = F.col("status") == "pending"
    due = waits & (F.col("run_after") <= at)
    oldest = F.min(F.when(due, F.col("run_after")))
    return jobs.agg(F.count_if(due).alias("due"), F.count_if(waits & (F.col("run_after") > at)).alias("later"), F.count_if(F.col("status") == "running").alias("running"), F.count_if(F.col("status") == "failed").alias("failed"), F.floor(F.unix_timestamp(F.lit(now)) - F.unix_timestamp(oldest)).cast("long").alias("oldest_seconds"))


def status_rollup(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("job_type", "status").agg(F.count("*").alias("n"))


#: Rank of each status in lists of jobs.
STATUS_ORDER = ("running", "pending", "failed", "completed")


def job_list(jobs: DataFrame, limit: int) -> DataFrame:
    """Jobs by class of status, then by due time."""
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(STATUS_ORDER) for x in (s, i)]), F.col("status")), F.lit(len(STATUS_ORDER)))
    return jobs.withColumn("status_rank", rank).orderBy("status_rank", F.asc_nulls_last("run_after"), "job_id").limit(limit)


def chat_sessions(chats: DataFrame) -> DataFrame:
    """Messages by session; the preview that sorts last among the user's, and the first by turn."""
    mine = F.col("role") == "user"
    return chats.groupBy("session_id").agg(F.count("content").alias("messages"), F.substring(F.max(F.when(mine, F.col("content"))), 1, 80).alias("preview"), F.substring(F.min_by(F.when(mine, F.col("content")), F.when(mine, F.col("turn"))), 1, 80).alias("first_message"))


def credit_meter(ledger: DataFrame) -> DataFrame:
    """Credits used since the latest top-up of each user."""
    top = ledger.where("kind = 'top_up' and amount > 0").groupBy("user_id").agg(F.max("created_at").alias("since"))
    joined = ledger.where("kind = 'usage_debit'").join(top, "user_id", "left").where("since is null or created_at > since")
    used = joined.groupBy("user_id").agg((-F.sum("amount")).alias("used"))
    return ledger.select("user_id").distinct().join(top, "user_id", "left").join(used, "user_id", "left").select("user_id", "since", F.coalesce("used", F.lit(0).cast("long")).alias("used"))


def micro_carry(calls: DataFrame, per_credit: int = 1000) -> DataFrame:
    """Whole credits charged at each call, the rest carried to the next, as differences of running sums."""
    micro = F.round(F.col("cost_usd").cast("double") * 1000).cast("long")
    run = Window.partitionBy("user_id").orderBy("created_at", "call_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = calls.withColumn("micro", micro).withColumn("sum", F.sum("micro").over(run))
    credits = F.floor(F.col("sum") / per_credit) - F.floor((F.col("sum") - F.col("micro")) / per_credit)
    return rows.select("call_id", "user_id", "micro", credits.cast("long").alias("credits"), F.pmod("sum", F.lit(per_credit)).cast("long").alias("carry"))


def board_scores(votes: DataFrame, ideas: DataFrame, voter: int) -> DataFrame:
    """Ideas with their votes' sum and one voter's own vote, whose filter stands in the join."""
    scores = votes.groupBy("idea_id").agg(F.sum("vote").alias("score"), F.count("*").alias("votes"))
    own = votes.where(F.col("voter_id") == voter).groupBy("idea_id").agg(F.max("vote").alias("own_vote"))
    joined = ideas.join(scores, "idea_id", "left").join(own, "idea_id", "left")
    return joined.select("idea_id", "title", F.coalesce("score", F.lit(0).cast("long")).alias("score"), F.coalesce("votes", F.lit(0).cast("long")).alias("votes"), "own_vote")


def trend(rows: DataFrame, order: str, value: str) -> DataFrame:
    """Mean of the first and the second half and the mean step between neighbours, of values that are not null.

    The steps between neighbours sum up to the last value less the first.
    """
    ranked = placed(rows.where(F.col(value).isNotNull()), [F.asc(order)], "r")
    numbered = ranked.crossJoin(ranked.agg(F.count("*").alias("n")))
    first = F.col("r") <= F.floor(F.col("n") / 2)
    ends = F.max_by(value, "r") - F.min_by(value, "r")
    return numbered.agg(F.round(F.avg(F.when(first, F.col(value))), 6).alias("first_half"), F.round(F.avg(F.when(~first, F.col(value))), 6).alias("second_half"), F.round(F.try_divide(ends, F.count("*") - 1), 6).alias("mean_step"))


def sorted_by(rows: DataFrame, asked: str | None, direction: str | None, *, allowed: tuple[str, ...], default: str, tie: str, key: str) -> DataFrame:
    """Rows by one of the allowed columns, the default for any other name; descending unless ``asc`` is asked; ties by a text, case aside, and a key."""
    column = asked if asked in allowed else default
    first = F.asc_nulls_last(column) if direction == "asc" else F.desc_nulls_last(column)
    return rows.orderBy(first, F.lower(tie), key)


def same_text(column: Column, said: str) -> Column:
    return F.lower(column) == said.lower()
