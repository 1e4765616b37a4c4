"""Queues with timers, lateness, merged batches and logged graphs against plain Python."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from recallspark.operators import changes
from recallspark.plans import evaluation
from recallspark.session import new_folder
from recallspark.streaming import arrivals, queues, streams

BEGAN = datetime.datetime(2024, 1, 1)
COMMANDS = "tenant long, seq long, at timestamp, op string, job_id long"


def plain_queue(commands, minutes, most, end):
    """All changes, command by command; ``end``: the last time that a timer has seen."""
    span, out, open_ = datetime.timedelta(minutes=minutes), [], {}

    def expire(tenant, now):
        for at, job in sorted((s["since"] + span, j) for j, s in open_.setdefault(tenant, {}).items() if s["status"] == "running" and s["since"] + span <= now):
            s = open_[tenant][job]
            s["status"] = "failed" if s["attempts"] >= most else "pending"
            out.append((tenant, job, s["status"], at, s["attempts"]))
            if s["status"] == "failed":
                del open_[tenant][job]

    for tenant, seq, at, op, job in sorted(commands, key=lambda c: c[1]):
        expire(tenant, at)
        jobs = open_[tenant]
        of = lambda status: next((j for j, s in sorted(jobs.items(), key=lambda x: x[1]["place"]) if s["status"] == status), None)  # noqa: B023, E731
        if op == "put" and job not in jobs:
            jobs[job] = {"status": "pending", "since": at, "attempts": 0, "place": seq}
            out.append((tenant, job, "pending", at, 0))
        elif op == "claim" and (j := of("pending")) is not None:
            jobs[j].update(status="running", since=at, attempts=jobs[j]["attempts"] + 1)
            out.append((tenant, j, "running", at, jobs[j]["attempts"]))
        elif op == "done":
            j = of("running") if job is None else job
            if j in jobs and jobs[j]["status"] == "running":
                out.append((tenant, j, "completed", at, jobs.pop(j)["attempts"]))
    for tenant in list(open_):
        expire(tenant, end)
    return sorted(out)


def commands(seed, n=160):
    rng, at, out = random.Random(seed), BEGAN, []
    for seq in range(n):
        at += datetime.timedelta(seconds=rng.randint(1, 240), microseconds=rng.randrange(10**6))
        op = rng.choice(["put", "put", "claim", "claim", "claim", "done"])
        out.append((rng.randrange(4), seq, at, op, seq if op == "put" else None))
    # Then one tenant alone goes on, so that only timers can tell what became of the others' jobs.
    return out + [(0, n + i, at + datetime.timedelta(minutes=6 * i), "put", n + i) for i in range(6)]


def run_queue(spark, rows, cuts, most=2):
    path = new_folder(spark, "changes")
    df = spark.createDataFrame(rows, COMMANDS)
    chunk = F.lit(0)
    for cut in cuts:
        chunk = chunk + F.when(F.col("seq") >= cut, 1).otherwise(0)
    with queues.kept_in_rocks(spark):
        arrivals.arriving(df, chunk, len(cuts) + 1, lambda stream, progress: streams.appended(queues.queue(stream, 10, most), path, progress))
    return sorted(map(tuple, spark.read.schema(queues.CHANGES).parquet(path).collect()))


def test_queue_goes_on_with_its_timers_after_a_restart(spark):
    rows = commands(1)
    want = plain_queue(rows, 10, 2, rows[-1][2].replace(microsecond=rows[-1][2].microsecond // 1000 * 1000))
    assert {w[2] for w in want} == {"pending", "running", "completed", "failed"}
    assert run_queue(spark, rows, [40, 90, len(rows) - 6]) == want
    assert run_queue(spark, rows, []) == want


def test_queue_changes_of_whole_tables(spark, sf):
    rows = [(r["tenant"], r["seq"], r["at"], r["op"], r["job_id"]) for r in evaluation.queue_commands(spark, sf).collect()]
    end = max(r[2] for r in rows)
    want = plain_queue(rows, 24 * 60, 3, end.replace(microsecond=end.microsecond // 1000 * 1000))
    assert sorted(map(tuple, evaluation.queue_changes(spark, sf).collect())) == want
    assert any(w[2] == "pending" and w[4] for w in want) and any(w[2] == "completed" for w in want)


def test_a_long_queue_is_not_looked_through_at_each_command():
    """Thirty thousand open jobs of one tenant: a look at all of them for each command took minutes."""
    began, hour = time.monotonic(), 3_600_000_000
    jobs = queues.Jobs({}, hour, 2)
    for n in range(30_000):
        jobs.take("put", n, n, n)
    for n in range(30_000):
        jobs.take("claim", None, hour + n, 30_000 + n)
    for n in range(10_000):
        jobs.take("done", None, hour + 40_000, 60_000 + n)
    jobs.expire(3 * hour)
    assert time.monotonic() - began < 5
    assert jobs.changes[60_000:70_000] == [(n, "completed", hour + 40_000, 1) for n in range(10_000)]
    assert jobs.changes[70_000:] == [(n, "pending", 2 * hour + n, 1) for n in range(10_000, 30_000)]


def test_rows_late_by_23_and_25_hours(spark):
    hour = lambda h: BEGAN + datetime.timedelta(hours=h)
    batches = [[(1, hour(100))], [(2, hour(77)), (3, hour(76)), (4, hour(75)), (5, None)], [(6, hour(130)), (7, hour(80))], [(8, hour(105)), (9, hour(107))]]
    parted = arrivals.Lateness(spark, "fire_at", 24, new_folder(spark, "lateness"))
    for n, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "id long, fire_at timestamp")
        parted(df, n)
        parted(df, n)  # a batch that comes again
    found = {name: sorted((r["id"], r["batch"]) for r in parted.rows(name, "id long, fire_at timestamp").collect()) for name in ("on_time", "late")}
    assert found == {"on_time": [(1, 0), (2, 1), (3, 1), (6, 2), (7, 2), (9, 3)], "late": [(4, 1), (5, 1), (8, 3)]}


def test_a_batch_that_comes_again_changes_nothing(spark):
    kept = arrivals.Versioned(spark, new_folder(spark, "sums"), ["k"], ["n"], ["top"], keep=3)
    made = lambda rows: spark.createDataFrame(rows, "k string, n long, top long")
    kept.add(made([("a", 1, 5), ("a", 1, 7), (None, 2, 1)]), 0)
    kept.add(made([("a", 1, 6), ("b", 4, 1)]), 1)
    want = [(None, 2, 1), ("a", 3, 7), ("b", 4, 1)]
    rows = lambda: sorted(map(tuple, kept.now().collect()), key=str)
    assert rows() == sorted(want, key=str)
    kept.add(made([("a", 1, 6), ("b", 4, 1)]), 1)
    assert rows() == sorted(want, key=str)
    for n in range(2, 6):
        kept.add(made([("a", 1, 1)]), n)
    assert kept.versions() == [3, 4, 5] and sum(r[1] for r in rows()) == 13


def plain_graph(log):
    nodes, edges = {}, {}
    for _, op, source, target, predicate, props in sorted(log, key=lambda r: r[0]):
        if source is None or (op in ("mention", "relate", "drop_edge") and target is None):
            continue
        if op == "node":
            nodes[source] = props
        elif op == "drop_node":
            nodes.pop(source, None)
            edges = {k: w for k, w in edges.items() if source not in k[:2]}
        elif op == "mention":
            nodes.setdefault(source, None)
            nodes.setdefault(target, None)
            edges[source, target, None] = 1
        elif op == "relate" and source in nodes and target in nodes:
            edges[source, target, predicate] = edges.get((source, target, predicate), 0) + 1
        elif op == "drop_edge":
            edges.pop((source, target, predicate), None)
    return nodes, edges


@pytest.mark.parametrize("seed", range(3))
def test_merged_log_is_the_rebuilt_graph(spark, seed):
    rng = random.Random(seed)
    some = [None, *"abcdefgh"]
    log = []
    for seq in range(400):
        op = rng.choice(["node", "mention", "relate", "relate", "relate", "drop_edge", "drop_node" if rng.random() < 0.3 else "node"])
        predicate = rng.choice(["p", "q"]) if op == "relate" else rng.choice(["p", "q", None]) if op == "drop_edge" else None
        log.append((seq, op, rng.choice(some[seq % 9 > 0 :]), rng.choice(some[seq % 7 > 0 :]) if op not in ("node", "drop_node") else None, predicate, rng.choice(["x", "y", None]) if op == "node" else None))
    df = spark.createDataFrame(log, changes.LOG)
    nodes, edges = plain_graph(log)
    for rows in (df, changes.compacted(df)):
        assert {r["id"]: r["props"] for r in changes.nodes(rows).collect()} == nodes
        assert {(r["source"], r["target"], r["predicate"]): r["weight"] for r in changes.edges(rows).collect()} == edges


def test_an_empty_log_is_an_empty_graph(spark):
    empty = spark.createDataFrame([], changes.LOG)
    assert changes.nodes(empty).collect() == [] and changes.edges(empty).collect() == [] and changes.compacted(empty).collect() == []
