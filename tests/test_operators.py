"""Operators on small tables, where SQL has no form or the rule is easily got wrong."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from recallspark.api import Engine
from recallspark.functions import calendar as c
from recallspark.functions import text
from recallspark.operators import agenda, community, fuse, graph, lexical, links, metrics, retrieval, rollups, timeline, vector
from recallspark.operators.components import components
from recallspark.operators.places import placed
from recallspark.plans import evaluation
from recallspark.sources import exports
from recallspark.sources.tables import fixtures


def test_fold_and_tokens():
    assert text.lexical_text("  Größe\n ＡＢＣ  naïve ") == "grosse abc naive"
    assert text.query_tokens("Red-red RING, ring 2", least=1) == ["red", "ring", "2"]
    assert text.search_cues([" ab ", "abc", "x" * 81]) == ["abc"]


def test_folded_column(spark):
    df = spark.createDataFrame([("Straße",), (None,), ("plain",)], "t string")
    assert [r[0] for r in df.select(text.folded(F.col("t"))).collect()] == ["strasse", None, "plain"]


def test_months_overflow(spark):
    day = spark.sql("select timestamp_ntz'2026-03-31 10:30:00' t")
    got = day.select(c.overflow_months(F.col("t"), F.lit(-1)), c.overflow_months(F.col("t"), F.lit(1))).first()
    assert tuple(got) == (dt.datetime(2026, 3, 3, 10, 30), dt.datetime(2026, 5, 1, 10, 30))


def occurrences(spark, freq, interval, count, until, byday, start, low, high):
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    days = F.array(*map(F.lit, byday)) if byday else F.lit(None).cast("array<int>")
    column = c.occurrences(F.lit(freq), F.lit(interval).cast("int"), F.lit(count).cast("int"), t(until), days, t(start), t(low), t(high))
    return [x.strftime("%m-%d") for x in spark.range(1).select(column.alias("x")).first()["x"]]


def test_recurrences(spark):
    assert occurrences(spark, "WEEKLY", 2, None, None, None, "2024-01-01", "2024-01-10", "2024-02-20") == ["01-15", "01-29", "02-12"]
    # By weekdays the rule goes day by day, and the interval is not looked at.
    assert occurrences(spark, "WEEKLY", 2, 3, None, [1, 3], "2024-01-01", "2024-01-02", "2024-02-20") == ["01-03", "01-08", "01-10"]
    assert occurrences(spark, "MONTHLY", None, None, "2024-05-01", None, "2024-01-31", "2024-01-01", "2025-01-01") == ["01-31", "03-02", "04-02"]
    assert occurrences(spark, "YEARLY", None, None, None, None, "2024-01-31", "2024-01-01", "2025-01-01") == ["01-31"]


def test_active_period(spark):
    got = spark.range(1).select(c.active_period(F.lit('["2024-01-02 03:00:00","2024-01-03 00:00:00")')).alias("p")).first()["p"]
    assert tuple(got) == (dt.datetime(2024, 1, 2, 3), dt.datetime(2024, 1, 3))


def test_reciprocal_ranks(spark):
    rows = spark.createDataFrame([(0, 1, "a"), (0, 2, "a"), (0, 3, "b"), (1, 1, "b"), (1, 2, "c")], "list int, rank int, id string")
    got = [(r["id"], round(r["rrf"], 9)) for r in fuse.rrf(rows).orderBy(F.desc("rrf"), "first").collect()]
    assert got == [("b", round(1 / 62 + 1 / 61, 9)), ("a", round(1 / 61, 9)), ("c", round(1 / 62, 9))]


def test_score_of_a_bundle_and_of_time(spark):
    notes = spark.createDataFrame([(i, 0.0, 0.0, 0.0, 0.0, True, ["c"]) for i in range(4)], "id long, salience double, centrality double, specificity double, recency double, active boolean, communities array<string>")
    found = spark.createDataFrame([(0, None, None, 0.9, None, None, [2]), (1, None, None, 0.9, None, None, [2]), (2, None, None, 0.9, None, None, [2]), (3, None, None, None, None, 1.0, [5]), (9, 0.0, None, None, None, None, [0])], "id long, distance double, rank double, community_distance double, entity_distance double, temporal double, channels array<int>").withColumn("merge_pos", F.lit(1))
    got = {r["id"]: round(r["score"], 6) for r in retrieval.scored(found, notes).collect()}
    # A bundle's find alone: 0.42 * 0.2, less 0.05 and 0.02 for its crowded community; one by time alone gets 0.18 more.
    assert got == {0: 0.014, 1: 0.014, 2: 0.014, 3: 0.264}


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (20, 21), (7, 7)], "u long, v long")
    assert {(r["id"], r["component"]) for r in components(edges).collect()} == {(3, 3), (4, 3), (5, 3), (9, 3), (20, 20), (21, 20)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "u long, v long")
    assert {r["component"] for r in components(chain).collect()} == {0}


def test_communities():
    clique = lambda ids: [(a, b, 1.0) for a in ids for b in ids if a < b]
    nodes = list(range(9))
    rows = community.hierarchy(nodes, clique(range(4)) + clique(range(4, 8)) + [(3, 4, 0.1)])
    finest = {n: k for level, n, k in rows if level == 2}
    assert {finest[i] for i in range(4)} == {0} and {finest[i] for i in range(4, 8)} == {4} and finest[8] == 8
    assert len(rows) == 27
    coarse, fine = ({n: k for level, n, k in rows if level == want} for want in (0, 1))
    assert all(coarse[a] == coarse[b] for a in nodes for b in nodes if fine[a] == fine[b])


def test_communities_by_tenant(spark):
    nodes = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 7)], "tenant long, node long")
    edges = spark.createDataFrame([(1, 1, 2, 1.0)], "tenant long, a long, b long, weight double")
    got = {(r["tenant"], r["node"], r["community"]) for r in community.louvain(nodes, edges).where("level = 2").collect()}
    assert got == {(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 7, 7)}


def test_duplicates_keep_the_older(spark):
    rows = [(1, [1.0, 0.0], "x", False, 1), (2, [1.0, 0.01], "x", False, 2), (3, [1.0, 0.02], "x", False, 3), (4, [1.0, 0.0], "y", False, 4), (5, [1.0, 0.0], "x", True, 5)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, entity_type string, project boolean, created_at long")
    assert {(r["keep"], r["drop"]) for r in community.duplicates(df).collect()} == {(1, 2)}


def test_lexical_relation(spark):
    df = spark.createDataFrame([("Red", "red ring"), ("ring", "red ring"), ("blue", "red ring")], "a string, b string")
    assert [r[0] for r in df.select(graph.lexical_relation(F.col("a"), F.col("b"))).collect()] == ["part_of", "related_to", None]


def test_pages_beyond_the_end(spark):
    rows = spark.range(7)
    assert [r["id"] for r in rollups.page(rows, [F.asc("id")], 3, 99).collect()] == [6]
    assert rollups.page(rows.where("id < 0"), [F.asc("id")], 3, 5).count() == 0


def test_engine(spark, sf):
    from recallspark.api import Engine
    from recallspark.plans.retrieval import memory
    from recallspark.plans.vectors import query_vector
    from recallspark.sources import views as v

    mentions = v.mentions(spark, sf)
    engine = Engine.of_tenant(7, memory(spark, sf), thoughts=v.thoughts(spark, sf), events=v.events(spark, sf), mentions=mentions, entities=v.entities(spark, sf), edges=graph.comentions(mentions), calls=v.calls(spark, sf))
    assert {r["user_id"] for r in engine.events.select("user_id").distinct().collect()} <= {7}
    found = engine.search(query_vector(spark, sf), "the und para")
    assert "vec" not in found.columns and found.count() <= 20
    assert {r["id"] % 50 for r in engine.nearest(query_vector(spark, sf), 3).collect()} == {7}
    assert engine.solve("span", "2001-09-01").count() <= 1
    assert engine.graph_search("red ring", 5).count() <= 5


def test_week_plan(spark):
    from recallspark.operators import planner

    nine = 9 * 60
    assert planner.placed([("a", 90), ("b", 60)], [], 480) == [("a", nine, nine + 90), ("b", nine + 120, nine + 180)]
    # Nine o'clock is taken: the first item waits for the next day, the second takes ten.
    assert planner.placed([("a", 60), ("b", 60)], [(nine, nine + 30)], 480) == [("b", nine + 60, nine + 120), ("a", 1440 + nine, 1440 + nine + 60)]
    assert planner.placed([("a", 500)], [], 480) == []
    undated = spark.createDataFrame([(1, "x", None, 2), (1, "y", 30, 1), (2, "z", 30, 1)], "user_id long, event_id string, minutes int, focus int")
    busy = spark.createDataFrame([(2, "2024-01-01 08:00:00", "2024-01-06 00:00:00")], "user_id long, s string, e string").selectExpr("user_id", "cast(s as timestamp_ntz) start_at", "cast(e as timestamp_ntz) end_at")
    got = [(r["user_id"], r["event_id"], r["start_at"].strftime("%d %H:%M"), r["end_at"].strftime("%H:%M")) for r in planner.plan_week(undated, busy, "2024-01-01").orderBy("start_at").collect()]
    assert got == [(1, "y", "01 09:00", "09:30"), (1, "x", "01 10:00", "11:00")]


def test_weeks_of_many_users(spark):
    """Twenty thousand users, whose rows go to Python in batches: a call for each user took minutes."""
    import time

    from recallspark.operators import planner

    undated = spark.range(0, 60_000, 1, 4).selectExpr("id % 20000 AS user_id", "concat('e', id) AS event_id", "cast(30 + id % 5 * 30 AS int) AS minutes", "id AS focus")
    undated = undated.unionByName(spark.sql("SELECT null AS user_id, 'none' AS event_id, null AS minutes, 1 AS focus"))
    hour = lambda h: f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast({h} AS int))"
    busy = spark.range(0, 10_000, 1, 4).selectExpr("id * 2 AS user_id", f"{hour('9 + id % 3')} AS start_at", f"{hour('10 + id % 3')} AS end_at")
    began = time.monotonic()
    got = {}
    for r in planner.plan_week(undated, busy, "2024-01-01").collect():
        at = lambda t: (t.day - 1) * planner.DAY + t.hour * 60 + t.minute
        got.setdefault(r["user_id"], []).append((r["event_id"], at(r["start_at"]), at(r["end_at"])))
    assert time.monotonic() - began < 15
    assert got.pop(None) == [("none", 540, 600)]
    for user in range(20_000):
        taken = [(60 * (9 + user // 2 % 3), 60 * (10 + user // 2 % 3))] if user % 2 == 0 else []
        items = [(f"e{i}", 30 + i % 5 * 30) for i in range(user, 60_000, 20_000)]
        assert sorted(got[user]) == sorted(planner.placed(items, taken, 480))


def test_entity_resolution_takes_every_mention(spark):
    d = "/root/testdata/sf0.01"
    label = {r["p_partkey"]: r["p_name"].lower() for r in spark.read.parquet(f"{d}/part.parquet").collect()}
    ids, keys = {}, {}
    for i in sorted(label):
        ids.setdefault(label[i], i)
    aliases = {f"the {name}": i for name, i in ids.items() if i % 2 == 0}
    for r in spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_linenumber").collect():
        name = label.get(r["l_partkey"])
        if name is not None:
            key = (f"{name.split(' ')[0]} thing", f"the {name}", name)[r["l_linenumber"] % 3]
            mention = r["l_orderkey"] * 100_000 + r["l_partkey"]
            keys[mention] = min(key, keys.get(mention, key))
    got = {r["mention_id"]: (r["entity_id"], r["how"]) for r in evaluation.entity_resolution(spark, d).collect()}
    assert got.keys() == keys.keys()
    for mention, key in keys.items():
        want = (ids[key], "key") if key in ids else (aliases[key], "alias") if key in aliases else None
        assert got[mention] == want if want else got[mention][1] in ("context", "ambiguous", "new")


def test_louvain_levels_takes_every_entity_of_each_user(spark):
    d = "/root/testdata/sf0.01"
    owner = {r["o_orderkey"]: r["o_custkey"] for r in spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey").collect()}
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_partkey").collect()
    want = {(owner[r["l_orderkey"]], r["l_partkey"]) for r in rows if r["l_orderkey"] in owner}
    got = evaluation.louvain_levels(spark, d).collect()
    for level in range(3):
        assert {(r["tenant"], r["node"]) for r in got if r["level"] == level} == want


def small_memory(spark):
    notes = spark.createDataFrame([(1, 7, [1.0, 0.0], "red ring", True), (2, 7, [0.9, 0.1], "red", True), (3, 8, [1.0, 0.0], "red ring ring", True)], "id long, user_id long, vec array<double>, text string, active boolean")
    notes = notes.withColumns({"salience": F.lit(1.0), "centrality": F.lit(0.1), "specificity": F.lit(0.1), "recency": F.lit(0.5), "communities": F.array(F.lit("c"))})
    group = lambda name: spark.createDataFrame([("c", [1.0, 0.0], [3, 2, 1]), ("d", [0.0, 1.0], [3])], f"{name} string, vec array<double>, thought_ids array<long>")
    neighbors = spark.createDataFrame([(1, 3, 0.9), (1, 2, 0.5), (3, 1, 0.4)], "thought_id long, neighbor_id long, weight double")
    return retrieval.Memory(notes, group("community_id"), group("entity_id"), neighbors, spark.createDataFrame([(3, 1.0), (2, 0.5)], "id long, temporal double"))


def test_engine_shows_a_tenant_its_own_rows_alone(spark):
    m = small_memory(spark)
    mentions = spark.createDataFrame([(1, 10), (3, 10), (3, 11)], "thought_id long, entity_id long")
    entities = spark.createDataFrame([(10, 7, "red"), (11, 8, "ring")], "id long, user_id long, label string")
    edges = spark.createDataFrame([(10, 11), (10, 10)], "a long, b long")
    own = Engine.of_tenant(7, m, mentions=mentions, entities=entities, edges=edges)
    assert sorted(r["id"] for r in own.nearest([1.0, 0.0]).collect()) == [1, 2]
    assert sorted(r["id"] for r in own.lexical("red ring").collect()) == [1, 2]
    assert sorted(r["id"] for r in own.search([1.0, 0.0], "red ring").collect()) == [1, 2]
    assert [(r["community_id"], r["thought_ids"]) for r in own.memory.communities.collect()] == [("c", [2, 1])]
    assert [tuple(r) for r in own.mentions.collect()] == [(1, 10)] and [r["id"] for r in own.entities.collect()] == [10]
    assert [tuple(r) for r in own.edges.collect()] == [(10, 10)]
    none = Engine.of_tenant(99, m, mentions=mentions, entities=entities, edges=edges)
    for found in (none.nearest([1.0, 0.0]), none.lexical("red"), none.search([1.0, 0.0], "red ring"), none.mentions, none.entities, none.edges, none.memory.communities, none.memory.neighbors, none.memory.temporal):
        assert found.count() == 0
    with pytest.raises(ValueError, match="user_id"):
        Engine.of_tenant(7, retrieval.Memory(m.notes.drop("user_id"), m.communities, m.entities, m.neighbors, m.temporal))
    with pytest.raises(ValueError, match="calls"):
        Engine.of_tenant(7, m, calls=spark.range(3))


def test_rerank_hook_resolves_ids(spark):
    original = spark.createDataFrame([(1, 0.9), (2, 0.8), (3, 0.7)], "id long, score double")
    other = spark.createDataFrame([(3, 0.95), (4, 0.6)], "id long, score double")
    fused = fuse.expanded(original, [other])
    plain = [(r["id"], r["score"], r["original"]) for r in fuse.reranked(fused, 10).orderBy("place").collect()]
    assert plain == [(3, 0.95, True), (1, 0.9, True), (2, 0.8, True), (4, 0.6, False)]
    told = lambda rows: rows.select((F.lit(10) - F.col("id")).alias("place"), "id").where("id in (2, 4)").unionByName(spark.createDataFrame([(0, 99)], "place long, id long"))
    assert [r["id"] for r in fuse.reranked(fused, 10, told).orderBy("place").collect()] == [4, 2, 3, 1]


def test_search_of_items_and_groups(spark):
    df = spark.createDataFrame([("a", "Red ring", None, " p1 ", "Home", 10), ("b", None, "the RED one", "", None, None), ("c", "blue", "blue", "p1", " ", 5)], "event_id string, text string, summary string, project string, project_label string, minutes int")
    assert sorted(r["event_id"] for r in agenda.found(df, " red ", "text", "summary").collect()) == ["a", "b"]
    assert agenda.found(df, "  ", "text").count() == 3
    assert sorted((r["project"] or "", r["label"], r["items"], r["minutes"]) for r in agenda.by_project(df).collect()) == [("", None, 1, 30), ("p1", "Home", 2, 15)]


def test_places_and_fixtures(spark, tmp_path):
    rows = spark.range(1000).select(F.pmod(F.col("id") * 7, F.lit(1000)).alias("v"))
    assert sorted((r["v"], r["place"]) for r in placed(rows, [F.asc("v")]).collect()) == [(i, i + 1) for i in range(1000)]
    assert placed(rows.where("false"), [F.asc("v")]).count() == 0
    (tmp_path / "f.json").write_text('[{"id": 1, "text": "a"}, {"id": 2, "text": null}]')
    assert sorted(tuple(r) for r in fixtures(spark, str(tmp_path / "f.json"), "id long, text string").collect()) == [(1, "a"), (2, None)]


def test_strict_lift_fails_on_incomplete_questions(spark):
    rows = spark.createDataFrame([(1, "b", "evidence", 1), (1, "b", "none", 0), (2, "b", "evidence", 1)], "question long, bucket string, variant string, correct int")
    assert metrics.accuracy_lift(rows, "bucket").first()["lift"] == 1.0
    with pytest.raises(Exception, match="incomplete question 2"):
        metrics.accuracy_lift(rows, "bucket", strict=True).collect()


def test_snippet(spark):
    said = spark.createDataFrame([("  short  ",), ("x" * 400,), (None,)], "t string").select(text.snippet(F.col("t"))).collect()
    assert [r[0] for r in said] == ["short", "x" * 299 + "…", None]


def test_blocks_of_neighbours_are_brute_force(spark, monkeypatch):
    import random

    monkeypatch.setattr(vector, "BLOCK", 7)
    r = random.Random(5)
    rows = [(i, [r.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(3)], f"g{i % 2}") for i in range(60)] + [(60, [1.0, 1.0], "g0"), (61, [0.0, 0.0, 0.0], "g0")]
    df = spark.createDataFrame(rows, "id long, vec array<double>, g string")
    for same in (None, "g"):
        want = []
        for i, a, g in rows:
            near = []
            for j, b, h in rows:
                size = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
                if i != j and len(a) == len(b) and size and (same is None or g == h):
                    near.append((round(1 - sum(x * y for x, y in zip(a, b)) / size, 9), j))
            want += [(i, j, k) for k, (d, j) in enumerate(sorted(near)[:3], 1) if d <= 0.9]
        got = vector.knn_join(df, df, 3, 0.9, same=same).withColumn("d", F.round("distance", 9))
        assert sorted((x["id"], x["rank"]) for x in got.collect()) == sorted((i, k) for i, _, k in want)


def test_components_are_written_in_few_files(spark, monkeypatch):
    """Each round is a table of few rows; it is not dealt to a file for each shuffle partition."""
    from recallspark.operators import components as module

    files = []

    def counted(df, name):
        made = module_written(df, name)
        files.append(len(made.inputFiles()))
        return made

    module_written = module.written
    monkeypatch.setattr(module, "written", counted)
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        edges = spark.range(1000).selectExpr("id * 3 u", "id * 3 + 1 + id % 2 v")
        got = {r["id"]: r["component"] for r in components(edges).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {x: 3 * n for n in range(1000) for x in (3 * n, 3 * n + 1 + n % 2)}
    assert max(files) <= 2 * spark.sparkContext.defaultParallelism


def test_components_of_hubs(spark, monkeypatch):
    from recallspark.operators import components as module

    monkeypatch.setattr(module, "HUB", 20)
    pairs = [(1000, i) for i in range(100)] + [(i, i + 1) for i in range(200, 240)] + [(1000, 2000), (2000, 3000), (50, 300)] + [(400, 400 + i) for i in range(30)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = {i: 0 for i in [*range(100), 1000, 2000, 3000, 300]} | {i: 200 for i in range(200, 241)} | {i: 400 for i in range(400, 430)}
    assert got == want


def test_moves_in_a_sequence(spark):
    ranked = spark.createDataFrame([(p, t, i) for p in range(7) for i, t in enumerate("abcd", 1)], "project_id long, thought_id string, rank int")
    moves = spark.createDataFrame([(0, "d", 2, None), (1, "a", 99, None), (2, "a", -3, None), (3, "a", None, "c"), (4, "b", None, "x"), (5, "new", 1, None), (8, "only", 4, None)], "project_id long, thought_id string, to_rank int, after_id string")
    got = {}
    for r in sorted(timeline.reordered(ranked, moves).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["project_id"], []).append((r["rank"], r["thought_id"]))
    assert all([rank for rank, _ in rows] == list(range(1, len(rows) + 1)) for rows in got.values())
    assert {k: [t for _, t in rows] for k, rows in got.items()} == {0: list("adbc"), 1: list("bcda"), 2: list("abcd"), 3: list("bcad"), 4: list("acdb"), 5: ["new", *"abcd"], 6: list("abcd"), 8: ["only"]}


def test_what_follows_a_finished_task(spark):
    rows = [(1, "a", "completed", 1), (1, "b", "open", 2), (1, "c", "completed", 3), (1, "d", "open", 4), (2, "a", "completed", 1), (3, "x", "open", 1), (3, "x", "open", 3), (3, "y", "open", 2)]
    sequence = spark.createDataFrame(rows, "project_id long, thought_id string, lifecycle string, rank int")
    asked = [(1, "a"), (1, "a"), (1, "c"), (1, "d"), (1, "gone"), (2, "a"), (2, "gone"), (3, "x"), (4, "z"), (None, "z")]
    done = spark.createDataFrame([(*r, "more") for r in asked], "project_id long, thought_id string, lifecycle string")
    got = {(r["project_id"], r["thought_id"]): r["next_open"] for r in timeline.next_of(sequence, done).collect()}
    assert got == {(1, "a"): "b", (1, "c"): "d", (1, "d"): None, (1, "gone"): "b", (2, "a"): None, (2, "gone"): None, (3, "x"): "y", (4, "z"): None, (None, "z"): None}
    assert timeline.next_of(sequence.where("false"), done).where("next_open is not null").count() == 0


def test_clean_up(spark):
    make = spark.createDataFrame
    projects = make([(7, 1, None), (7, 2, None), (7, 3, "go"), (8, 4, "go")], "user_id long, entity_id long, next_action string")
    why = make([(1, "deadline"), (3, "milestone"), (99, "deadline")], "project_id long, reason string")
    late = make([(3, 30), (3, 30), (3, 31), (98, 5)], "entity_id long, thought_id long")
    loose = make([(i, 7, f"2024-01-0{i}") for i in range(1, 6)] + [(9, 8, None)], "id long, user_id long, created_at string")
    got = sorted((tuple(r) for r in timeline.cleanup(projects, why, late, loose, 2).collect()), key=str)
    want = [(7, "stalled", 1, None, "deadline"), (7, "stalled", 3, None, "milestone"), (7, "no_next_action", 2, None, None), (7, "overdue_tasks", 3, 2, None), (7, "unthreaded", None, 5, None), (7, "unthreaded_recent", 5, 1, None), (7, "unthreaded_recent", 4, 2, None), (8, "unthreaded", None, 1, None), (8, "unthreaded_recent", 9, 1, None)]
    assert got == sorted(want, key=str)
    none = [df.where("false") for df in (projects, why, late, loose)]
    assert timeline.cleanup(*none).count() == 0


def test_projects_that_people_made_are_not_merged_away(spark):
    linked = spark.createDataFrame([(1, 10, 0.5), (1, 20, 0.9), (2, 30, 0.1)], "thought_id long, entity_id long, salience double")
    merges = spark.createDataFrame([(10, 20), (30, 20), (20, 20)], "old_id long, new_id long")
    manual = spark.createDataFrame([(30,)], "id long")
    asked = {tuple(r) for r in timeline.merged_projects(linked, merges).collect()}
    own = {tuple(r) for r in timeline.merged_projects(linked, merges, manual).collect()}
    assert asked == {(1, 20, 0.9), (2, 20, 0.1)} and own == {(1, 20, 0.9), (2, 30, 0.1)}


def test_views_keep_what_has_no_start(spark):
    items = spark.createDataFrame([(1, None, None), (2, "2024-01-01", "2024-01-09"), (3, "2024-01-20", None), (4, "2023-12-01", None)], "id int, start_at string, end_at string")
    items = items.select("id", *[F.col(t).cast("timestamp_ntz").alias(t) for t in ("start_at", "end_at")])
    view = lambda n: {r["id"] for r in timeline.view_range(items, n, "2024-01-05").collect()}
    assert (view("past"), view("upcoming"), view("relevant"), view("all")) == ({2, 4}, {1, 2, 3}, {1, 2, 3}, {1, 2, 3, 4})


def test_label_hints(spark):
    texts = spark.createDataFrame([(1, "The Red ring, a RED Ring"), (2, None), (3, "")], "id long, text string")
    labels = spark.createDataFrame([(7, "red ring", "x"), (5, "Red  Ring", "x"), (6, "ring", "y"), (8, "rin", "y"), (9, "a", "y"), (4, None, "x"), (3, "red ring", "z")], "id long, label string, entity_type string")
    assert [tuple(r) for r in lexical.label_hints(texts, labels).orderBy("place").collect()] == [(1, 3, 1), (1, 5, 2), (1, 6, 3)]
    assert lexical.label_hints(texts, labels.limit(0)).collect() == []


def test_pairs_of_a_common_name_are_not_shuffled(spark):
    """2,000 texts and 2,000 labels of one name, ten of them with a second label: four million pairs."""
    texts = spark.range(2000).select("id", F.lit("Red ring").alias("text"))
    labels = spark.range(2010).select((F.col("id") % 2000).alias("id"), F.when(F.col("id") < 2000, "red ring").otherwise("ring").alias("label"))
    found = lexical.label_hits(texts, labels)
    got = found.groupBy("hits").agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.sum("entity_id").alias("entities")).collect()
    assert {tuple(r) for r in got} == {(1, 2000 * 1990, 1990 * 1999000, 2000 * (1999000 - 45)), (2, 2000 * 10, 10 * 1999000, 2000 * 45)}
    before = shuffled_records(spark)
    found.write.format("noop").mode("overwrite").save()
    assert shuffled_records(spark) - before < 100_000


def shuffled_records(spark):
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = store.stageList(None, False, False, none, None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_kinds_go_with_their_relations(spark):
    kinds = spark.createDataFrame([("a", False), ("b", False), ("c", True)], "kind string, protected boolean")
    relations = spark.createDataFrame([("a", "c"), ("a", "b"), ("b", "c"), (None, "c")], "from_kind string, to_kind string")
    kept, between = links.pruned_ontology(kinds, spark.createDataFrame([("a",)], "entity_type string"), relations)
    assert {r["kind"] for r in kept.collect()} == {"a", "c"} and {(r["from_kind"], r["to_kind"]) for r in between.collect()} == {("a", "c"), (None, "c")}


def test_finished_today_and_this_week(spark):
    done = spark.createDataFrame([(1, "2024-01-22 00:00:00"), (1, "2024-01-28 23:00:00"), (1, "2024-01-21 23:59:59"), (2, "2024-01-01 00:00:00"), (2, None)], "user_id long, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    assert [tuple(r) for r in timeline.completed_counts(done, "2024-01-28 12:00:00").collect()] == [(1, 1, 2)]


def test_graph_to_draw(spark):
    entities = spark.createDataFrame([(1, "a", "x", None), (2, None, None, "active"), (3, "c", "y", None), (4, "d", "y", None)], "id long, label string, entity_type string, project_status string")
    mentions = spark.createDataFrame([(10, 1), (10, 2), (11, 1), (11, 2), (12, 2), (12, 9)], "thought_id long, entity_id long")
    relations = spark.createDataFrame([(3, 3, "is"), (4, 1, None), (1, 77, "is"), (None, 1, "is")], "a long, b long, predicate string")
    nodes, edges = graph.drawing(entities, mentions, relations, most_nodes=1)
    assert {tuple(r) for r in edges.collect()} == {(1, 2, "co_mentioned (2)", "co_mention"), (4, 1, "related_to", "entity_relation")}
    assert {(r["id"], r["label"], r["subtype"]) for r in nodes.collect()} == {(1, "a", "x"), (2, "", "other"), (4, "d", "y")}
    nodes, edges = graph.drawing(entities.limit(0), mentions, relations)
    assert nodes.collect() == [] and edges.collect() == []


def test_newest_place_of_fixtures(spark):
    mapped = spark.createDataFrame([("f", 1, 10), ("f", 2, 11), ("f", 3, 12), ("g", 2, 99), ("h", 2, 10), ("h", 4, 10), (None, 2, 10)], "fixture_id string, run_id long, thought_id long")
    runs = spark.createDataFrame([(1, "u", "2024-01-01"), (2, "u", "2024-01-02"), (3, "v", "2024-01-03"), (4, "u", "2024-01-02")], "run_id long, eval_user string, created_at string")
    thoughts = spark.createDataFrame([(10, "u"), (11, "u"), (12, "u")], "id long, user_id string")
    assert {tuple(r) for r in graph.fixture_map(mapped, runs, thoughts).collect()} == {("f", 11, 2), ("h", 10, 4)}


def test_event_edges_leave_no_end_open(spark, tmp_path):
    entities = spark.createDataFrame([(1, "a")], "id long, label string")
    mentions = spark.createDataFrame([(10, 1, 0.5), (10, 1, 0.7), (11, None, 0.1)], "thought_id long, entity_id long, salience double")
    events = spark.createDataFrame([("x", 10), ("x", 10), ("y", 11), (None, 10), ("z", None)], "event_id string, thought_id long")
    path = exports.write_graph(entities, mentions, str(tmp_path / "g"), events)
    got = sorted(tuple(r) for r in exports.read_event_edges(spark, path).collect())
    assert got == [("t10", "vx", "occurs_in"), ("t11", "vy", "occurs_in"), ("vx", "e1", "involves")]


def test_count_before_an_anchor_is_brute_force(spark):
    import random

    r = random.Random(3)
    rows = [(r.randrange(3), r.randrange(12), r.choice([None, *range(6)])) for _ in range(120)]
    told = [(u, t, r.choice([None, *range(6)])) for u in range(4) for t in range(0, 14, 2)]
    made = lambda x: spark.createDataFrame(x, "user_id long, thought_id long, day int").select("user_id", "thought_id", F.date_add(F.lit("2024-01-01"), F.col("day")).cast("timestamp_ntz").alias("start_at"))
    first = {}
    for u, t, day in rows:
        if day is not None:
            first[u, t] = min(day, first.get((u, t), 99))
    want = sorted((u, t, sum(x == u and y != t and at is not None and d < at for (x, y), d in first.items())) for u, t, at in told)
    assert sorted(tuple(x) for x in timeline.solve_count(made(rows), made(told)).collect()) == want


def test_catalogue_by_scope(spark):
    at = lambda t: F.col(t).cast("timestamp_ntz").alias(t)
    projects = spark.createDataFrame([(1, "b", "active", "manual", "key", None, None), (2, "a", "active", None, "user", "2024-01-01", 5), (3, "c", "someday", None, "key", None, None), (4, None, None, None, None, None, None)], "id long, label string, project_status string, project_source string, layer string, target_date string, next_action long")
    projects = projects.select("id", "label", "project_status", "project_source", "layer", at("target_date"), "next_action")
    linked = spark.createDataFrame([(10, 2), (10, 2), (11, 3), (12, 1)], "thought_id long, entity_id long")
    thoughts = spark.createDataFrame([(10, "task", "open", "user"), (11, "task", "completed", "other"), (12, "note", "open", None)], "id long, category string, lifecycle string, layer string")
    stones = spark.createDataFrame([(1, "2024-01-01", None), (1, "2024-01-01", "2024-01-01"), (9, None, None)], "project_id long, target_date string, completed_at string").select("project_id", at("target_date"), at("completed_at"))
    shown = lambda scope: {r["id"]: tuple(r)[3:] for r in timeline.catalog(projects, linked, thoughts, stones, "2024-02-01", scope).collect()}
    every = {1: (0, 2, 1, "milestone", 0), 2: (1, 0, 0, "deadline", 1), 3: (0, 0, 0, None, 2), 4: (0, 0, 0, None, 3)}
    assert shown("all") == every
    assert shown("user") == {k: every[k] for k in (1, 2)}
    assert shown("key") == {k: every[k] for k in (1, 3)} and set(shown("other")) == {3} and shown("none") == {}


def test_digest_of_projects(spark):
    at = lambda *names: [F.col(t).cast("timestamp_ntz").alias(t) for t in names]
    linked = spark.createDataFrame([(1, 10, 7, "2024-01-05"), (1, 10, 7, "2024-01-06"), (1, 11, 7, "2023-01-01"), (2, 12, 7, "2023-01-01"), (3, 13, 7, None), (1, 14, 7, "2024-01-05")], "entity_id long, thought_id long, user_id long, linked_at string").select("entity_id", "thought_id", "user_id", *at("linked_at"))
    thoughts = spark.createDataFrame([(10, "note", "open", None), (11, "task", "completed", "2024-01-03"), (12, "task", "open", None), (13, "task", "open", None), (14, "note", "archived", None)], "id long, category string, lifecycle string, completed_at string").select("id", "category", "lifecycle", *at("completed_at"))
    events = spark.createDataFrame([(12, "2024-01-01", None), (12, "2024-01-02", None), (13, "2025-01-01", None)], "thought_id long, start_at string, end_at string").select("thought_id", *at("start_at", "end_at"))
    stones = spark.createDataFrame([(7, 4, "2024-01-02", "2024-01-03"), (7, 4, None, "2024-01-03"), (7, 3, "2023-01-01", "2023-01-02")], "user_id long, entity_id long, created_at string, updated_at string").select("user_id", "entity_id", *at("created_at", "updated_at"))
    got = timeline.project_digest(linked, thoughts, events, stones, "2024-01-01", "2024-01-10").orderBy("place").collect()
    assert [tuple(r) for r in got] == [(7, 1, 1, 1, 0, 0, 0, 1, True), (7, 2, 0, 0, 1, 0, 0, 2, False), (7, 4, 0, 0, 0, 1, 1, 3, False)]
    now = spark.createDataFrame([(7, 1, "a"), (7, 2, None), (7, 3, "c"), (7, 4, "d"), (7, 5, None)], "user_id long, entity_id long, next_action string")
    before = spark.createDataFrame([(7, 1, "a"), (7, 2, "b"), (7, 3, None), (7, 5, None)], "user_id long, entity_id long, next_action string")
    assert {r["entity_id"] for r in timeline.next_action_changes(now, before).collect()} == {2, 3}
