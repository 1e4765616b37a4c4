"""A night's jobs against the same jobs done in plain Python."""

import pytest

from recallspark.operators import community, nightly
from recallspark.plans import links

NIGHT = "2024-03-01"


def plain_members(nodes, edges, merged):
    """Rows of one owner's communities after the merges."""
    end = lambda i: end(merged[i]) if i in merged else i
    moved = {}
    for a, b, w in edges:
        a, b = sorted((end(a), end(b)))
        if a != b:
            moved[a, b] = moved.get((a, b), 0.0) + (1.0 if w is None else w)
    levels = {}
    for level, node, c in community.hierarchy(sorted(set(nodes) - set(merged)), sorted((a, b, w) for (a, b), w in moved.items())):
        levels[level, node] = f"1:{level}:{c}"
    return sorted((c, levels.get((level - 1, node)), level, node) for (level, node), c in levels.items()), moved


@pytest.fixture
def tables(spark):
    # 1, 2 and 3 are nearly one; 4 is near by vector but of another type, 5 is a project.
    near = {1: 0.0, 2: 0.05, 3: 0.1, 4: 0.05, 5: 0.0}
    entities = [(i, 1, "tool" if i == 4 else "name", i, i == 5, [1.0, near[i]] if i in near else [0.0, 1.0, float(i)][:2] if i == 6 else None) for i in range(1, 13)]
    return {
        "thoughts": spark.createDataFrame([(t, "2024-01-01", "task" if t % 2 else "note", "open", 1.0) for t in range(10)], "id long, created_at string, category string, lifecycle string, salience double").selectExpr("id", "cast(created_at as timestamp_ntz) created_at", "category", "lifecycle", "salience", "cast(null as timestamp_ntz) last_accessed_at", "false never_stale"),
        "entities": spark.createDataFrame(entities, "id long, tenant long, entity_type string, created_at long, project boolean, vec array<double>"),
        "kinds": spark.createDataFrame([("name", False), ("tool", False), ("unused", False)], "kind string, protected boolean"),
        "links": spark.createDataFrame([(t, e, 0.1 * e) for t in range(10) for e in (t % 3 + 1, t % 12 + 1)], "thought_id long, entity_id long, salience double").dropDuplicates(["thought_id", "entity_id"]),
        "edges": spark.createDataFrame([(1, 2, 2.0), (2, 7, 1.0), (7, 3, None), (8, 9, 2.0), (9, 10, 1.0), (8, 10, 1.0), (4, 99, 5.0), (11, 11, 3.0)], "a long, b long, weight double"),
    }


def done(spark, tables, before, summaries):
    return nightly.nightly(*tables.values(), NIGHT, spark.createDataFrame(before, "community_id string, entity_id long"), spark.createDataFrame(summaries, "community_id string, generated_at string").selectExpr("community_id", "cast(generated_at as timestamp_ntz) generated_at"))


def test_one_night(spark, tables):
    made = done(spark, tables, [], [])
    merged = {r["old_id"]: r["new_id"] for r in made["merges"].collect()}
    assert merged and all(new == 1 for new in merged.values()) and not {1, 4, 5} & merged.keys()
    want, moved = plain_members(range(1, 13), [tuple(r) for r in tables["edges"].where("b <> 99").collect()], merged)
    assert sorted(((r["a"], r["b"]), r["weight"]) for r in made["relations"].collect()) == sorted(moved.items())
    assert sorted((tuple(r) for r in made["members"].collect()), key=str) == sorted(want, key=str)
    plain = {}
    for t, e, s in (tuple(r) for r in tables["links"].collect()):
        k = t, merged.get(e, e)
        plain[k] = max(s, plain.get(k, 0.0))
    assert {(r["thought_id"], r["entity_id"]): r["salience"] for r in made["links"].collect()} == plain
    assert {r["kind"] for r in made["kinds"].collect()} == {"name", "tool"}
    assert {r["id"] for r in made["entities"].collect()} == set(range(1, 13)) - merged.keys()
    assert {r["community_id"] for r in made["bundles"].collect()} == {c for c, *_ in want}
    assert made["features"].count() == 10


def test_the_next_night_asks_for_what_changed(spark, tables):
    first = done(spark, tables, [], [])
    members = [(r["community_id"], r["entity_id"]) for r in first["members"].collect()]
    due = {r["community_id"] for r in first["pending"].collect()}
    assert due
    old = [(c, "2024-02-01") for c, _ in members]
    assert done(spark, tables, members, sorted(set(old)))["pending"].count() == 0
    # One community had another member last night.
    one = sorted(due)[0]
    assert {r["community_id"] for r in done(spark, tables, [*members, (one, 1000)], sorted(set(old)))["pending"].collect()} == {one}
    # No summary at all, nothing changed.
    assert {r["community_id"] for r in done(spark, tables, members, [])["pending"].collect()} == due


def test_a_night_over_nothing(spark, tables):
    made = done(spark, {n: df.where("false") for n, df in tables.items()}, [], [])
    assert all(df.count() == 0 for df in made.values())


def test_the_query_is_plain_python(spark, sf):
    made = links.night(spark, sf)
    merged = {r["old_id"]: r["new_id"] for r in made["merges"].collect()}
    from recallspark.operators import graph
    from recallspark.sources import views as v

    edges = [(r["a"], r["b"], float(r["weight"])) for r in graph.comentions(v.mentions(spark, sf)).where("weight >= 2").collect()]
    want, _ = plain_members([r["id"] for r in v.entities(spark, sf).collect()], edges, merged)
    assert sorted((tuple(r) for r in made["members"].collect()), key=str) == sorted(want, key=str)
