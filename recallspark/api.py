"""One object with a method for each read of a memory, over tables that the caller opens."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallspark.functions import text
from recallspark.operators import graph, lexical, links, retrieval, rollups, timeline, vector


@dataclass
class Engine:
    """Tables of one tenant. ``memory`` is what retrieval reads; the others may be left out where not asked."""

    memory: retrieval.Memory
    thoughts: DataFrame | None = None
    events: DataFrame | None = None
    mentions: DataFrame | None = None
    entities: DataFrame | None = None
    edges: DataFrame | None = None
    calls: DataFrame | None = None

    @classmethod
    def of_tenant(cls, tenant: object, memory: retrieval.Memory, **tables: DataFrame) -> Engine:
        """Only a tenant's rows, cut before anything else reads them.

        Tables with ``user_id`` are cut by it; others by the notes, thoughts or entities of the tenant that they
        name; entities without an owner are the tenant's if it mentions them. ``memory.notes`` must tell its owner, and so must every table that names neither of these.
        """
        owned = lambda df: df.where(F.col("user_id") == F.lit(tenant))
        if "user_id" not in memory.notes.columns:
            raise ValueError("memory.notes must have a user_id")
        notes = owned(memory.notes)
        thoughts, entities, mentions = (tables.get(n) for n in ("thoughts", "entities", "mentions"))
        own_thoughts = notes.select(F.col("id").alias("thought_id"))
        if thoughts is not None:
            own_thoughts = own_thoughts.unionByName(owned(thoughts).select(F.col("id").alias("thought_id"))).distinct()
        named = {"thought_id": own_thoughts}
        if entities is not None and "user_id" in entities.columns:
            named["entity_id"] = owned(entities).select(F.col("id").alias("entity_id"))
        elif mentions is not None:
            told = owned(mentions) if "user_id" in mentions.columns else mentions.join(own_thoughts, "thought_id", "left_semi")
            named["entity_id"] = told.select("entity_id").distinct()

        def within(df: DataFrame, column: str, key: str) -> DataFrame:
            return df.join(named[key].select(F.col(key).alias("_own")), F.col(column) == F.col("_own"), "left_semi")

        def cut(name: str, df: DataFrame) -> DataFrame:
            if "user_id" in df.columns:
                return owned(df)
            for key in ("thought_id", "entity_id"):
                if key in df.columns and key in named:
                    return within(df, key, key)
            if name == "entities" and "entity_id" in named:
                return within(df, "id", "entity_id")
            if {"a", "b"} <= set(df.columns) and "entity_id" in named:
                return within(within(df, "a", "entity_id"), "b", "entity_id")
            raise ValueError(f"{name} does not tell whose its rows are")

        def lists(df: DataFrame) -> DataFrame:
            """Rows with the tenant's own thoughts alone, in their order; those without any go."""
            if "user_id" in df.columns:
                return owned(df)
            key = next(c for c in ("community_id", "entity_id") if c in df.columns)
            told = within(df.select(key, F.posexplode("thought_ids").alias("_i", "_t")), "_t", "thought_id")
            kept = told.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", "_t"))).alias("_l"))
            return df.join(kept, key).withColumn("thought_ids", F.col("_l._t")).select(*df.columns)

        own = retrieval.Memory(
            notes,
            lists(memory.communities),
            lists(memory.entities),
            within(within(memory.neighbors, "thought_id", "thought_id"), "neighbor_id", "thought_id"),
            within(memory.temporal, "id", "thought_id"),
        )
        return cls(own, **{n: cut(n, t) for n, t in tables.items()})

    def search(self, query: Sequence[float], said: str, *, top_k: int = 20, weights: dict[str, float] | None = None) -> DataFrame:
        """Hybrid retrieval by a query's vector and words; vectors do not leave."""
        return retrieval.search(self.memory, query, text.query_tokens(said, 3, 32), top_k=top_k, weights=weights)

    def nearest(self, query: Sequence[float], k: int = 30) -> DataFrame:
        return vector.top_k(self.memory.notes.where("active"), "id", "vec", list(query), k)

    def lexical(self, said: str, k: int = 30) -> DataFrame:
        return lexical.search(self.memory.notes.where("active"), text.query_tokens(said, 3, 32), k)

    def expand(self, entity_ids: DataFrame, limit: int = 50) -> DataFrame:
        return graph.thoughts_of_entities(self.mentions, self.edges, entity_ids, limit)

    def graph_search(self, said: str, limit: int = 20) -> DataFrame:
        return graph.search_by_tokens(self.entities, self.edges, text.query_tokens(said, 2), limit)

    def graph_health(self) -> DataFrame:
        return graph.health(self.entities, self.edges)

    def top_thoughts(self, now: str) -> DataFrame:
        return links.top_thoughts(self.mentions, self.thoughts, now)

    def timeline(self, low: str, high: str) -> DataFrame:
        return timeline.in_window(self.events, low, high)

    def agenda(self, now: str, most: int = 3) -> DataFrame:
        return timeline.focus_rank(self.events, now, most)

    def open_threads(self, sequence: DataFrame, limit: int = 50) -> DataFrame:
        members = self.mentions.where(F.col("source").isin(*links.MEMBERSHIP))
        return timeline.open_threads(self.thoughts, sequence, members, limit)

    def solve(self, kind: str, now: str) -> DataFrame:
        """ordering, duration, lookback or span of each user's events."""
        solvers = {"ordering": timeline.solve_ordering, "duration": timeline.solve_duration, "span": timeline.solve_span, "lookback": lambda e: timeline.solve_lookback(e, now)}
        if kind not in solvers:
            raise ValueError(f"unknown question: {kind}")
        return solvers[kind](self.events)

    def spend(self, unit: str = "day") -> DataFrame:
        return rollups.spend_series(self.calls, unit)
